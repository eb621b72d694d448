"""A Spark-native index of versioned text and code: chunks, edges, ranked search, diffs and evaluation."""
