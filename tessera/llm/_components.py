"""Connected components by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import written


def _stars(edges: DataFrame, of: str) -> DataFrame:
    """One round: every node's neighbours are tied to the smallest node among them and itself."""
    if of == "large":
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")  # so both sides of the join are plain shuffles
    tied = both.join(low, F.col("a") == F.col("n"))
    if of == "large":
        out = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges`` (two bigint columns); root is the smallest node of its component.

    Rounds go on until the stars no longer change; each is written to the shared folder, so no
    lineage grows and the driver sees two numbers per round. Minima are combined before the
    shuffle and written before they are joined to the links; neither side of that join is an
    aggregate then, so Spark can split the links of a hub over tasks.
    """
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        now = written(_stars(_stars(now, "large"), "small"), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
