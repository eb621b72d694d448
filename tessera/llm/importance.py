"""Importance resampling towards a target distribution, in two Arrow passes.

The first pass counts hashed features: every task makes one vector of bucket counts with
``np.bincount`` and ``treeReduce`` merges them. The vectors of the corpus and of the target give
every bucket a gain. The second pass sums the gains of every document's features with weighted
bincounts. Documents are then drawn by weight and Gumbel noise, which is sampling without
replacement in proportion to the importance weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _flat
from tessera.llm._common import slices, text_or_empty, written
from tessera.session import numbered

BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
SHARE = 10  # per cent of the documents with enough words
SEED = "2024"
#: ASCII letters and digits; other ASCII characters part words and all others belong to them.
KINDS = _flat.classes("", kept=b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def features(texts: pa.Array, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all runs of one word, of two, and so on up to ``longest``."""
    words = _flat.split(texts, KINDS)
    at, state = np.arange(len(words.start)), None
    for n in range(longest):
        if n:
            stays = (at + n < len(words.start)) & (words.row[np.minimum(at + n, len(words.start) - 1)] == words.row[at])
            at, state = at[stays], state[stays]
        state = _flat.crc32(words, at + n, state)
        yield words.row[at], (state % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """How many features of all rows of ``docs`` lie in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, bucket in features(batch.column("text"), buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(text_or_empty(text).alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    none = docs.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # a table may have no partition at all
    return vectors.union(none).treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is commoner in the target, each bucket smoothed by one."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * (s_all + size)) / (float(s + 1) * (t_all + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.float64)


def weighted(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; weights are whole numbers, so their sums in doubles are exact."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            words, count, weight = None, np.zeros(n, np.int64), np.zeros(n, np.float64)
            for row, bucket in features(batch.column("text"), buckets, longest):
                found = np.bincount(row, minlength=n)
                words = found if words is None else words
                count += found
                weight += np.bincount(row, weights=gain[bucket], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.int64()), pa.array(count), pa.array(weight.astype(np.int64))], names=["id", "n_words", "n_features", "weight"])

    src = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    return src.mapInArrow(weigh, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN, least_words: int = LEAST_WORDS, share: int = SHARE, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null where the row isn't drawn.

    Of the N rows with ``least_words`` words or more, floor(share * N / 100) are drawn: those with
    the highest scores, ties to the smaller doc_id. Noise depends on ``seed`` and doc_id alone, so
    a row draws alike in every run.

    * Null or empty text: no features, weight 0. A null doc_id draws as if it were empty and comes
      last in ties. Rows that repeat a doc_id share its noise and are drawn one by one.
    * An empty target leaves every bucket's gain to the smoothing. An empty table gives none.
    * Only doc_id and text are read, so other columns may have any name.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighted(docs, gain, doc_id, text, longest).withColumn("score", F.col("weight") + noise), "weighted")  # ranges are sampled from it
    enough = F.col("n_words") >= least_words
    ranked = numbered(scored, (~enough).asc(), F.col("score").desc(), F.col("id").asc_nulls_last())
    drawn = ranked.filter(enough).count() * share // 100
    rank = F.when(enough & (F.col("number") <= drawn), F.col("number"))
    return ranked.select(F.col("id").alias(doc_id), "n_words", "n_features", "weight", "score", rank.alias("rank"))
