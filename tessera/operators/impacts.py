"""The best chunks of a request without reading all postings of its words.

Postings are kept in blocks, each term's in order of impact, what a posting adds to a score. A
first pass over the first blocks gives a score that the k-th best chunk reaches at least. A second
pass reads the blocks in which a posting can still belong to a chunk of that score: a block's
largest impact and the largest ones of the request's other terms must reach it. Every posting of a
chunk among the best lies in such a block, so its score is whole and the result exact. One frequent
word is read in small part; where several words of a request can lift any chunk to the score of the
first pass, their blocks are read whole, and nothing is gained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import B, BUCKETS, K1, bucket_of, impact
from tessera.session import numbered

BLOCK = 128
BLOCKS = "term string, block bigint, top double, n int, posts array<struct<id:string,score:double>>, bucket int"
#: Sums of doubles in another order differ by less.
SLACK = 1e-9


def write_blocks(postings: DataFrame, stats: DataFrame, path: str, size: int = BLOCK, buckets: int = BUCKETS, k1: float = K1, b: float = B) -> None:
    """Blocks of ``size`` postings (term, id, tf, dl) by bucket of term, with the impacts under ``stats``.

    Postings are numbered by range, so a term that every chunk has is spread over tasks. Files are
    in order of term and impact, in small row groups, so that a read is cut down by their statistics.
    """
    scored = postings.crossJoin(F.broadcast(stats)).select("term", "id", impact(k1, b).alias("score"))  # one row
    rows = numbered(scored, F.col("term"), F.col("score").desc(), F.col("id"))
    first = rows.groupBy(F.col("term").alias("__t")).agg(F.min("number").alias("__first"))
    placed = rows.join(first, F.col("term") == F.col("__t")).withColumn("block", F.floor((F.col("number") - F.col("__first")) / size))
    posts = F.array_sort(F.collect_list(F.struct("id", "score")))  # at most ``size``
    blocks = placed.groupBy("term", "block").agg(F.max("score").alias("top"), F.count("*").cast("int").alias("n"), posts.alias("posts")).withColumn("bucket", bucket_of(F.col("term"), buckets))
    dealt = blocks.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("overwrite").option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def _read(blocks: DataFrame, keep: Column, seen: DataFrame | None) -> DataFrame:
    """(id, score) by the postings of some blocks, of the chunks in ``seen`` (id)."""
    found = blocks.filter(keep).select(F.inline("posts")).groupBy("id").agg(F.sum("score").alias("score"))
    return found if seen is None else found.join(seen.select("id").distinct(), "id", "left_semi")


def best(blocks: DataFrame, terms: list[str], k: int, seen: DataFrame | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """((id, score) of the ``k`` best chunks for a request's ``terms``, one row (read, held) of how many of their postings the two passes read and how many there are).

    Scores are rounded to nine digits before they rank; ties go to the smaller id. The driver sees
    one number a term and the ``k`` scores of the first pass. Terms that no chunk has, and no terms
    at all, add nothing.
    """
    spark = blocks.sparkSession
    terms = sorted(set(terms))
    wanted = sorted({r.b for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), buckets).alias("b")).collect()})  # a request's words
    mine = blocks.filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    most = {r.term: r.top for r in mine.filter("block = 0").select("term", "top").collect()}  # one row a word
    ranked = lambda df: df.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(k)
    first = [r.score for r in ranked(_read(mine, F.col("block") == 0, seen)).select("score").collect()] if most else []  # at most k rows
    least = min(first) - SLACK if len(first) == k else float("-inf")
    keep, head = F.lit(False), F.col("block") == 0
    for term, top in most.items():
        keep = keep | ((F.col("term") == term) & (F.col("top") >= least - (sum(most.values()) - top) - SLACK))
    read = F.coalesce(F.sum(F.when(head, F.col("n"))), F.lit(0)) + F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))
    return ranked(_read(mine, keep, seen)), mine.agg(read.alias("read"), F.coalesce(F.sum("n"), F.lit(0)).alias("held"))
