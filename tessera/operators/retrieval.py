"""Retrieval channels: postings with BM25, exact vector similarity, and tiered name matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokenise_code
from tessera.functions.vectors import best_cosine
from tessera.operators.store import Store, at_snapshots
from tessera.session import written

K1, B = 1.2, 0.75


def tokens_of(chunks: DataFrame) -> DataFrame:
    """(id, term, tf, dl): terms of name and content; each field holds a term once, so tf is 1 or 2."""
    both = chunks.select("id", _terms().alias("t"))
    return both.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


def _terms() -> Column:
    """The terms of a chunk's name and content."""
    split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda t: t != "")
    return F.concat(split("name_tokens"), split("content_tokens"))


def build_postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index: postings (term, id, tf, dl) and one row of statistics (n, avgdl)."""
    return tokens_of(chunks).select("term", "id", "tf", "dl"), doc_lengths(chunks).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


#: Buckets of terms that written postings are partitioned by.
BUCKETS = 64
#: Groups of buckets, and of chunks, that meet in one task when postings are written.
GROUPS, CUTS = 16, 8


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def gathered_tokens(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``tokens_of`` with ``bucket``, partitioned by bucket and cut by chunk.

    What is shuffled is a row for a chunk and a group of buckets, its terms as one text; terms are
    told apart and counted behind the shuffle, so an id travels once a group instead of once a term.
    """
    group = lambda t: F.pmod(bucket_of(t, buckets), F.lit(GROUPS))
    rows = chunks.select("id", F.array_sort(F.transform(_terms(), lambda t: F.struct(group(t).alias("g"), t.alias("t")))).alias("s"))
    rows = rows.select("id", F.size("s").alias("dl"), F.col("s.g").alias("g"), F.col("s.t").alias("t"))
    rows = rows.select("id", "dl", "g", "t", F.explode(F.array_distinct("g")).alias("group"))
    own = F.slice("t", F.array_position("g", F.col("group")).cast("int"), F.size("g") - F.size(F.array_remove("g", F.col("group"))))
    cut = rows.select("id", "dl", "group", F.pmod(F.xxhash64("id"), F.lit(CUTS)).alias("cut"), F.array_join(own, " ").alias("words")).repartition("group", "cut")
    keys = ["group", "cut", "id", "dl", "term"]
    counted = cut.select(*keys[:-1], F.explode(F.split("words", " ")).alias("term")).groupBy(*keys).agg(F.count("*").alias("tf"))  # within a task
    return counted.select("term", "id", "tf", "dl", bucket_of(F.col("term"), buckets).alias("bucket"))


POSTINGS = "term string, id string, tf bigint, dl int, bucket int"
STATS = "n bigint, avgdl double"


def doc_lengths(chunks: DataFrame) -> DataFrame:
    """(id, dl) of every chunk, those without a term too."""
    return chunks.select("id", F.size(F.filter(F.split(F.concat_ws(" ", "name_tokens", "content_tokens"), " "), lambda t: t != "")).alias("dl"))


def write_postings(chunks: DataFrame | None, path: str, buckets: int = BUCKETS, postings: DataFrame | None = None, docs: DataFrame | None = None, small: bool = False) -> None:
    """Postings by bucket of term, so that a query reads only the buckets of its terms, their statistics and the lengths of chunks. A very common term's bucket is cut by chunk, so that no task writes all of it.

    Instead of ``chunks``, ``postings`` and ``docs`` that are there already may be given. What is
    ``small`` is one file in order of buckets, which are then found by its statistics.
    """
    if postings is None and not small:
        spread = gathered_tokens(chunks, buckets)
    else:
        made = tokens_of(chunks).select("term", "id", "tf", "dl") if postings is None else postings.select("term", "id", "tf", "dl")
        bucketed = made.withColumn("bucket", bucket_of(F.col("term"), buckets))
        spread = bucketed.coalesce(1) if small else bucketed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    spread.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy(*[] if small else ["bucket"]).parquet(f"{path}/postings")
    (doc_lengths(chunks) if docs is None else docs.select("id", "dl")).write.mode("overwrite").parquet(f"{path}/docs")
    spark = (postings if chunks is None else chunks).sparkSession
    sizes = spark.read.schema("id string, dl int").parquet(f"{path}/docs")
    sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")


def with_postings(store: Store, postings: DataFrame, stats: DataFrame) -> Store:
    """The store with a full-text index over its chunks, in ``BUCKETS`` buckets."""
    return store.but(chunks=store.chunks, postings=postings, posting_stats=stats)


def written_postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) that ``write_postings`` wrote."""
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(STATS).parquet(f"{path}/stats")


def words_of(spark: SparkSession, text: str) -> tuple[list[str], list[int]]:
    """The terms of a request's text and their buckets."""
    terms = F.filter(F.split(tokenise_code(F.lit(text)), " "), lambda t: t != "")
    row = spark.range(1).select(terms.alias("t")).select("t", F.transform("t", lambda t: bucket_of(t)).alias("b")).first()
    return list(row.t), sorted(set(row.b))


def postings_for(store: Store, terms: list[str] | None = None, buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of the store, all or those of ``terms``. Written ones are read by ``buckets``, if these are given; where none are written, they are built from the chunks."""
    postings, stats = build_postings(store.chunks) if store.postings is None else (store.postings, store.posting_stats)
    if terms is not None:
        postings = postings.filter(F.col("term").isin(terms))
        if buckets is not None and store.postings is not None:
            postings = postings.filter(F.col("bucket").isin(buckets))
    return postings, stats


def bm25(postings: DataFrame, stats: DataFrame, query: str | DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score), or with many queries (query, id, score): BM25 with every term's IDF held at 1.

    ``query`` is a text, or a DataFrame (query, text) of a request's queries. A constant IDF
    cancels when scores are normalised within a query. Without a query all of ``postings`` count,
    which are then those of its terms.
    """
    spark = postings.sparkSession
    if query is None:
        return postings.crossJoin(F.broadcast(stats)).groupBy("id").agg(F.sum(impact(k1, b)).alias("score"))
    queries = spark.createDataFrame([(0, query)], "query bigint, text string") if isinstance(query, str) else query.select("query", "text")
    terms = queries.select("query", F.explode(F.split(tokenise_code(F.col("text")), " ")).alias("term")).filter("term <> ''").distinct()
    hits = postings.join(terms, "term").crossJoin(F.broadcast(stats))  # stats is one row
    out = hits.groupBy("query", "id").agg(F.sum(impact(k1, b)).alias("score"))
    return out.drop("query") if isinstance(query, str) else out


def impact(k1: float = K1, b: float = B) -> Column:
    """What a posting adds to a chunk's score."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


#: What the channels of a search need to know of a chunk.
SEEN = ["id", "repo_id", "file_path", "kind", "name"]


def visible(store: Store, refs: DataFrame) -> DataFrame:
    """(id, repo_id, file_path, kind, name) of the chunks visible at ``refs``, once a repository; written, since every channel of a search reads it."""
    return written(at_snapshots(store, refs, once=True).select(*SEEN), "visible")


def lexical(store: Store, refs: DataFrame, query: str, k: int, seen: DataFrame | None = None) -> DataFrame:
    """The ``k`` best chunks by BM25 among those visible at ``refs`` (``seen``, if that is written already); ties go to the smaller id and repository."""
    postings, stats = postings_for(store, *words_of(store.chunks.sparkSession, query))
    seen = (at_snapshots(store, refs, once=True) if seen is None else seen).select("id", "repo_id")
    return bm25(postings, stats).join(seen, "id").orderBy(F.desc("score"), "id", "repo_id").limit(k).withColumnRenamed("score", "lexical")


def semantic(store: Store, refs: DataFrame, queries: list[list[float]], k: int, seen: DataFrame | None = None) -> DataFrame:
    """The ``k`` best chunks by the largest cosine to any query vector. Vectors are read once for all of them and go no further: what meets the visible chunks is each one's similarity."""
    scored = store.chunks.filter(F.col("embedding").isNotNull()).select("id", best_cosine(F.col("embedding"), queries).alias("semantic")).filter(F.col("semantic").isNotNull())
    seen = at_snapshots(store, refs, once=True).select(*SEEN) if seen is None else seen
    return scored.join(seen, "id").orderBy(F.desc("semantic"), "id", "repo_id").limit(k)


def kept_of_pool(pool: DataFrame, keep: Column, k: int, score: str, *ties: str) -> DataFrame:
    """The ``k`` best rows of an over-fetched pool that ``keep`` lets pass. The pool was cut before, so fewer than ``k`` may be left."""
    return pool.filter(keep).orderBy(F.desc(score), *ties).limit(k)


def name_tiers(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Rows whose name matches, with match_tier: 1 equal, 2 equal but for case, 3 prefix, 4 within.

    As in the pattern language of LIKE, ``%`` and ``_`` of the request act as wildcards; a
    backslash is an ordinary character.
    """
    like = lambda pattern: F.expr(f"{column} ILIKE {_literal(pattern)} ESCAPE '\x01'")
    tier = F.when(F.col(column) == name, 1).when(like(name), 2).when(like(name + "%"), 3).otherwise(4)
    return df.filter(like(f"%{name}%")).withColumn("match_tier", tier)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_by_name(store: Store, refs: DataFrame, name: str, seen: DataFrame | None = None) -> DataFrame:
    """All chunks of the best tier that occurs at all, with the columns of ``seen``, if that is given; there is no limit."""
    ranked = name_tiers(at_snapshots(store, refs, once=True) if seen is None else seen, name)
    best = ranked.agg(F.min("match_tier").alias("best"))
    return ranked.join(F.broadcast(best), F.col("match_tier") == F.col("best")).drop("best", "match_tier")


def per_query_top(scored: DataFrame, k: int, keys: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The ``k`` best rows of every key, ranked from 1; each task keeps ``k`` a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
