"""The index's tables derived from the driver's: a document is a file with one chunk, its source a repository, in two snapshots."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import chunk_id
from tessera.functions.text import tokenise_code
from tessera.operators.retrieval import with_postings, write_postings, written_postings
from tessera.operators.store import Store
from tessera.schema import CHUNK_KINDS
from tessera.session import shared_path, spread

KINDS = ", ".join(f"'{k}'" for k in CHUNK_KINDS)
PATH = """CASE doc_id % 6 WHEN 0 THEN concat('src/', lang, '/m', doc_id, '.py') WHEN 1 THEN concat('tests/test_m', doc_id, '.py')
  WHEN 2 THEN concat('docs/', lang, '/g', doc_id, '.md') WHEN 3 THEN concat('vendor/lib/v', doc_id, '.js')
  WHEN 4 THEN concat('conf/c', doc_id, '.toml') ELSE concat('src/', lang, '/s', doc_id, '.go') END"""

STORE_SQL = f"""
WITH d AS (SELECT doc_id, text, lang, CAST(substr(source, 4) AS INT) AS repo_id, {PATH} AS file_path FROM documents),
f AS (
  SELECT 'base' AS snapshot_sha, doc_id, repo_id, file_path, lang, text AS content FROM d WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT 'head', doc_id, repo_id, file_path, lang, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END FROM d WHERE doc_id % 10 <> 1),
c0 AS (SELECT *, md5(content) AS blob_sha, coalesce(nullif(regexp_extract(content, '([A-Za-z]+)', 1), ''), 'x') AS name,
  CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS scope, ([{KINDS}])[doc_id % 12 + 1] AS kind, CAST(doc_id % 50 + 1 AS INT) AS line_start FROM f),
c1 AS (SELECT *, substr(sha256(file_path || ':' || blob_sha || ':' || name || ':' || (line_start - 1)), 1, 16) AS id,
  CAST(line_start + len(string_split(content, chr(10))) - 1 AS INT) AS line_end FROM c0),
file_snapshots AS (SELECT repo_id, snapshot_sha, file_path, blob_sha, lang AS detected_language FROM c1),
chunks AS (SELECT DISTINCT ON (id) c1.id, doc_id, blob_sha, file_path, kind, name, scope, lang AS language, CAST(1 + doc_id % 3 AS INT) AS extraction_serial, content,
  line_start, line_end, e.embedding AS embedding, e.embedding IS NOT NULL AS has_embedding, e.embedding IS NOT NULL AND doc_id % 11 = 0 AS embedding_truncated
  FROM c1 LEFT JOIN embeddings e ON e.vec_id = c1.doc_id),
edges AS (SELECT s.repo_id, s.id AS source_id, t.id AS target_id, CASE WHEN s.doc_id % 2 = 0 THEN 'imports' ELSE 'documents' END AS kind, s.snapshot_sha
  FROM c1 s JOIN c1 t ON t.doc_id = (s.doc_id * s.doc_id) % 97 AND t.snapshot_sha = s.snapshot_sha),
repos AS (SELECT DISTINCT repo_id AS id, concat('/repos/src', repo_id) AS path FROM d),
indexed_snapshots AS (
  SELECT id AS repo_id, 'base' AS snapshot_sha, TIMESTAMP '2024-01-01 00:00:00' AS indexed_at FROM repos
  UNION ALL SELECT id, 'head', TIMESTAMP '2024-01-02 00:00:00' FROM repos WHERE id % 7 <> 3),
watched_refs AS (SELECT id AS repo_id, 'main' AS ref FROM repos WHERE id % 2 = 0)
"""


#: Tables whose rows are texts, which take long to parse; one small file of them would keep one core busy.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "lang", F.expr("cast(substr(source, 4) as int)").alias("repo_id"), F.expr(PATH).alias("file_path"))


def versions(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Every document's file at base and at head; ``once``, without the base of those that are the same at head, which have the same chunk."""
    d = documents(spark, sf_dir)
    base = d.filter("doc_id % 10 <> 0" + (" and (doc_id % 10 = 1 or doc_id % 7 = 0)" if once else "")).withColumn("snapshot_sha", F.lit("base"))
    head = d.filter("doc_id % 10 <> 1").withColumn("snapshot_sha", F.lit("head")).withColumn("text", F.expr("case when doc_id % 7 = 0 then text || ' edited' else text end"))
    f = base.unionByName(head).withColumnRenamed("text", "content").withColumn("blob_sha", F.md5("content"))
    f = f.withColumns(
        {
            "name": F.expr("coalesce(nullif(regexp_extract(content, '([A-Za-z]+)', 1), ''), 'x')"),
            "scope": F.expr("case when doc_id % 3 = 0 then lang else '' end"),
            "kind": F.expr(f"element_at(array({KINDS}), cast(doc_id % 12 + 1 as int))"),
            "line_start": F.expr("cast(doc_id % 50 + 1 as int)"),
        }
    )
    return f.withColumns({"id": chunk_id(F.col("file_path"), F.col("blob_sha"), F.col("name"), F.col("line_start")), "line_end": F.expr("line_start + size(split(content, '\\n', -1)) - 1")})


_written: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The index over a data folder: derived and written once a session, as an index is, then read from its tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        made, root = derived(spark, sf_dir), shared_path(spark, "index")
        tables = {}
        for f in fields(Store):
            df = getattr(made, f.name)
            if df is not None:
                df.write.parquet(f"{root}/{f.name}")
                tables[f.name] = spark.read.schema(df.schema).parquet(f"{root}/{f.name}")
        write_postings(tables["chunks"], root)
        _written[key] = with_postings(Store(**tables), *written_postings(spark, root))
    return _written[key]


def derived(spark: SparkSession, sf_dir: str) -> Store:
    v = versions(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    chunks = versions(spark, sf_dir, once=True).select("id", "doc_id", "blob_sha", "file_path", "kind", "name", "scope", F.col("lang").alias("language"), F.expr("cast(1 + doc_id % 3 as int)").alias("extraction_serial"), "content", "line_start", "line_end")
    chunks = chunks.repartition("doc_id").dropDuplicates(["doc_id", "id"]).join(vectors, "doc_id", "left")  # an id is of one document, since its path is; contents are shuffled once
    chunks = chunks.withColumns(
        {
            "content_tokens": tokenise_code(F.col("content")),
            "name_tokens": tokenise_code(F.col("name")),
            "metadata": F.lit(None).cast("struct<module:string,names:string,dots:string,language_hint:string>"),
            "embedding_truncated": F.col("embedding").isNotNull() & (F.col("doc_id") % 11 == 0),
        }
    ).drop("doc_id")
    target = v.select(F.col("doc_id").alias("t"), "snapshot_sha", F.col("id").alias("target_id"))
    source = v.select("repo_id", "doc_id", F.col("id").alias("source_id"), "snapshot_sha", ((F.col("doc_id") * F.col("doc_id")) % 97).alias("t"))
    edges = source.join(target, ["t", "snapshot_sha"]).select("repo_id", "source_id", "target_id", F.expr("case when doc_id % 2 = 0 then 'imports' else 'documents' end").alias("kind"), "snapshot_sha")
    repos = documents(spark, sf_dir).select(F.col("repo_id").alias("id")).distinct().withColumn("path", F.concat(F.lit("/repos/src"), "id"))
    base = repos.select(F.col("id").alias("repo_id"), F.lit("base").alias("snapshot_sha"), F.expr("timestamp '2024-01-01 00:00:00'").alias("indexed_at"))
    head = repos.filter("id % 7 <> 3").select(F.col("id").alias("repo_id"), F.lit("head").alias("snapshot_sha"), F.expr("timestamp '2024-01-02 00:00:00'").alias("indexed_at"))
    return Store(
        chunks,
        v.select("repo_id", "snapshot_sha", "file_path", "blob_sha", F.col("lang").alias("detected_language")),
        edges,
        repos,
        base.unionByName(head),
        repos.filter("id % 2 = 0").select(F.col("id").alias("repo_id"), F.lit("main").alias("ref")),
    )


def refs(spark: SparkSession, *pairs: tuple[int, str]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "repo_id int, snapshot_sha string")


def some_ids(s: Store, path_like: str = "docs/%") -> DataFrame:
    return s.chunks.filter(F.col("file_path").like(path_like)).select("id")
