"""Tables of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "struct<module:string,names:string,dots:string,language_hint:string>"
TABLES = {
    "meta": ("key string, value string", ["key"]),
    "repos": ("id int, path string", ["id"]),
    "file_snapshots": ("repo_id int, snapshot_sha string, file_path string, blob_sha string, detected_language string", ["repo_id", "snapshot_sha", "file_path"]),
    "chunks": (
        "id string, blob_sha string, file_path string, kind string, name string, scope string, language string, extraction_serial int, content string, "
        f"content_tokens string, name_tokens string, line_start int, line_end int, metadata {META}, embedding array<float>, embedding_truncated boolean",
        ["id"],
    ),
    "edges": ("repo_id int, source_id string, target_id string, kind string, snapshot_sha string", ["repo_id", "source_id", "target_id", "kind", "snapshot_sha"]),
    "indexed_snapshots": ("repo_id int, snapshot_sha string, indexed_at timestamp", ["repo_id", "snapshot_sha"]),
    "watched_refs": ("repo_id int, ref string", ["repo_id", "ref"]),
}
CHUNK_KINDS = ("function", "class", "method", "variable", "import", "doc_section", "config_key", "comment", "raw_chunk", "test_function", "api_endpoint", "migration")
SYMBOL_KINDS = ("function", "class", "method")
EDGE_KINDS = ("calls", "imports", "inherits", "documents", "configures")
#: Columns of a chunk as queries return it: the repository instead of tokens, and a flag instead of the vector.
CHUNK_RESULT = ["id", "repo_id", "blob_sha", "file_path", "kind", "name", "scope", "language", "content", "line_start", "line_end", "metadata", "has_embedding"]


def struct_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table][0])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` cast to the table's columns; a column that is missing becomes null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct_of(table)])


def frame(spark: SparkSession, table: str, rows: list[dict], **same) -> DataFrame:
    """Rows given as dictionaries as a DataFrame of the table's columns; ``same`` holds for all of them, and no rows give an empty table.

    A column that the table lacks, a null in its key and vectors of unequal length are errors.
    """
    fields = struct_of(table)
    for row in rows:
        if unknown := (row.keys() | same.keys()) - set(fields.names):
            raise ValueError(f"{table} has no column {sorted(unknown)}")
        if missing := [k for k in TABLES[table][1] if {**same, **row}.get(k) is None]:
            raise ValueError(f"{table} needs {missing} in every row")
    if len({len(r["embedding"]) for r in rows if r.get("embedding") is not None}) > 1:
        raise ValueError("vectors differ in length")
    return spark.createDataFrame([tuple({**same, **r}.get(n) for n in fields.names) for r in rows], fields)


def unique(df: DataFrame, table: str, *order) -> DataFrame:
    """One row per primary key: the first in ``order``."""
    keys = TABLES[table][1]
    if not order:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
