"""Files as DataFrames: a folder walk, ignore rules, parquet parts, footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import ignored, is_binary

MAX_FILE_BYTES = 512 * 1024
DEFAULT_IGNORES = (".tessera/",)


def list_files(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, ignore: list[str] | None = None) -> DataFrame:
    """(file_path, blob_sha, content) of a folder's files that no rule ignores, up to ``max_bytes``, without binary ones.

    Length and path are filtered before content is read, so large files are never loaded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = root.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "/?" + _quoted(top.lstrip("/")) + "/", "")
    rows = raw.filter(F.col("length") <= max_bytes).select(path.alias("file_path"), "content")
    return admitted(rows, ignore).select("file_path", F.md5("content").alias("blob_sha"), "content")


def admitted(files: DataFrame, ignore: list[str] | None = None, path: str = "file_path", content: str = "content") -> DataFrame:
    """Files that the ignore rules and the test for binary content let pass."""
    return files.filter(~ignored(F.col(path), [*DEFAULT_IGNORES, *(ignore or [])])).filter(~is_binary(F.col(content)))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def read_parts(spark: SparkSession, *patterns: str) -> DataFrame:
    """Parquet files of several patterns as one table; columns are met by name."""
    return spark.read.option("mergeSchema", True).parquet(*patterns)


def footprint_by(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, files, bytes) of files that are rows already; bytes are those of the content in UTF-8."""
    return files.groupBy(key).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("bytes"))


def footprint(spark: SparkSession, root: str) -> DataFrame:
    """(files, bytes) under a folder, from file metadata alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("length").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
