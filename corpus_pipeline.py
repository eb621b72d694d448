"""A corpus pipeline of five stages: quality, line dedup, near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the
shared folder and rereads it for the next. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import written
from tessera.llm.line_dedup import drop_shared_lines
from tessera.llm.packing import pack
from tessera.llm.quality import quality
from tessera.llm.queries import vocabulary
from tessera.llm.secrets import redacted, secret_spans
from tessera.llm.simhash import near_duplicates
from tessera.session import release, scratch, scratch_path


def _carrying(docs: DataFrame, *but: str) -> DataFrame:
    """doc_id, text and the row itself ``but`` those columns as __row: operators hand it on, so no row meets another with its doc_id."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in but]).alias("__row"))


def _with_text(new: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The rows that ``new`` carries, with ``text`` and n_chars following it, as ``columns``."""
    values = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return new.select(*[values[c].alias(c) if c in values else F.col("__row")[c].alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep the lines that pass."""
    judged = quality(_carrying(docs, "text"), carry=("__row",)).select("__row", "kept", "kept_text")
    judged = written(judged, "judged")  # else the filter would repeat the rules
    return _with_text(judged.filter("kept"), F.col("kept_text"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them only; documents stay, even empty ones."""
    return _with_text(drop_shared_lines(_carrying(docs, "text"), carry=("__row",)), F.col("kept_text"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the smallest doc_id, nulls last, then by a hash of the row; rows equal in all columns are told apart by number."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = written(docs.withColumn("__order", order), "rows")  # the numbers must stay the same for both reads
    row = F.col("__order")["row"]
    first = near_duplicates(rows, "__order").filter(row == F.col("component_id")["row"]).select(row.alias("__first"))
    return rows.join(first, row == F.col("__first"), "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay."""
    found, _ = secret_spans(_carrying(docs), carry=("__row",))
    return _with_text(found, redacted(F.col("__row")["text"], F.col("found")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of the documents: where each piece lies, and its identifiers."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("secret scans", secret_scan), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch(spark) as made:
            out = stage(spark, docs, sf_dir)
            path = scratch_path(spark, name.replace(" ", "-"))
            out.write.parquet(path)
            release(spark, [p for p in made if p != path])
        docs = spark.read.schema(out.schema).parquet(path)
        release(spark, before)  # the stage's input isn't needed any more
        before = [path]
    return docs


#: SQL expresses neither the components of SimHash links nor tokens; tests hold each stage against brute force.
ORACLE_SQL = None
