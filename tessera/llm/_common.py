"""What the corpus operators share: white space, scratch tables, slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: The white space of every contract here: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so a lost executor costs a reread only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", rows: int = 1000, megabytes: int = 8) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, and of at most so many bytes of ``text`` unless one text is larger; so what Python makes of a slice stays small whatever the session's batch limits."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + (megabytes << 20), side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def unclashing(carry: tuple[str, ...], *own: str) -> None:
    """An error if a column that is carried along has the name of one of the result's own."""
    if clash := sorted({*carry} & {*own}) or len(carry) > len({*carry}):
        raise ValueError(f"columns can't be carried, their names clash: {clash}")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A to Z lowered, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The maximal runs of characters that are not white space."""
    return F.filter(F.split(text, WHITE_RUN), lambda w: w != "")
