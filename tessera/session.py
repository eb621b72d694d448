"""A Spark session with the settings that this library is tuned for, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}

_own_folder: str | None = None


def session(master: str | None = None, **more: str) -> SparkSession:
    """The running session, or a new one; ``more`` holds settings with ``__`` for dots."""
    builder = SparkSession.builder.appName("tessera")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): str(v) for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset a temporary folder serves a local master, as in tests; on a cluster it is an error, since executors would write to disks of their own."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    _own_folder = _own_folder or "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_folder


#: Scratch tables of each application that are still there, but for those of runs that haven't ended.
_made: dict[str, list[str]] = {}
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)


def _listed(spark: SparkSession) -> list[str]:
    run = _run.get()
    return _made.setdefault(spark.sparkContext.applicationId, []) if run is None else run


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, for what lasts as long as the application."""
    return f"{_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, listed for ``release``."""
    path = shared_path(spark, name)
    _listed(spark).append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A run: scratch tables that are made inside are listed in its value, and ``release`` inside touches only those. What is left at its end goes to the list around it."""
    own: list[str] = []
    token = _run.set(own)
    try:
        yield own
    finally:
        _run.reset(token)
        _listed(spark).extend(own)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes scratch tables: ``paths``, or all of this run, or outside of runs all of the application. DataFrames that read them must have been computed before."""
    held = _listed(spark)
    for name in list(held if paths is None else paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in held:
            held.remove(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its plan runs once, and its size is known from here on."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source has fewer partitions than those, as one small file has; larger inputs stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``number``, the place of every row in ``order`` from 1.

    Rows are range-partitioned and sorted; a row's number is its place within its partition and the
    size of those before, so no task holds more than a range. ``df`` is read twice.
    """
    spark = df.sparkSession
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__m", 33)
    before, offsets = 0, []
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a partition
        offsets.append((r.p, before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "p bigint, before bigint")
    place = F.col("before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), part == F.col("p")).withColumn("number", place).drop("__m", "p", "before")  # one row a partition
