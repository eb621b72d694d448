"""Incremental indexing as a stream: each micro-batch is met with what was done, and leaves a completion row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unseen(batch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose keys weren't processed before, each key once; a null is a key like any other.

    What was done is first cut to the batch's keys: that side grows without end, and a small batch
    is broadcast by its measured size, so that it is scanned but not shuffled or sorted.
    """
    wanted = batch.select(*keys).distinct().alias("wanted")
    known = done.select(*keys).alias("done")
    known = known.join(wanted, reduce(and_, [F.col(f"done.{k}").eqNullSafe(F.col(f"wanted.{k}")) for k in keys]), "left_semi").toDF(*[f"__done_{k}" for k in keys])
    fresh = batch.dropDuplicates(keys)
    return fresh.join(known, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__done_{k}")) for k in keys]), "left_anti")


def first_targets(queued: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One queued row of every target: that which came first."""
    return queued.groupBy(*keys).agg(F.min(order).alias(order))


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def process(stream: DataFrame, root: str, keys: list[str], work: Callable[[DataFrame], DataFrame], trigger_once: bool = True):
    """Starts a query that runs ``work`` over the new rows of every micro-batch.

    Results are written per batch id, so a batch that is repeated after a failure replaces its own
    output; ``log`` gets one row per batch. A batch's rows are excluded from "done" by that id.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _read_or_empty(spark, f"{root}/done", batch.select(*keys, F.lit(0).cast("long").alias("batch")).schema).filter(F.col("batch") != number)
        fresh = unseen(batch, done, keys)
        work(fresh).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        fresh.select(*keys).write.mode("overwrite").parquet(f"{root}/done/batch={number}")
        fresh.agg(F.count("*").alias("n")).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{root}/log/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def completion_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/log")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extra beyond the blueprint: event counts in tumbling windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
