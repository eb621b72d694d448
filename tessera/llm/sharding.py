"""Sharding by sampled splitters: records into a fixed number of shards of nearly equal bytes.

Keys are drawn with a probability that grows with the record's size; their quantiles are the
boundaries of many small ranges. Overfull ranges are subdivided: heavy keys leave their range and
become units of their own, and a key with more than a shard's share is cut into runs of records.
Units are then laid into shards, largest first into the emptiest shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import text_or_empty, written

SHARDS = 16
#: Ranges per shard, and samples drawn per range: 1024 boundaries out of about 32,768 sampled keys, whatever the input.
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 32
#: A key with more than this part of a shard's share is a unit of its own.
HEAVY = 32
#: Rows numbered together, about.
SLOT_ROWS = 50_000


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the 64-bit group key of equal texts."""
    t = text_or_empty(text)
    return docs.select(F.col(doc_id).alias("id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("key"))


def _boundaries(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Inner quantiles of a size-weighted sample of keys. A row's draw is a hash of the row, so a retried task draws the same."""
    wanted = ranges * SAMPLES_PER_RANGE
    draw = F.pmod(F.xxhash64("id", "crc", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(draw < F.col("size") * (wanted / max(total, 1))).groupBy("key").count()
    keys = sorted((r.key, r["count"]) for r in sample.collect())
    n, seen, cuts = sum(c for _, c in keys), 0, []
    for key, c in keys:
        seen += c
        if seen * ranges >= n * (len(cuts) + 1):
            cuts.append(key)
            at = seen * ranges // max(n, 1)
            cuts += [key] * (min(at, ranges - 1) - len(cuts))
    return sorted(set(cuts))


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``bytes``).

    Equal texts share a shard, unless together they exceed a shard's share of all bytes; then they
    are cut into equal runs. Slots number the rows of each shard from 0 without gaps.

    * Null text: size 1, the checksum of the empty text, and grouped with empty texts.
    * Null doc_id and repeated rows: rows like others, each with its own slot. Rows are numbered in
      buckets dealt by row and by place in the scratch table, so any number of copies of one row is
      spread; beyond ``SLOT_ROWS`` rows, slots therefore depend on how the table was partitioned.
    * Only doc_id and text are read. An empty table gives an empty result.

    The driver holds ranges, heavy keys (each over 1/32 of a shard's share, so at most 32 a shard)
    and a bounded sample; never rows. Texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    rows = written(measured(docs, doc_id, text), "measured")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = np.array(_boundaries(rows, total, shards * RANGES_PER_SHARD), np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="left").astype(np.int32))

    ranged = written(rows.withColumn("range", range_of("key")), "ranged")  # read several times from here on
    share = max(1.0, total / shards)
    totals = {r.range: r.size for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
    heavy = _heavy_keys(ranged, totals, share / HEAVY)

    units: list[tuple[float, tuple]] = []
    for r, key, size, n in heavy:
        totals[r] -= size
        pieces = 1 if size <= share else min(n, -(-int(size) * 8 // int(share)))
        units += [(size / pieces, ("key", key, p)) for p in range(pieces)]
    units += [(s, ("range", r, 0)) for r, s in totals.items() if s > 0]
    homes = _emptiest_first(units, shards)

    out = ranged.withColumn("shard", F.get(F.array(*[F.lit(homes.get(("range", r, 0), 0)) for r in range(len(cuts) + 1)]), F.col("range")))
    if heavy:
        pieces_of: dict[int, list[int]] = {}
        for (kind, key, _), home in sorted(homes.items()):
            if kind == "key":
                pieces_of.setdefault(key, []).append(home)
        counts = {key: n for _, key, _, n in heavy}
        table = spark.createDataFrame([(k, counts[k], h) for k, h in pieces_of.items()], "hkey bigint, hn bigint, homes array<int>")  # at most HEAVY keys a shard
        met = out.join(F.broadcast(table), F.col("key") == F.col("hkey"), "left")
        # Rows of a heavy key have one size: equal runs of their numbers are equal bytes.
        runs = _numbered(met.filter(F.col("hkey").isNotNull()), "hkey", sum(counts.values())).withColumn("shard", F.get("homes", F.floor(F.col("i") * F.size("homes") / F.col("hn")).cast("int")))
        columns = ["id", "size", "crc", "shard"]
        out = met.filter(F.col("hkey").isNull()).select(*columns).unionByName(runs.select(*columns))
    out = out.select("id", "size", "crc", F.col("shard").cast("int").alias("shard"))
    out = _numbered(out, "shard", count).withColumnRenamed("i", "slot")
    return out.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _heavy_keys(ranged: DataFrame, totals: dict[int, int], least: float) -> list[tuple[int, int, int, int]]:
    """(range, key, bytes, rows) of the keys that hold over ``least`` bytes; only overfull ranges can hold one."""
    overfull = [r for r, size in totals.items() if size > least]
    if not overfull:
        return []
    keys = ranged.filter(F.col("range").isin(overfull)).groupBy("range", "key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return [(r.range, r.key, r.size, r.n) for r in keys.filter(F.col("size") > least).collect()]


def _emptiest_first(units: list[tuple[float, tuple]], shards: int) -> dict[tuple, int]:
    """Largest unit first, each into the shard with the fewest bytes so far."""
    load, homes = [(0.0, s) for s in range(shards)], {}
    for size, unit in sorted(units, key=lambda u: (-u[0], u[1])):
        full, s = heapq.heappop(load)
        homes[unit] = s
        heapq.heappush(load, (full + size, s))
    return homes


def _numbered(rows: DataFrame, group: str, count: int) -> DataFrame:
    """Adds ``i``, from 0 without gaps within every ``group``: rows are numbered in buckets of bounded size, each bucket after the ones before it."""
    buckets = max(1, -(-count // SLOT_ROWS))
    spread = F.xxhash64("id", "crc", F.monotonically_increasing_id())  # rows equal in all columns are dealt out too
    rows = written(rows.withColumn("bucket", F.pmod(spread, F.lit(buckets)).cast("int")), "numbered")
    sizes = rows.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    before = sizes.select(F.col(group).alias("g"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy(group).orderBy("bucket")) - F.col("n")).alias("before"))
    inner = rows.withColumn("at", F.row_number().over(Window.partitionBy(group, "bucket").orderBy("id", "crc", "size")))
    return inner.join(before, (F.col(group) == F.col("g")) & (F.col("bucket") == F.col("b"))).withColumn("i", F.col("before") + F.col("at") - 1)
