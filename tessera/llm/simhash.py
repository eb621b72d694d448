"""SimHash near-dedup with covering locality-sensitive hashing.

For radius r the 64 bit positions get vectors of r + 1 bits; each of the 2^(r+1) - 1 non-zero
vectors v gives a table whose mask holds the positions whose vector has an odd product with v.
The positions in which two fingerprints within the radius differ span at most r dimensions, so
some v is orthogonal to all of them: in that table the two agree on the whole mask and collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ascii_lower, text_or_empty, words, written
from tessera.llm._components import components

SHINGLE = 4
RADIUS = 4
#: A bucket with more fingerprints is compared in pairs of tiles, each pair a group of its own.
TILE = 1 << 14


def masks(radius: int) -> list[int]:
    """The covering masks; positions take the non-zero vectors in turn, so every mask holds about half of the 64 bits."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: For each byte, its eight bits in eight lanes of eight bits.
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each slice hashes[offsets[i]:offsets[i+1]]; bits set in over half of its hashes. Empty slices give zero.

    Up to 255 hashes are counted in the byte lanes of 64-bit words, then the lanes are summed.
    """
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(offsets[full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    lo, octets = offsets[0], np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    packed = np.zeros((len(full), 8), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[lo : offsets[-1], k]], starts - lo)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        packed[:, k] = np.packbits(2 * counts > n[full][:, None], axis=1, bitorder="little")[:, 0]
    out[full] = packed.view("<u8")[:, 0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("h")
        offsets = hashes.offsets.to_numpy().astype(np.int64)
        prints = majority_bits(hashes.values.to_numpy(zero_copy_only=False).view(np.uint64), offsets)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row: fp is the 64-bit SimHash as a signed bigint.

    Shingles are hashed by Spark (XXH64, seed 42, over UTF-8); Python only counts bits of the
    hashes. Texts with fewer words than ``shingle`` have one shingle; without words, fp is 0.
    """
    src = docs.select(F.col(doc_id).alias("id"), words(ascii_lower(text_or_empty(text))).alias("w"))
    n = F.size("w")
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(shingle)])))
    h = F.when(n == 0, F.array().cast("array<bigint>")).when(n <= shingle, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(many)
    id_type = docs.schema[doc_id].dataType.simpleString()
    return src.select("id", h.alias("h")).mapInArrow(_fingerprint_batches, f"id {id_type}, fp bigint")


def _spanning(fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links within one bucket: each fingerprint is compared with those not yet reached."""
    left, right, rest = [], [], fp
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = []
            for x in front:
                near = np.bitwise_count(rest ^ x) <= radius
                if near.any():
                    found.append(rest[near])
                    left.append(found[-1])
                    right.append(np.full(len(found[-1]), x))
                    rest = rest[~near]
                    if not len(rest):
                        break
            front = np.concatenate(found) if found else rest[:0]
    return left, right


def bucket_links(table: np.ndarray, fp: np.ndarray, tiles: np.ndarray, masked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal (table, masked key, tiles); rows come in that order."""
    new = np.ones(len(fp), bool)
    new[1:] = (table[1:] != table[:-1]) | (masked[1:] != masked[:-1]) | (tiles[1:] != tiles[:-1])
    starts = np.append(np.flatnonzero(new), len(fp))
    sizes = np.diff(starts)
    group = np.cumsum(new) - 1
    left, right = [], []
    small = sizes[group] <= 16
    for d in range(1, min(16, int(sizes.max(initial=1)))):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        near = np.bitwise_count(fp[i] ^ fp[i + d]) <= radius
        left.append(fp[i[near]])
        right.append(fp[i[near] + d])
    for g in np.flatnonzero(sizes > 16):
        a, b = _spanning(fp[starts[g] : starts[g + 1]], radius)
        left += a
        right += b
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between different values of ``fp`` that join the same components as all pairs within ``radius`` bits.

    ``prints`` holds each fingerprint once. No bucket is capped: small ones are compared in
    full, larger ones by growing from what is reached already. A bucket over ``tile`` rows is only
    named by the task that meets it; its rows are then cut into tiles of which every pair is
    compared by itself, so no task holds more than two tiles.
    """
    table_masks = np.array(masks(radius), np.uint64)
    tables = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(int(m)))).alias("k")) for t, m in enumerate(table_masks)])
    rows = prints.select("fp", F.inline(tables))
    first = written(_linked(rows.withColumn("p", F.lit(0)), table_masks, radius, tile), "near")
    heavy = first.filter(F.col("t").isNotNull()).select("t", "k")
    links = first.filter(F.col("t").isNull()).select("a", "b")
    if heavy.isEmpty():
        return links
    held = written(rows.join(heavy, ["t", "k"]), "heavy-rows")
    sizes = written(held.groupBy("t", "k").agg(F.ceil(F.count("*") / tile).cast("int").alias("n")), "heavy-buckets")
    own = F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(own, j) * F.lit(1 << 15) + F.greatest(own, j))
    tiled = held.join(sizes, ["t", "k"]).select("t", "k", "fp", F.explode(pairs).alias("p"))
    return links.unionByName(_linked(tiled, table_masks, radius, None).select("a", "b"))


def _linked(rows: DataFrame, table_masks: np.ndarray, radius: int, most: int | None) -> DataFrame:
    """(a, b) of the links within equal (t, k, p) of ``rows``, and (t, k), with a and b null, of groups over ``most`` rows, which aren't compared."""
    dealt = rows.repartition("t", "k", "p").sortWithinPartitions("t", "k", "p").select("t", "fp", "p")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, fp, p = np.empty(0, np.int16), np.empty(0, np.uint64), np.empty(0, np.int32)
        passed = None  # the group that is too large
        for batch in _with_end(batches):
            if batch is not None:
                t, fp, p = (np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False).view(old.dtype)]) for old, c in ((t, "t"), (fp, "fp"), (p, "p")))
            if not len(fp):
                continue
            k = fp & table_masks[t]
            if passed is not None:
                here = (t == passed[0]) & (k == passed[1])
                t, fp, p, k = t[~here], fp[~here], p[~here], k[~here]
                if not len(fp):
                    continue
            new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1]))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            large = starts[sizes > most] if most is not None else starts[:0]
            if len(large):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(large), pa.int64()), pa.nulls(len(large), pa.int64()), pa.array(t[large]), pa.array(k[large].view(np.int64))], names=["a", "b", "t", "k"])
                passed = (t[large[-1]], k[large[-1]])
                fits = np.repeat(sizes <= most, sizes)
                t, fp, p, k = t[fits], fp[fits], p[fits], k[fits]
            end = len(fp)
            if batch is not None and end:  # the last group may go on in the next batch
                differs = np.flatnonzero((t != t[-1]) | (k != k[-1]) | (p != p[-1]))
                end = int(differs[-1]) + 1 if len(differs) else 0
            if end:
                a, b = bucket_links(t[:end], fp[:end], p[:end], k[:end], radius)
                a, b = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int16()), pa.nulls(len(a), pa.int64())], names=["a", "b", "t", "k"])
                t, fp, p = t[end:], fp[end:], p[end:]

    return dealt.mapInArrow(link, "a bigint, b bigint, t smallint, k bigint")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    Texts link where their fingerprints differ in at most ``radius`` bits; all such links count.

    * Null, empty or blank text: fingerprint zero, linked like any other.
    * Rows that repeat a doc_id are rows of their own. A null doc_id takes part, but is never the
      smallest; component_id is null only where a component holds no other.
    * Only doc_id and text are read. An empty table gives an empty result.

    Equal fingerprints are one node from the start, so thousands of copies cost one row; links
    and components stay in Spark. Aggregates are written before they are joined, so that a large
    component's or a common fingerprint's rows can be split over tasks.
    """
    prints = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = written(components(near_links(nodes.select("fp"), radius)), "roots")
    tied = written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "tied")
    least = written(tied.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    label = written(tied.join(least, "root").select(F.col("fp").alias("__fp"), "component_id"), "labels")
    return prints.join(label, F.col("fp") == F.col("__fp")).select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
