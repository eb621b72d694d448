"""Packing: token sequences of a fixed length by bounded-space best fit.

Every partition keeps a fixed number of open windows. A piece goes into the window that it leaves
fullest; if none has room, the fullest window is emitted. What stays open at the end of each
partition is merged afterwards, level by level, in tasks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._common import slices, text_or_empty, written

LENGTH = 1024
OPEN = 64
#: Partitions whose open windows one task merges.
MERGED = 64
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


#: Texts of so many characters are searched for white space runs of that length, which the split pattern can't backtrack through.
LONG_RUN = 100_000
#: The white space of the split pattern, as character class. Fixed values.
BLANK = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@lru_cache
def ranks_of(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks of byte sequences, identifiers of special tokens) of a vocabulary of the ``tokenizers`` library."""
    import json

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(map(to_byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}, added


@lru_cache
def encoder(vocabulary: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """Identifiers of a text by a byte-level BPE vocabulary of the ``tokenizers`` library.

    The ranks of the same merges run in ``tiktoken``, which gives the same identifiers several
    times faster; tests hold the two against each other. The strings of special tokens in a text
    become those tokens, as that library does by default, or with ``special`` false ordinary text.

    The split pattern takes a run of white space as one piece, but for the last character where
    more text follows. Very long runs are cut out that way before the pattern sees the text.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    ranks, added = ranks_of(vocabulary)
    enc = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    allowed = "all" if special else set()
    marks = re.compile("(" + "|".join(map(re.escape, added)) + ")") if special and added else None
    run = re.compile(BLANK + "{" + str(LONG_RUN) + ",}")

    def plain(text: str) -> np.ndarray:
        return enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not run.search(text):
            return plain(text)
        parts = []
        for segment in marks.split(text) if marks else [text]:
            at = 0
            for m in run.finditer(segment):
                end = m.end() if m.end() == len(segment) else m.end() - 1
                parts += [plain(segment[at : m.start()]), np.array(enc._encode_single_piece(segment[m.start() : end]), np.uint32)]
                at = end
            parts.append(plain(segment[at:]))
        return np.concatenate(parts)

    return encode


class Windows:
    """At most ``most`` open windows of ``length`` tokens; place() returns the windows that it closes."""

    def __init__(self, length: int, most: int):
        self.length, self.room, self.held = length, np.full(most, length, np.int64), [[] for _ in range(most)]

    def place(self, piece: tuple, size: int) -> list[list[tuple]]:
        left = self.room - size
        fits = np.where(left >= 0, left, self.length + 1)
        at, closed = int(fits.argmin()), []
        if left[at] < 0:
            at = int(self.room.argmin())
            closed.append(self._close(at))
        self.held[at].append(piece)
        self.room[at] -= size
        if not self.room[at]:
            closed.append(self._close(at))
        return closed

    def _close(self, at: int) -> list[tuple]:
        out, self.held[at], self.room[at] = self.held[at], [], self.length
        return out

    def rest(self) -> list[list[tuple]]:
        return [w for w in self.held if w]


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
    types = [id_type, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=COLUMNS)


def _laid(pieces: list[tuple], sequence: int | None) -> list[tuple]:
    """Rows of one window; without a sequence, of pieces that wait to be merged."""
    rows, at = [], 0
    for doc, start, ids, total in pieces:
        rows.append((doc, start, len(ids) // 4, total, sequence, None if sequence is None else at, ids))
        at += len(ids) // 4
    return rows


def _first_level(vocabulary: str, end: int, length: int, most: int, kind: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(vocabulary), Windows(length, most)
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text), end).astype("<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    for window in windows.place((doc, start, part.tobytes(), len(ids)), len(part)) if len(part) < length else [[(doc, start, part.tobytes(), len(ids))]]:
                        rows += _laid(window, number)
                        number += 1
            yield _batch(rows, kind)
        yield _batch([r for w in windows.rest() for r in _laid(w, None)], kind)

    return pack


def _merge_level(level: int, last: bool, length: int, most: int, kind: pa.DataType):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a task, largest first, into as many windows as a task's open pieces can need; only the last level closes all."""
        pieces = []
        for batch in batches:
            pieces += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
        pieces.sort(key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
        windows = Windows(length, max(1, len(pieces)) if last else min(max(1, len(pieces)), most * MERGED))
        number = (level << 56) | (TaskContext.get().partitionId() << 32)
        done = [w for p in pieces for w in windows.place(p, len(p[2]) // 4)]
        waiting = windows.rest()
        if not last:  # the fuller ones are done, the emptier half of a partition's number waits
            waiting.sort(key=lambda w: sum(len(p[2]) for p in w))
            done, waiting = done + waiting[most:], waiting[:most]
        else:
            done, waiting = done + waiting, []
        rows = [r for i, w in enumerate(done) for r in _laid(w, number + i)] + [r for w in waiting for r in _laid(w, None)]
        yield _batch(rows, kind)

    return merge


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, open_windows: int = OPEN, end: int = 0) -> DataFrame:
    """Pieces of every document: doc_id, start, length, doc_tokens, sequence_id, offset and ids (unsigned 32-bit, little-endian).

    A document is its identifiers and ``end``. It is cut at multiples of ``length``; whole parts
    are sequences of their own and the rest is packed uncut. Within a sequence offsets have no gap.

    * Null or empty text: the end identifier alone. Repeated rows and null doc_ids: each row is a
      document of its own, so with repeated doc_ids (doc_id, start) may repeat.
    * Other columns are not read. An empty table gives an empty result.

    A partition holds at most ``open_windows`` windows and a merging task those of 64
    partitions. Every level is written to the shared folder before it is read again.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    kind = to_arrow_type(docs.schema[doc_id].dataType)
    schema = f"doc_id {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    src = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    source = written(src.mapInArrow(_first_level(vocabulary, end, length, open_windows, kind), schema).withColumn("task", F.spark_partition_id()), "packed")
    done = [source.filter(F.col("sequence_id").isNotNull())]
    tasks, level = (source.agg(F.max("task")).first()[0] or 0) + 1, 0
    while True:
        level, groups = level + 1, -(-tasks // MERGED)
        waiting = source.filter(F.col("sequence_id").isNull()).select("doc_id", "start", "ids", "doc_tokens", F.floor(F.col("task") / MERGED).cast("int").alias("g"))
        dealt = waiting.repartitionById(groups, "g")
        source = written(dealt.mapInArrow(_merge_level(level, groups == 1, length, open_windows, kind), schema).withColumn("task", F.spark_partition_id()), "merged")
        done.append(source.filter(F.col("sequence_id").isNotNull()))
        if groups == 1:
            break
        tasks = groups
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").alias(doc_id), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
