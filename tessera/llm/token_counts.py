"""Token counts of flat, unindexed token files by a separator scan.

A file is a run of token identifiers, of 16 bits or of 32 where the vocabulary needs them, in which an end-of-document identifier closes every
document; nothing says where documents begin. Files are read in blocks; each block is searched
for separators with numpy, and a prefix scan over the blocks stitches documents that cross them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._common import slices, text_or_empty, written

BLOCK_TOKENS = 1 << 16
SUPER = 1024  # blocks scanned together in the lower level of the prefix scan


def width_of(vocabulary: str, separator: int) -> int:
    """Bytes of an identifier in flat files: 2, or 4 where one doesn't fit."""
    from tessera.llm.packing import ranks_of

    ranks, added = ranks_of(vocabulary)
    return 2 if max(separator, *ranks.values(), *added.values()) < 1 << 16 else 4


def flat_blocks(docs: DataFrame, vocabulary: str, separator: int, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokens of ``docs`` as flat files, one per partition: (file, block, payload) and, for checking only, (file, ordinal, doc_id) rows with payload null.

    Identifiers have ``width_of`` bytes. Blocks are cut every ``block_tokens`` identifiers wherever documents end. Texts that spell
    the separator are ordinary text. Null text: no tokens, only its separator.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    kind = to_arrow_type(docs.schema[doc_id].dataType)
    code = f"<u{width_of(vocabulary, separator)}"

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.packing import encoder

        encode = encoder(vocabulary, special=False)
        file, block, ordinal, rest, held = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in slices(batches):
            ids = batch.column("id")
            yield out([file] * len(ids), [None] * len(ids), range(ordinal, ordinal + len(ids)), ids, [None] * len(ids))
            ordinal += len(ids)
            for value in batch.column("text").to_pylist():
                part = np.append(encode(value), separator).astype(code)
                rest.append(part)
                held += len(part)
            if held >= block_tokens:
                flat = np.concatenate(rest)
                n = held // block_tokens
                cut = [flat[i * block_tokens : (i + 1) * block_tokens].tobytes() for i in range(n)]
                yield out([file] * n, range(block, block + n), [None] * n, None, cut)
                block, rest, held = block + n, [flat[n * block_tokens :]], held - n * block_tokens
        if held:
            yield out([file], [block], [None], None, [np.concatenate(rest).tobytes()])

    def out(file, block, ordinal, ids, payload) -> pa.RecordBatch:
        ids = pa.nulls(len(payload), kind) if ids is None else ids
        return pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), pa.array(block, pa.int64()), pa.array(ordinal, pa.int64()), ids, pa.array(payload, pa.binary())], names=["file", "block", "ordinal", "id", "payload"])

    src = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    return src.mapInArrow(flatten, f"file bigint, block bigint, ordinal bigint, id {id_type}, payload binary")


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, block, payload) of token files on disk, each cut into blocks of ``block_tokens`` identifiers of ``width`` bytes.

    Spark lists the files; every block is then a byte range that a task reads by itself, so a file
    of any length is spread over tasks and none is held whole. Folders are reached by pyarrow's
    file systems (local paths, hdfs, s3, gs). An empty file has no blocks.
    """
    size = width * block_tokens
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    blocks = files.filter("length > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if opened is None or opened[0] != file:
                    system, at = fs.FileSystem.from_uri(file)
                    opened = (file, system.open_input_file(at))
                opened[1].seek(block * size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([opened[1].read(size)], pa.binary())], names=["file", "block", "payload"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(tasks, "file", F.floor(F.col("block") / 16)).mapInArrow(read, "file string, block bigint, payload binary")


def _scan(separator: int, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lasts, sizes, inner = [], [], [], [np.empty(0, np.int64)]
            for payload in batch.column("payload"):
                tokens = np.frombuffer(payload.as_buffer(), f"<u{width}")
                ends = np.flatnonzero(tokens == separator)
                sizes.append(len(tokens))
                firsts.append(int(ends[0]) if len(ends) else None)
                lasts.append(int(ends[-1]) if len(ends) else None)
                inner.append(np.diff(ends) - 1)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in inner]), pa.int32()), pa.array(np.concatenate(inner), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), lists], names=["file", "block", "size", "first", "last", "inner"])

    return scan


def _prefix(blocks: DataFrame) -> DataFrame:
    """Adds, for every block: ``begin`` (tokens before it), ``docs`` (separators before it) and ``open`` (position after the last separator before it).

    The scan has two levels, blocks within a super-block and super-blocks within a file, so no
    task holds all blocks of a large file.
    """
    sup = blocks.withColumn("sup", F.floor(F.col("block") / SUPER))
    w = Window.partitionBy("file", "sup").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.size("inner") + 1)
    inside = sup.withColumn("ends", ends).withColumns({"b": F.coalesce(F.sum("size").over(w), F.lit(0)), "d": F.coalesce(F.sum("ends").over(w), F.lit(0))})
    inside = inside.withColumn("o", F.max(F.col("b") + F.col("last") + 1).over(w))
    tops = inside.groupBy("file", "sup").agg(F.sum("size").alias("size"), F.sum("ends").alias("ends"), F.max(F.col("b") + F.col("last") + 1).alias("o"))
    v = Window.partitionBy("file").orderBy("sup").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumns({"tb": F.coalesce(F.sum("size").over(v), F.lit(0)), "td": F.coalesce(F.sum("ends").over(v), F.lit(0))})
    tops = tops.withColumn("to", F.coalesce(F.max(F.col("tb") + F.col("o")).over(v), F.lit(0))).select("file", "sup", "tb", "td", "to")
    joined = inside.join(tops, ["file", "sup"])
    return joined.select("file", "block", "size", "first", "last", "inner", (F.col("tb") + F.col("b")).alias("begin"), (F.col("td") + F.col("d")).alias("docs"), F.coalesce(F.col("tb") + F.col("o"), F.col("to")).alias("open"))


def count_tokens(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens): tokens of every document of every file, without its separator.

    * Two separators in a row: a document of no tokens. Tokens after a file's last separator are
      a last document without one. An empty file has no documents.
    * A separator that doesn't fit ``width`` bytes is an error.
    * ``blocks`` has file, block (counted from 0 in the file's order) and payload; other columns
      are not read.
    """
    if not 0 <= separator < 1 << 8 * width:
        raise ValueError(f"the separator {separator} doesn't fit {width} bytes")
    file_type = blocks.schema["file"].dataType.simpleString()
    scanned = blocks.select("file", "block", "payload").mapInArrow(_scan(separator, width), f"file {file_type}, block bigint, size bigint, first bigint, last bigint, inner array<bigint>")
    at = _prefix(written(scanned, "separators"))
    head = F.array(F.col("begin") + F.col("first") - F.col("open"))
    closed = at.filter(F.col("first").isNotNull()).select("file", "docs", F.posexplode(F.concat(head, "inner")).alias("i", "n_tokens")).select("file", (F.col("docs") + F.col("i")).alias("ordinal"), "n_tokens")
    ends = F.when(F.col("first").isNotNull(), F.col("docs") + F.size("inner") + 1).otherwise(F.col("docs"))
    after = F.when(F.col("last").isNotNull(), F.col("begin") + F.col("last") + 1).otherwise(F.col("open"))
    tail = at.groupBy("file").agg(F.max(ends).alias("ordinal"), (F.max(F.col("begin") + F.col("size")) - F.max(after)).alias("n_tokens")).filter(F.col("n_tokens") > 0)
    return closed.unionByName(tail.select("file", "ordinal", "n_tokens"))


def document_tokens(docs: DataFrame, vocabulary: str, separator: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``: flat files are written, scanned as if nothing were known of them, and met with the order of the documents.

    Null or empty text: 0. Repeated rows and null doc_ids: each row is a document of its own.
    Only doc_id and text are read. An empty table gives an empty result.
    """
    flat = written(flat_blocks(docs, vocabulary, separator, doc_id, text), "flat-tokens")
    counts = count_tokens(flat.filter(F.col("payload").isNotNull()), separator, width_of(vocabulary, separator))
    order = flat.filter(F.col("ordinal").isNotNull()).select(F.col("file").alias("f"), F.col("ordinal").alias("o"), F.col("id"))
    return counts.join(order, (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o"))).select(F.col("id").alias(doc_id), "n_tokens")
