"""Line dedup: lines that many documents share are dropped from all of them but one.

Explode the normalised lines, hash them, count distinct documents per hash, drop the lines
over the threshold and reassemble each text by line position. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WHITE, ascii_lower, text_or_empty, unclashing, written

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashes(key: Column) -> list[Column]:
    """128 bits of the key; the salt of the second half makes the two independent."""
    return [F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit("line"), key).alias("__h2")]


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped and kept_text.

    A line's key is the line without white space at both ends and with A-Z lowered. A key of
    at least ``min_chars`` code points that occurs in at least ``min_documents`` documents is
    dropped everywhere, except in the largest doc_id that holds it (all its lines there stay).

    * Null or empty text: one empty line. A text that loses all lines becomes empty.
    * Documents are counted by distinct doc_id, so a repeated row counts once; each repeated
      row is returned. A null doc_id counts as no document and never is the largest, but
      loses shared lines like any other.
    * Columns other than the two named are not read. An empty table gives an empty result.
    * The columns named in ``carry`` are returned too, each row's own; a name that clashes is an error.

    Only hashes of lines, never lines, are shuffled for the count; the partial counts are
    combined before each shuffle, so a line that a third of all documents hold stays cheap.
    """
    unclashing(carry, doc_id, "n_lines", "n_dropped", "kept_text")
    src = docs.select(F.col(doc_id).alias("__id"), text_or_empty(text).alias("__text"), *carry)
    whole = [h.alias(n) for h, n in zip(_hashes(F.col("__text")), ("__t1", "__t2"), strict=True)]
    lines = F.split("__text", "\n", -1)
    long_keys = F.array_distinct(F.filter(F.transform(lines, _key), lambda k: F.char_length(k) >= min_chars))
    holders = src.select("__id", F.explode(long_keys).alias("__k")).select("__id", *_hashes(F.col("__k")))
    shared = (
        holders.groupBy("__h1", "__h2")
        .agg(F.countDistinct("__id").alias("__n"), F.max("__id").alias("__keeper"))
        .filter(F.col("__n") >= min_documents)
        .select("__h1", "__h2", "__keeper")
    )
    shared = written(shared, "shared-lines")  # its size is known from here on, and the join below may split hot lines
    placed = (
        src.select("__id", *whole, F.posexplode(F.transform(lines, _key)).alias("__pos", "__k"))
        .filter(F.char_length("__k") >= min_chars)
        .select("__id", "__t1", "__t2", "__pos", *_hashes(F.col("__k")))
    )
    losses = (
        placed.join(shared, ["__h1", "__h2"])
        .filter(F.col("__id").isNull() | (F.col("__id") != F.col("__keeper")))
        .groupBy(F.col("__id").alias("__lid"), F.col("__t1").alias("__l1"), F.col("__t2").alias("__l2"))
        .agg(F.collect_set("__pos").alias("__lost"))
    )
    joined = src.select("*", *whole).join(losses, F.col("__id").eqNullSafe(F.col("__lid")) & (F.col("__t1") == F.col("__l1")) & (F.col("__t2") == F.col("__l2")), "left")
    split = joined.select("__id", "__lost", lines.alias("__lines"), *carry)
    # The lines are bound within the expression: where a filter on the result moves down, they'd else be split again for each line.
    left = lambda b: F.transform(F.array_except(F.sequence(F.lit(0), F.size(b["lines"]) - 1), b["lost"]), lambda p: F.get(b["lines"], p))
    bound = F.array(F.struct(F.col("__lines").alias("lines"), F.col("__lost").alias("lost")))
    kept = F.when(F.col("__lost").isNull(), F.col("__lines")).otherwise(F.get(F.transform(bound, left), F.lit(0)))
    return split.select("__id", F.size("__lines").cast("long").alias("n_lines"), kept.alias("__kept"), *carry).select(
        F.col("__id").alias(doc_id),
        "n_lines",
        (F.col("n_lines") - F.size("__kept")).alias("n_dropped"),
        F.array_join("__kept", "\n").alias("kept_text"),
        *carry,
    )
