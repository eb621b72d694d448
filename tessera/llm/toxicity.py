"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded texts.

Words and beginnings of words get weights from labelled documents: the logarithm of how much
likelier a toxic document holds them. Phrases around them that clean documents use are exceptions.
All patterns run through a text in one automaton, the longest one that begins first counting; the
sum of weights, alone and by length, gives the score through a logistic curve.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import slices, text_or_empty, written

#: Labelled rows that the model is fitted on, at most; those whose doc_ids hash lowest.
TRAINED = 40_000
#: Patterns of the lexicon and of its exceptions, at most.
PATTERNS, EXCEPTIONS = 5000, 5000
#: Beginnings of words of so many characters may be patterns.
SHORTEST, LONGEST = 4, 8
#: A pattern's log-odds less so many standard errors must reach LEAST.
ERRORS, LEAST = 1.64, 1.0
#: An exception is in so many clean documents at least, and its log-odds are below zero.
CLEAN = 3
#: Documents are cut into so many folds by the CRC-32 of their id; the first is held out, the last calibrates.
FOLDS = 5
SHINGLE = 5
#: Letters of other scripts that look like Latin ones. Fixed values.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
#: Digits and signs that stand for letters. Fixed values.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): str(i) for i in range(10)} | dict.fromkeys("\u00ad\u200b\u200c\u200d\u2060\ufeff"))
_LETTER_FOR = str.maketrans(STANDS_FOR)
_MIXED = re.compile(r"(?<=[^\W\d_])(?:[0134578]+(?![\d])|[@$!](?=[^\W\d_]))|(?<![\w])[0134578]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> list[str]:
    """The words of a text, lowered, with lookalikes as the Latin letters, and digits and signs within words as the letters that they stand for."""
    return _WORD.findall(_MIXED.sub(lambda m: m[0].translate(_LETTER_FOR), text.lower().translate(_FOLD)))


def _line(words: list[str]) -> str:
    """Every word between two blanks of its own, so that patterns of neighbours don't overlap."""
    return f" {'  '.join(words)} "


class Model(NamedTuple):
    """Patterns with weights (exceptions weigh 0), and the curve's coefficients: constant, log of the sum, sum by length."""

    weights: dict[str, float]
    curve: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            made.add_word(pattern, (len(pattern), weight))
        made.make_automaton()
        return made


def _measured(automaton, words: list[str]) -> tuple[float, float]:
    """(logarithm of 1 + the sum of weights, the sum for a word); short texts count as 20 words more."""
    total = sum(w for _, (_, w) in automaton.iter_long(_line(words))) if len(automaton) else 0.0
    return float(np.log1p(total)), total / (len(words) + 20)


def _sketch(words: list[str]) -> int:
    """The least CRC-32 of five-word shingles, by which near copies mostly agree."""
    if len(words) <= SHINGLE:
        return zlib.crc32(" ".join(words).encode())
    return min(zlib.crc32(" ".join(words[i : i + SHINGLE]).encode()) for i in range(len(words) - SHINGLE + 1))


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def training(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAINED) -> DataFrame:
    """(toxic, calibrates, words): labelled documents outside the held-out fold, ``most`` at most, one of every group that agrees in label and sketch.

    A doc_id with several labels is toxic if one of them says so. The labels that are used are few,
    so they meet the documents by broadcast and no text moves until copies are grouped.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (_fold(F.col(doc_id)) != 0)).groupBy(F.col(doc_id).alias("__id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    chosen = written(known.orderBy(F.xxhash64("__id"), "__id").limit(most), "labels")  # at most ``most`` rows
    src = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id"))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [folded(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(map(_sketch, words), pa.int64()), pa.array(map(" ".join, words), pa.string())], names=["id", "toxic", "sketch", "words"])

    rows = src.select("id", "toxic", "text").mapInArrow(fold, f"id {id_type}, toxic int, sketch bigint, words string")
    one = rows.groupBy("toxic", "sketch").agg(F.min(F.struct("id", "words")).alias("r"))
    return written(one.select("toxic", (_fold(F.col("r.id")) == FOLDS - 1).alias("calibrates"), F.col("r.words").alias("words")), "training")


def _odds(df: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Adds ``odds``, the log-odds of a toxic document for a term in n1 toxic and n0 clean ones, and ``error``."""
    part = lambda n, of: F.log((F.col(n) + 0.5) / (of + 1.0))
    return df.withColumns({"odds": part("n1", sizes.get(1, 0)) - part("n0", sizes.get(0, 0)), "error": F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))})


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """(term, n1, n0): how many toxic and clean rows have a term of ``terms_of`` their words; every batch is counted before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = terms_of()
        for batch in slices(batches, "words"):
            found = (Counter(), Counter())
            for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
                found[toxic].update(terms(words.split(" ") if words else []))
            both = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *[pa.array([found[k][t] for t in both], pa.int64()) for k in (1, 0)]], names=["term", "n1", "n0"])

    return rows.select("toxic", "words").mapInArrow(count, "term string, n1 bigint, n0 bigint").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _beginnings():
    def terms(words: list[str]) -> set[str]:
        own = set(words)
        return {f" {w} " for w in own} | {f" {w[:k]}" for w in own for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}

    return terms


def _around(model: Model):
    """Of every word that a pattern matches: the word, it with the word before, and with the word after."""

    def build():
        automaton = model.automaton()

        def terms(words: list[str]) -> set[str]:
            out, at, number = set(), 0, {}
            for i, w in enumerate(words):
                number[at] = i
                at += len(w) + 2
            for end, (size, _) in automaton.iter_long(_line(words)):
                i = number[end - size + 1]
                out |= {_line(words[i : i + 1]), _line(words[max(0, i - 1) : i + 1]), _line(words[i : i + 2])}
            return out

        return terms

    return build


def _fitted(cells: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
    """Logistic regression on cells (x, y, toxic rows, clean rows) by Newton steps with a small ridge."""
    x = np.array([[1.0, a, b] for a, b, _, _ in cells])
    pos, neg = (np.array([c[k] for c in cells], np.float64) for k in (2, 3))
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        n = pos + neg
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(3), x.T @ (pos - n * p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, beta))


def fit(rows: DataFrame) -> Model:
    """The model of ``training`` rows. Lexicon and exceptions come from the rows that don't calibrate, the curve from those that do; where either kind lacks a class, no text has a hit and all share one score."""
    made = {False: {}, True: {}}
    for r in rows.groupBy("calibrates", "toxic").count().collect():  # four rows
        made[r.calibrates][r.toxic] = r["count"]
    total = {k: made[False].get(k, 0) + made[True].get(k, 0) for k in (0, 1)}
    flat = float(np.log(total[1] / total[0])) if total[0] and total[1] else 30.0 if total[1] else -30.0
    if any(len(m) < 2 for m in made.values()):
        return Model({}, (flat, 0.0, 0.0))
    learning = rows.filter(~F.col("calibrates"))
    sure = F.col("odds") - ERRORS * F.col("error")
    terms = _odds(_counted(learning, _beginnings), made[False]).filter((sure >= LEAST) & (F.col("n1") >= CLEAN)).orderBy(sure.desc(), "term").limit(PATTERNS)
    weights = {r.term: r.odds for r in terms.select("term", "odds").collect()}  # at most PATTERNS rows
    if not weights:
        return Model({}, (flat, 0.0, 0.0))
    phrases = _odds(_counted(learning, _around(Model(weights, (0.0, 0.0, 0.0)))), made[False]).filter((F.col("odds") < 0) & (F.col("n0") >= CLEAN)).orderBy("odds", "term").limit(EXCEPTIONS)
    weights |= {r.term: 0.0 for r in phrases.select("term").collect()}  # at most EXCEPTIONS rows
    model = Model(weights, (0.0, 0.0, 0.0))
    cells = measures(rows.filter("calibrates"), model).groupBy(F.round("x", 1).alias("x"), F.round(F.col("y") * 20).alias("b")).agg(F.avg("y").alias("y"), F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).orderBy("x", "b")
    found = [(r.x, r.y, r.n1, r.n0) for r in cells.limit(10_000).collect()]  # rounded, so a few hundred cells
    return Model(weights, _fitted(found))


def measures(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, x, y) of ``training`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in slices(batches, "words"):
            found = [_measured(automaton, w.split(" ") if w else []) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]], names=["toxic", "x", "y"])

    return rows.select("toxic", "words").mapInArrow(run, "toxic int, x double, y double")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; nothing but the text enters the score, and no row moves.

    * Null or empty text: the score of a text without hits. held_out is false for a null doc_id,
      which has no label either. Repeated rows are scored one by one. Only doc_id and text are read,
      so other columns may have any name. An empty table gives none.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, (constant, first, second) = model.automaton(), model.curve
        for batch in slices(batches):
            found = np.array([_measured(automaton, folded(t)) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(constant + found @ np.array([first, second]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p)], names=["id", "score"])

    src = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    scored = src.mapInArrow(run, f"id {id_type}, score double")
    held_out = F.coalesce(_fold(F.col("id")) == 0, F.lit(False))
    return scored.select(F.col("id").alias(doc_id), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``score`` of every row of ``docs`` by the model of ``labels`` (doc_id, ``label`` 0 or 1). Labels of the held-out fold are never read; without labels all rows score next to 0."""
    return score(docs, fit(training(docs, labels, doc_id, text, label)), doc_id, text)
