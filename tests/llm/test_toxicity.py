import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as tx

LABELS = "doc_id bigint, toxic int, quality int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def first_longest(patterns, line):
    """Leftmost and longest matches that don't overlap, tried at every place."""
    at, total = 0, 0.0
    while at < len(line):
        fits = [p for p in patterns if line.startswith(p, at)]
        if fits:
            best = max(fits, key=len)
            total += patterns[best]
            at += len(best)
        else:
            at += 1
    return total


def test_lookalikes_and_digits_fold():
    assert tx.folded("You are an 1d10t, ｉｄｉｏｔ, іdіоt or id​iot; tr@sh l0s3r!!") == "you are an idiot idiot idiot or idiot trash loser".split()
    assert tx.folded("On 2024-05-01 cost 100$ 7 x$$$ word!! café") == ["on", "2024", "05", "01", "cost", "100", "7", "x", "word", "café"]
    assert tx.folded("") == tx.folded(" .,!\n") == []


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("ab"), int(rng.integers(1, 4))))
    patterns = {f" {word()}": 1.5 for _ in range(4)} | {f" {word()} ": 2.5 for _ in range(4)} | {f" {word()}  {word()} ": 0.0 for _ in range(5)}
    model = tx.Model(patterns, (0.0, 0.0, 0.0))
    for _ in range(50):
        words = [word() for _ in range(int(rng.integers(0, 12)))]
        total = first_longest(patterns, tx._line(words))
        assert tx._measured(model.automaton(), words) == pytest.approx((np.log1p(total), total / (len(words) + 20)))


def test_weights_and_exceptions_are_learnt(spark):
    filler = lambda i: [f"w{(i * 7 + j * j) % 997}" for j in range(40)]
    texts = []
    for i in range(1200):
        w = filler(i)
        if i % 4 == 0:
            w[5], w[20] = "nasty" + "abc"[i % 3], "nasty" + "abc"[i % 3]
        elif i % 5 == 0:
            w[9:11] = ["nasty", "weather"] if i % 2 else ["nastyb", "plant"]  # what clean documents say
        texts.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, t, 1) for i, _, t in texts], LABELS)
    model = tx.fit(tx.training(docs, labels))
    assert model.weights[" nastyb "] > 0 and model.weights[" nastyb  plant "] == 0.0
    got = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in texts)
    assert np.mean([got[i].predicted == t for i, _, t in texts if got[i].held_out]) > 0.98
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(tx.toxicity(docs, turned)) == rows_of(tx.toxicity(docs, labels))  # labels held out aren't read
    masked = spark.createDataFrame([(1, "so n@styb and nаsty8 it is"), (2, "a nastyb plant stands")], "doc_id bigint, text string")
    worst, plant = (r.score for r in tx.score(masked, model).orderBy("doc_id").collect())
    assert worst > 0.5 > plant


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = tx.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    order = np.argsort(np.argsort([r.score for r in found])) + 1
    toxic = np.array([r.toxic for r in found]) == 1
    area = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    predicted = np.array([r.predicted for r in found]) == 1
    assert area > 0.94 and predicted[toxic].mean() > 0.9 and predicted[~toxic].mean() < 0.01


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, 1, 0), (None, 1, 1), (4, None, 1), (999, 1, 1)], LABELS)
    got = tx.toxicity(odd, labels).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r.doc_id) for r in odd.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert tx.toxicity(none, labels).count() == 0


@pytest.mark.parametrize("given,least,most", [([], 0, 0.01), ([(i, 0, 0) for i in range(20)], 0, 0.01), ([(i, 1, 0) for i in range(20)], 0.99, 1)])
def test_labels_of_one_class_or_none(spark, odd, given, least, most):
    got = tx.toxicity(odd, spark.createDataFrame(given, LABELS)).collect()
    assert got and all(least <= r.score <= most for r in got)


def test_copies_teach_once(spark):
    text = "strange words here that only one document has " * 3
    docs = spark.createDataFrame([(i, text) for i in range(500)] + [(1000 + i, f"plain document number {i} with other words {i * i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(500)] + [(1000 + i, 0, 1) for i in range(200)], LABELS)
    rows = tx.training(docs, labels).groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in rows}[1] == 1
