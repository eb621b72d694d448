"""Batches of queries: names by grams, vectors in tiles, both against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.operators import store as st
from tessera.plans import batch, tables
from tessera.schema import struct_of


def store_of(spark, chunks):
    """A store whose chunks (id, name, kind, embedding) are visible in repository 1."""
    fields = struct_of("chunks")
    rows = [tuple({"id": i, "blob_sha": f"b{i}", "file_path": f"{i}.py", "kind": kind, "name": name, "content": "", "content_tokens": "", "name_tokens": "", "embedding": v}.get(f.name) for f in fields) for i, name, kind, v in chunks]
    s = tables.empty(spark)
    shots = spark.createDataFrame([(1, "head", f"{i}.py", f"b{i}", "python") for i, *_ in chunks], struct_of("file_snapshots"))
    return s.but(chunks=spark.createDataFrame(rows, fields), file_snapshots=shots), spark.createDataFrame([(1, "head")], "repo_id int, snapshot_sha string")


def test_names_by_grams_are_those_of_like(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abAB_é%\\x"), n))
    names = sorted({word(int(rng.integers(1, 9))) for _ in range(150)} | {"", "Chunk", "make_chunk", "ÉCOLE"})
    s, refs = store_of(spark, [(f"{i:03}", n, "function", None) for i, n in enumerate(names)])
    texts = ["", "a", "%", "_", "a%b", "ab", "aB_", "chunk", "école", "%%x", "\\", "none at all", "unk", "__", None, "x%é_a"] + [word(3) for _ in range(12)]
    asked = spark.createDataFrame(list(enumerate(texts)), "query bigint, text string")
    got = {}
    for r in batch.named_many(s, refs, asked).collect():
        got.setdefault(r["query"], set()).add(r.id)
    for i, t in enumerate(texts):
        rows = retrieval.name_tiers(spark.createDataFrame([(f"{j:03}", n) for j, n in enumerate(names)], "id string, name string"), t or "").collect()
        best = min((r.match_tier for r in rows), default=0)
        assert got.get(i, set()) == {r.id for r in rows if r.match_tier == best}, t


def test_a_gram_joins_and_nothing_meets_all(spark):
    s, refs = store_of(spark, [(f"{i:03}", f"name{i}", "function", None) for i in range(50)])
    plan = batch.named_many(s, refs, spark.createDataFrame([(1, "ame1")], "query bigint, text string"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def brute(vectors, queries, k):
    out = {}
    for q, vs in queries:
        scores = []
        for i, v in vectors:
            if v is not None and np.linalg.norm(v) > 0:
                best = max(round(float(np.dot(v, w) / np.linalg.norm(v) / max(np.linalg.norm(w), 1e-300)), 9) for w in vs)
                scores.append((-best, i))
        out[q] = [(i, -b) for b, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("k,part", [(3, 1 << 14), (7, 4)])
def test_vectors_in_tiles_against_brute_force(spark, monkeypatch, k, part):
    monkeypatch.setattr(batch, "TILE", 8)
    monkeypatch.setattr(batch, "MATRIX", part)
    rng = np.random.default_rng(k)
    vectors = [(f"{i:03}", rng.integers(-1, 2, 3).astype(float).tolist() if i % 11 else None) for i in range(90)]  # many are equal or zero
    s, refs = store_of(spark, [(i, "n", "function", v) for i, v in vectors])
    s = s.but(chunks=s.chunks.repartition(3))
    queries = [(q, [rng.normal(size=3).round(2).tolist() for _ in range(int(rng.integers(1, 3)))]) for q in range(21)]
    asked = spark.createDataFrame([*queries, (98, []), (99, None)], "query bigint, vectors array<array<double>>")
    got = {}
    for r in batch.semantic_many(s, refs, asked, k).orderBy("query", F.desc("semantic"), "id").collect():
        got.setdefault(r["query"], []).append((r.id, pytest.approx(r.semantic, abs=2e-9)))
    assert got == brute(vectors, queries, k)
    assert batch.semantic_many(s, refs, asked.filter("query > 90"), k).count() == 0


def test_a_task_holds_its_best_rows_only():
    """2,000 queries against 20,000 rows: the rows that a pass holds are bounded by queries x k, not by rows."""
    import tracemalloc

    rng = np.random.default_rng(0)
    asked = [(q, v) for q, v in enumerate(rng.normal(size=(2000, 16)).tolist())]
    x = rng.normal(size=(20_000, 16))
    batches = (pa.RecordBatch.from_arrays([pa.array([f"{j:06}" for j in range(i, i + 5000)]), pa.array([1] * 5000, pa.int32()), pa.array(["function"] * 5000), pa.array(list(x[i : i + 5000]))], names=["id", "repo_id", "kind", "v"]) for i in range(0, 20_000, 5000))
    tracemalloc.start()
    rows = pa.Table.from_batches(batch._nearest(asked, "bigint", 10)(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    first = rows.filter(pa.compute.equal(rows.column("query"), 7))
    m = np.array(asked[7][1])
    cosine = x @ m / np.linalg.norm(x, axis=1) / np.linalg.norm(m)
    assert sorted(first.column("id").to_pylist()) == sorted(f"{j:06}" for j in np.argsort(-cosine)[:10])


def test_batches_have_no_limit_of_queries(spark):
    s, refs = store_of(spark, [("1", "name", "function", [1.0, 0.0]), ("2", "other", "function", [0.0, 1.0])])
    many = spark.range(30_000).select(F.col("id").alias("query"), F.when(F.col("id") % 2 == 0, "name").otherwise("the").alias("text"), F.array(F.array(F.lit(1.0), F.col("id").cast("double"))).alias("vectors"))
    assert {tuple(r) for r in batch.named_many(s, refs, many).groupBy("id").count().collect()} == {("1", 15_000), ("2", 15_000)}
    assert batch.semantic_many(s, refs, many, 1).count() == 30_000


def test_equal_texts_are_searched_once(spark):
    """What is written for the channels grows with distinct texts, and every query gets what it would get alone."""
    s, refs = store_of(spark, [(f"{i:03}", ["alpha", "Alpha", "beta", "gammaDelta"][i % 4], "function", None) for i in range(40)])
    s = s.but(chunks=s.chunks.withColumns({"name_tokens": F.lower("name"), "content_tokens": F.lit("delta gamma")}))
    texts = ["alpha", "Alpha", "gammaDelta", None, "beta delta"]
    asked = spark.createDataFrame([(i, texts[i % 5]) for i in range(200)], "query bigint, text string")
    led = batch.with_leads(asked)
    assert sorted(r.lead for r in led.select("lead").distinct().collect()) == [0, 1, 2, 3, 4]
    assert batch.lead_candidates(s, refs, led).select("query").distinct().filter("query > 4").count() == 0
    rows = {}
    for r in batch.candidates_many(s, refs, asked).collect():
        rows.setdefault(r["query"], set()).add((r.id, r.lexical, r.name_score))
    alone = {}
    for r in batch.candidates_many(s, refs, asked.filter("query < 5")).collect():
        alone.setdefault(r["query"], set()).add((r.id, r.lexical, r.name_score))
    assert set(alone) >= {0, 1, 2, 4} and rows == {q: alone[q % 5] for q in range(200) if q % 5 in alone}


def test_gathered_tokens_are_the_tokens(spark):
    rows = [("a", "x y", "y z z"), ("b", None, "x"), ("c", "", ""), ("d", "w", None), ("e", " ".join(f"t{i}" for i in range(300)), "t7 t7 u")]
    chunks = spark.createDataFrame(rows, "id string, name_tokens string, content_tokens string")
    gathered = retrieval.gathered_tokens(chunks)
    want = {tuple(r) for r in retrieval.tokens_of(chunks).select("term", "id", "tf", "dl", retrieval.bucket_of(F.col("term"))).collect()}
    got = [tuple(r) for r in gathered.select("term", "id", "tf", "dl", "bucket").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert gathered._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
