import numpy as np
import pytest

from tessera.llm import ann
from tessera.llm.ann import nearest


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ q
            order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-round(float(s[j]), 12), ids[j]))[:k]
            out[i] = [ids[j] for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall(spark, clusters):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)) + (rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 6000)] * 3 if clusters else 0)
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    assert recall(answers(nearest(df)), brute(list(range(6000)), x, 20, 20)) >= 0.95


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4)).round(2)
    x[:50] = [0.5, 0.5, -0.5, 1.0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (220, [1.0, 2.0]), (240, []), rows[60]]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<double>, rank int")
    assert answers(nearest(df)) == brute(list(range(120)), x, 20, 20)


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert answers(nearest(one)) == {0: [20, 1], 20: [0, 1]}
    assert nearest(one.filter("vec_id = 0")).count() == 0
    assert nearest(one.filter("vec_id < 0")).count() == 0


def test_embeddings(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    assert recall(answers(nearest(df)), brute([r.vec_id for r in rows], x, 20, 20)) >= 0.95


@pytest.mark.parametrize("centroids", [2048, 12])
def test_tables_decide(monkeypatch, centroids):
    """Every cell is searched by the tables alone; with few centroids a second level cuts the cells."""
    monkeypatch.setattr(ann, "CENTROIDS", centroids)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 32)) + rng.normal(size=(40, 32))[rng.integers(0, 40, 20_000)] * 2
    index = ann.fit(x[:6000], len(x))
    assert (len(index.fine) > 1) == (centroids == 12) and 120 <= index.cells <= 160
    cell = index.assign(x)
    codes, held = index.codes(x, cell), np.bincount(cell, minlength=index.cells)
    assert held.max() > 100
    q = x[::400]
    cells = ann.probed(index, q, held, 168)
    for most, least in ((84, 0.95), (21, 0.5)):
        floor = ann.floors(index, q, cells, cell[:6000], codes[:6000], len(x), most, 21)
        found = [[] for _ in q]
        for c in range(index.cells):
            rows, asks = np.flatnonzero(cell == c), np.array([i for i, cs in enumerate(cells) if c in cs], int)
            if len(rows) and len(asks):
                qs, vs, near = ann.search_block(index, c, codes[rows], q[asks], floor[asks], most)
                for a, v, s in zip(asks[qs], rows[vs], near, strict=True):
                    found[a].append((s, v))
        hit = 0
        for i, best in enumerate(found):
            kept = {v for _, v in sorted(best, reverse=True)[:most]}
            assert len(kept) == most  # the floor leaves enough
            hit += len(kept & set(np.argsort(-(x @ q[i]))[:21].tolist()))
        print(f"recall of the {most} best by the tables {hit / (21 * len(q)):.3f}, {index.probes} of {index.cells} cells")
        assert hit / (21 * len(q)) >= least


def test_second_level_in_spark(spark, monkeypatch):
    monkeypatch.setattr(ann, "CENTROIDS", 8)
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(3000, 16)) + rng.normal(size=(10, 16))[rng.integers(0, 10, 3000)] * 3).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = nearest(df)
    assert recall(answers(got), brute(list(range(3000)), x, 20, 20)) >= 0.9
    for r in got.filter("rank <= 2").collect():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9


@pytest.mark.parametrize("kind", ["unit clusters", "near copies", "heavy norms"])
def test_within_cells_nothing_is_lost(spark, kind):
    """Rows that lie closer together than codes can tell, and lengths of all sizes: the tables' best alone miss many of the nearest."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(6000, 32))
    if kind == "unit clusters":
        x = rng.normal(size=(20, 32))[rng.integers(0, 20, 6000)] + 0.02 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "near copies":
        x = rng.normal(size=(15, 32))[rng.integers(0, 15, 6000)] + 0.0005 * x
    else:
        x /= np.abs(rng.normal(size=(6000, 1)))
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    assert recall(answers(nearest(df)), brute(list(range(6000)), x, 20, 20)) >= 0.95
