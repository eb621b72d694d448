"""The best chunks by blocks of postings are those of all postings, and fewer are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import impacts, retrieval


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        words = {"common"} | {f"w{x}" for x in rng.zipf(1.5, int(rng.integers(1, 60))) % 40} | ({"rare"} if i % 300 == 7 else set())
        rows.append((f"{i:05}", " ".join(sorted(words)), "common" if i % 9 == 0 else ""))
    chunks = spark.createDataFrame(rows, "id string, content_tokens string, name_tokens string").repartition(3)
    root = "file://" + str(tmp_path_factory.mktemp("blocks"))
    retrieval.write_postings(chunks, root, 4)
    postings, stats = retrieval.written_postings(spark, root)
    impacts.write_blocks(postings, stats, f"{root}/blocks", 16, 4)
    return postings.cache(), stats, impacts.read_blocks(spark, f"{root}/blocks")


def brute(index, terms, k, seen=None):
    postings, stats, _ = index
    scored = retrieval.bm25(postings.filter(F.col("term").isin(terms)), stats).collect()
    held = None if seen is None else {r.id for r in seen.collect()}
    return sorted((-round(r.score, 9), r.id) for r in scored if held is None or r.id in held)[:k]


@pytest.mark.parametrize("terms,k", [(["common"], 5), (["common", "w1", "w2"], 10), (["rare", "common"], 5), (["w1", "w39", "absent"], 300), (["absent"], 3), (["common", "w1"], 5000)])
def test_same_as_all_postings(index, terms, k):
    found, _ = impacts.best(index[2], terms, k, buckets=4)
    assert [(-r.score, r.id) for r in found.collect()] == [(pytest.approx(s, abs=2e-9), i) for s, i in brute(index, terms, k)]


def test_only_visible_chunks_count(spark, index):
    seen = spark.range(0, 1500, 11).select(F.format_string("%05d", "id").alias("id"))
    found, _ = impacts.best(index[2], ["common", "w3"], 12, seen, 4)
    assert [(-r.score, r.id) for r in found.collect()] == [(pytest.approx(s, abs=2e-9), i) for s, i in brute(index, ["common", "w3"], 12, seen)]


def test_a_frequent_term_is_read_in_part(index):
    _, report = impacts.best(index[2], ["common"], 10, buckets=4)
    row = report.first()
    assert row.held == 1500 and row.read < 150
    row = impacts.best(index[2], ["common", "rare"], 3, buckets=4)[1].first()
    assert row.read <= row.held + 16 + 5  # another word may lift any chunk, so all is read, and the first blocks twice


def test_blocks_are_full_and_in_order(index):
    rows = index[2].filter("term = 'common'").orderBy("block").collect()
    assert [r.n for r in rows[:-1]] == [16] * (len(rows) - 1) and sum(r.n for r in rows) == 1500
    tops = [r.top for r in rows]
    assert tops == sorted(tops, reverse=True) and all(max(p.score for p in r.posts) == r.top for r in rows)
