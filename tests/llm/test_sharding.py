import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import sharding
from tessera.llm.sharding import shard


def judge(rows, source, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} <= {"bytes"} and all(r.grown_shard is None for r in rows)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_odd_rows(odd):
    judge(shard(odd, 4).collect(), [(r.doc_id, r.text) for r in odd.collect()], 4)


def test_empty(none):
    assert shard(none).count() == 0


@pytest.mark.parametrize("hot", [0.0, 0.34])
def test_sizes_are_near_equal_and_groups_stay(spark, hot):
    n = 6000
    rows = [(i, "hot text" * 20 if i < hot * n else f"text {i % 4000} " * (i % 37 + 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = shard(df).collect()
    judge(got, rows, 16)
    load, homes = Counter(), defaultdict(set)
    text = dict(rows)
    for r in got:
        load[r.shard] += r["size"]
        homes[text[r.doc_id]].add(r.shard)
    share = sum(load.values()) / 16
    assert len(load) == 16 and max(load.values()) < 1.05 * share and min(load.values()) > 0.95 * share
    assert sum(len(h) > 1 for t, h in homes.items() if not t.startswith("hot")) == 0


def test_the_same_rows_give_the_same_shards(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert sorted(map(tuple, shard(docs).collect())) == sorted(map(tuple, shard(docs.repartition(3)).collect()))


def test_copies_of_whole_rows_are_spread(spark, monkeypatch):
    """A third of the rows are one row, and as many have no id and one text: they are numbered in several buckets."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    rows = [(7, "the same row")] * 1000 + [(None, "no id")] * 1000 + [(i, f"text {i}") for i in range(8, 1008)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    judge(shard(df).collect(), rows, 16)
    one = sharding._numbered(df.filter("doc_id = 7").selectExpr("doc_id AS id", "1L AS crc", "1L AS size", "0 AS grp"), "grp", 1000)
    per = [r["count"] for r in one.groupBy("bucket").count().collect()]
    assert len(per) == 10 and max(per) < 200 and sorted(r.i for r in one.select("i").collect()) == list(range(1000))
