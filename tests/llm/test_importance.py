import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10_000, longest=1, least=20, share=10):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(b % buckets for b in runs(x, longest)[1])
    for x in target:
        t.update(b % buckets for b in runs(x, longest)[1])
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for i, x in rows:
        n, f = runs(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b % buckets) for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = order[: share * len(order) // 100]
    return out, drawn


def check(df, target, **more):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, drawn = brute(rows, [r.text for r in target.collect()], **more)
    names = {"longest": "longest", "buckets": "buckets", "least": "least_words", "share": "share"}
    got = im.resample(df, target, **{names[k]: v for k, v in more.items()}).collect()
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    assert [r[:5] for r in sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, len(drawn) + 1))
    return len(drawn)


def test_documents_against_brute_force(spark, tiny):
    docs, target = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    assert check(docs.repartition(5), target) > 5
    assert check(docs, target, longest=3, buckets=97, least=3, share=50) > 50


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("one word and another",), (None,), ("",)], "text string")
    check(odd, target, least=1, share=60)
    check(odd, target.limit(0), longest=2, least=0, share=100)
    assert im.resample(none, target).count() == 0


@pytest.mark.parametrize("share", [0, 100])
def test_ties_go_to_the_smaller_id_and_repeats_stay(spark, share):
    df = spark.createDataFrame([(i % 7, "same words " * 12) for i in range(40)], "doc_id bigint, text string").repartition(4)
    assert check(df, df, share=share) == (40 if share else 0)


def test_the_draw_leans_to_the_target(spark):
    words = {k: [f"{k}{i}" for i in range(30)] for k in "ab"}
    docs = spark.createDataFrame([(i, " ".join(words["a" if i % 2 else "b"][(i + j) % 30] for j in range(25))) for i in range(200)], "doc_id bigint, text string")
    target = docs.filter("doc_id % 2 = 1").limit(20)
    drawn = im.resample(docs, target).filter("rank is not null").collect()
    assert len(drawn) == 20 and all(r.doc_id % 2 for r in drawn)
