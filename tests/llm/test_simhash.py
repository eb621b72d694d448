import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as sh
from tessera.llm._components import components


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    counts = np.zeros(64, int)
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        counts += [(h >> j) & 1 for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(grams))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in sh.near_duplicates(df).collect()), key=str) == brute(rows)


def test_odd_rows(odd):
    check(odd)


def test_documents(spark, tiny):
    check(spark.read.parquet(f"{tiny}/documents.parquet"))


def test_near_copies(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(5)]
    rows = []
    for i in range(150):
        w = base[i % 5].split()
        for _ in range(i % 4):
            w[rng.randrange(200)] = "zz"
        rows.append((1000 - i, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_empty(none):
    assert sh.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair(radius):
    rng = random.Random(2)
    m = sh.masks(radius)
    assert len(m) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not d & x for x in m)


@pytest.mark.parametrize("tile", [1 << 14, 40])
def test_links_of_dense_groups_lose_none(spark, tile):
    """Hundreds of different fingerprints around few centres: large buckets, with and without tiles."""
    rng = random.Random(4)
    fps = set()
    for _ in range(3):
        c = rng.getrandbits(64)
        for _ in range(300):
            f = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(sh._signed(f),) for f in fps], "fp bigint")
    got = {r.node: r.root for r in components(sh.near_links(df, 4, tile)).collect()}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    groups = lambda label: sorted(sorted(f for f in fps if label(f) == r) for r in {label(f) for f in fps})
    assert groups(find) == groups(lambda f: got.get(sh._signed(f), sh._signed(f)))


def test_majority_bits_over_many_hashes():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    offsets = np.array([0, 0, 1, 1, 255, 511, 3000])
    got = sh.majority_bits(h, offsets)
    for i in range(6):
        part = h[offsets[i] : offsets[i + 1]]
        want = sum(1 << j for j in range(64) if 2 * sum((int(x) >> j) & 1 for x in part) > len(part))
        assert int(got[i]) == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}}
