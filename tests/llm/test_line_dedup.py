from collections import defaultdict

from tessera.llm.line_dedup import drop_shared_lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                holders[key(line)].add(i)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or shared[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_like_brute_force_on_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in drop_shared_lines(odd).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert sorted(got, key=str) == brute(rows)
    assert any(r[2] for r in got)


def test_like_brute_force_on_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, drop_shared_lines(docs).collect()), key=str) == brute(rows)


def test_empty(none):
    assert drop_shared_lines(none).count() == 0
