import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts as tc
from tessera.llm.queries import SEPARATOR, vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.json")


def lengths(tokens, sep):
    out, n = [], 0
    for t in tokens:
        if t == sep:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


@pytest.mark.parametrize("block,sup", [(4, 1024), (7, 2), (1000, 3), (1, 2)])
def test_scan_like_brute_force(spark, tmp_path, monkeypatch, block, sup):
    monkeypatch.setattr(tc, "SUPER", sup)
    rng = np.random.default_rng(block)
    files = {"a": rng.integers(0, 5, 300), "b": np.zeros(9, int), "c": rng.integers(1, 5, 50), "d": np.empty(0, int), "e": np.array([1, 2, 0]), "f": np.array([0]), "g": np.array([3])}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(tokens.astype("<u2").tobytes())
    blocks = tc.read_flat_files(spark, f"file://{tmp_path}/*", block)
    got = {}
    for r in tc.count_tokens(blocks, 0).orderBy("file", "ordinal").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.n_tokens)
        assert r.ordinal == len(got[r.file.rsplit("/", 1)[1]]) - 1
    assert got == {k: lengths(v.tolist(), 0) for k, v in files.items() if len(v)}


def brute(rows):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return sorted((str(i), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)


def test_odd_rows(odd):
    got = tc.document_tokens(odd, VOCABULARY, SEPARATOR).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_documents_over_several_blocks(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(3)
    got = tc.document_tokens(docs, VOCABULARY, SEPARATOR).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long_runs_of_white_space(spark):
    from tests.llm.test_packing import LONG

    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in tc.document_tokens(df, VOCABULARY, SEPARATOR).collect()) == brute(enumerate(LONG))


def test_identifiers_of_32_bits(spark, tmp_path, monkeypatch):
    """A vocabulary whose numbers pass 16 bits gives wider files; a separator that doesn't fit is an error, not another number."""
    import json

    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    moved = {t: i if i < 300 else i + 65_536 for t, i in vocab.items()}
    spec["model"]["vocab"] = moved
    spec["added_tokens"] = [t | {"id": moved.get(t["content"], t["id"] + 65_536)} for t in spec["added_tokens"]]
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert (tc.width_of(str(path), 65_536 + 50_256), tc.width_of(VOCABULARY, SEPARATOR)) == (4, 2)
    rows = [(1, "some words that are tokens"), (2, None), (3, " and others" * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in tc.document_tokens(df, str(path), 65_536 + 50_256).collect()) == brute(rows)
    tokens = np.array([70_000, 5, 0, 65_536, 0], "<u4")
    (tmp_path / "flat").write_bytes(tokens.tobytes())
    blocks = tc.read_flat_files(spark, f"file://{tmp_path}/flat", 2, 4)
    assert [r.n_tokens for r in tc.count_tokens(blocks, 0, 4).orderBy("ordinal").collect()] == [2, 1]
    with pytest.raises(ValueError):
        tc.count_tokens(blocks, 70_000)


def test_empty(none):
    assert tc.document_tokens(none, VOCABULARY, SEPARATOR).count() == 0
