from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as pk
from tessera.llm.queries import vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(VOCABULARY)


def judge(pieces, source, reference, length):
    """Every identifier of every document lies in exactly one piece, and sequences have neither gaps nor overlaps."""
    want = sorted((str(i), *reference.encode(t or "", add_special_tokens=False).ids, 0) for i, t in source)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        by_doc[str(p.doc_id), p.doc_tokens].append((p.start, ids))
        by_seq[p.sequence_id].append((p.offset, p.length))
    for s in by_seq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    got = []
    for (doc, total), parts in by_doc.items():
        for k in range(len([1 for s, _ in parts if s == 0])):  # repeated rows: one copy after the other
            ids = []
            while len(ids) < total:
                ids += sorted((x for x in parts if x[0] == len(ids)), key=str)[k][1]
            got.append((doc, *ids))
    assert sorted(got) == want
    return {s: sum(n for _, n in x) for s, x in by_seq.items()}


def test_odd_rows(odd, reference):
    judge(pk.pack(odd, VOCABULARY).collect(), [(r.doc_id, r.text) for r in odd.collect()], reference, 1024)


def test_documents_pack_with_little_padding(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(7)
    fill = judge(pk.pack(docs, VOCABULARY).collect(), [(r.doc_id, r.text) for r in docs.collect()], reference, 1024)
    assert sum(fill.values()) >= 0.97 * 1024 * (len(fill) - 1)


def test_more_partitions_than_one_task_merges(spark, reference, monkeypatch):
    monkeypatch.setattr(pk, "MERGED", 2)
    rows = [(i, f"short text {i} " * (i % 9 + 1)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    fill = judge(pk.pack(df, VOCABULARY, length=64, open_windows=3).collect(), rows, reference, 64)
    assert sum(fill.values()) >= 0.85 * 64 * len(fill)


def test_empty(none):
    assert pk.pack(none, VOCABULARY).count() == 0


def test_string_ids_and_the_ranks_give_what_the_library_gives(spark, reference):
    texts = ["", "a  b", "don't I'LL x's", "日本 🎉\r\n\t", "<|endoftext|>x<|endoftext|>", "  x　y", "١٢٣ ½ Ⅷ", "é‍", "x" * 3000, "\x00\x01\x7f"]
    encode = pk.encoder(VOCABULARY)
    assert [encode(t).tolist() for t in texts] == [reference.encode(t, add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    judge(pk.pack(df, VOCABULARY).collect(), [(f"d{i}", t) for i, t in enumerate(texts)], reference, 1024)


LONG = ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x \t" + "\n 　\x85" * 250_000 + "<|endoftext|>" + " " * 200_000 + "y" + "\r\n" * 100_000]


def test_long_runs_of_white_space(spark, reference):
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id bigint, text string")
    judge(pk.pack(df, VOCABULARY).collect(), list(enumerate(LONG)), reference, 1024)


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n\t" * 2_500_000 + "end", "a" + " " * 20_000_000 + "b", "x" * 3_000_000, "!?" * 1_500_000, "17" * 1_500_000])
def test_longest_texts(text, reference):
    """Identifiers spell the text and, on the same kind of text cut to a size that the library does fast, are the library's."""
    ids = pk.encoder(VOCABULARY)(text)
    spell = {i: b for b, i in pk.ranks_of(VOCABULARY)[0].items()}
    assert b"".join(map(spell.__getitem__, ids.tolist())).decode() == text
    short = text[:150_000] + text[-150_000:]
    assert pk.encoder(VOCABULARY)(short).tolist() == reference.encode(short, add_special_tokens=False).ids
