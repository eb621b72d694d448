import random
import string
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import sentencepiece_bpe as sp
from tessera.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(library, texts):
    got = sp.Encoder(sp.load(MODEL)).batch(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [sp.decode(sp.load(MODEL), x.tolist()) for x in got] == [library.decode(x.tolist()) for x in got]


def test_awkward_texts(library):
    same(library, ["", " ", "   a  b ", "a" * 5000, " " * 100, "▁", "a ▁b", "\x00", "�", "🎉" * 30, "<s></s><unk><0x0A>", "\n\n\t", "abab" * 50, "aaa" * 9, "日本語テキスト", "=" * 77, "-" * 63 + "x"])


@pytest.mark.parametrize("alphabet", ["ab", "the in g", "aab  ▁é\n<0x>日😀", "0123456789 .,", "-=/*# "])
def test_random_texts(library, alphabet):
    rng = random.Random(alphabet)
    same(library, ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    same(sentencepiece.SentencePieceProcessor(model_file=MODEL), texts)


def test_forgetting_words_changes_nothing(library):
    texts = [f"some words {i} and {i * 7} more" for i in range(200)]
    encoder = sp.Encoder(sp.load(MODEL), most=20)
    got = [x.tolist() for i in range(0, 200, 10) for x in encoder.batch(texts[i : i + 10])]
    assert got == library.encode(texts)


def test_operator(spark, library, odd, none, tiny):
    for df in (odd, spark.read.parquet(f"{tiny}/documents.parquet")):
        got = sorted((str(r.doc_id), str(r.ids), r.decoded) for r in sp.encoded(df, MODEL).collect())
        want = [(str(r.doc_id), library.encode(r.text or "")) for r in df.collect()]
        assert got == sorted((i, str(x), library.decode(x)) for i, x in want)
    assert sp.encoded(none, MODEL).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "the in g", "aab  ▁é\n<0x>日😀", string.ascii_lowercase, "-=/*# "])
def test_rank_by_rank_from_the_start(library, monkeypatch, alphabet):
    monkeypatch.setattr(sp, "WHOLE_ROUNDS", 0)
    rng = random.Random(alphabet)
    same(library, ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(2000)])


def test_long_words_in_seconds(library, spark, small):
    """Words of 200,000 mixed characters without a space, and prose with its white space taken out."""
    rng = random.Random(7)
    prose = "".join("".join(r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(300).collect()).split())
    texts = ["".join(rng.choices(string.ascii_letters + string.digits, k=200_000)), "".join(rng.choices(string.ascii_lowercase, k=200_000)), prose[:200_000], "ab" * 100_000]
    for t in texts:
        began = time.time()
        same(library, [t])
        assert time.time() - began < 20  # about half a second; 80,000 characters took 10 s when every round read the whole word
