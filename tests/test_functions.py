import pytest
from pyspark.sql import functions as F

from tessera.functions import paths as p
from tessera.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


TOKENS = {
    "AgentDeps": "agentdeps agent deps", "_deep_merge": "_deep_merge deep merge", "parseHTML5Doc": "parsehtml5doc parse html 5 doc", "foo foo foo": "foo", "= + - / *": "", "": "", "__init__": "__init__ init",
    "uint32_t": "uint32_t uint 32 t", "HashMap<String, List<Integer>>": "hashmap hash map string list integer", "IEventEmitter": "ieventemitter i event emitter",
}


@pytest.mark.parametrize("text,tokens", TOKENS.items())
def test_tokens(spark, text, tokens):
    assert one(spark, tx.tokenise_code(F.lit(text))) == tokens


@pytest.mark.parametrize("query,name,score", [("Index", "IndexStore", 0.8), ("Store", "IndexStore", 0.5), ("import edge", "infer_import_edges", 0.4), ("xyz", "IndexStore", 0.0), ("indexstore", "IndexStore", 1.0), ("", "x", 0.0)])
def test_name_score(spark, query, name, score):
    assert one(spark, tx.name_score(F.lit(query), F.lit(name))) == score


@pytest.mark.parametrize("path,penalty", [("src/tests/conftest.py", 0.5), ("vendor/lib/foo.py", 0.3), ("docs/guide.md", 0.8), ("pyproject.toml", 0.7), ("src/a.py", 1.0), ("api_pb2.py", 0.3), ("x.gen.ts", 0.3)])
def test_file_penalty(spark, path, penalty):
    assert one(spark, tx.file_penalty(F.lit(path))) == penalty


@pytest.mark.parametrize("degree,boost", [(0, 1.0), (1, 1.25), (3, 1.5), (7, 1.75), (15, 2.0), (1000, 3.0)])
def test_importance(spark, degree, boost):
    assert one(spark, tx.importance(F.lit(degree))) == pytest.approx(boost)


@pytest.mark.parametrize(
    "query,kind",
    [("fuse_scores", "identifier"), ("retry logic", "identifier"), ("import os", "identifier"), ("def f(x): pass", "code"), ("a == b", "code"), ("how are retries handled", "concept"), ("List<int>", "code"), ("x = {}", "code"), ("", "identifier"), ("a > b > c > d", "identifier")],
)
def test_classify(spark, query, kind):
    assert one(spark, tx.classify_query(F.lit(query))) == kind


def test_preview(spark):
    r = one(spark, tx.preview(F.lit("x\nAlpha beta\nalpha Beta gamma\n"), F.array(*map(F.lit, ["gamma", "alpha", "zeta"]))))
    assert (r.line, r.matched) == (2, ["gamma", "alpha"])
    assert one(spark, tx.preview(F.lit("x"), F.array(F.lit("q")))).line is None


@pytest.mark.parametrize("text,want", [("Returns the parsed value. More.", "Returns the parsed value."), ("short.", None), ("TODO: write this down later", None), ("# @param x the value here", None), ("  First paragraph here\n\nsecond", "First paragraph here"), ("y" * 300, "y" * 200)])
def test_first_sentence(spark, text, want):
    assert one(spark, tx.first_sentence(F.lit(text))) == want


@pytest.mark.parametrize(
    "patterns,hits",
    [(["*.log"], {"a.log", "d/b.log"}), (["/a.log"], {"a.log"}), (["d/"], {"d/b.log", "d/e/f.py"}), (["*.log", "!b.log"], {"a.log"}), (["d/**/f.py"], {"d/e/f.py"}), (["# c", ""], set()), (["[ab].log"], {"a.log", "d/b.log"})],
)
def test_ignore(spark, patterns, hits):
    df = spark.createDataFrame([(x,) for x in ("a.log", "d/b.log", "d/e/f.py", "g.py")], "f string")
    assert {r.f for r in df.filter(p.ignored(F.col("f"), patterns)).collect()} == hits


def test_paths(spark):
    assert [one(spark, f(F.lit("a/b.tar.gz"))) for f in (p.suffix, p.stem, p.parent, p.without_suffix)] == [".gz", "b.tar", "a", "a/b.tar"]
    assert [one(spark, f(F.lit(".bashrc"))) for f in (p.suffix, p.stem)] == ["", ".bashrc"]
    assert tuple(one(spark, p.relative_parts(F.lit("../../x/y")))) == (3, "x/y")
    assert one(spark, p.is_binary(F.lit(b"ab\x00c"))) and not one(spark, p.is_binary(F.lit(b"abc")))


@pytest.mark.parametrize("n,text", [(512, "512 B"), (1_500_000, "1.5 MB"), (2_100_000_000, "2.1 GB")])
def test_human_bytes(spark, n, text):
    assert one(spark, tx.human_bytes(F.lit(n))) == text


def test_elapsed(spark):
    assert [one(spark, tx.elapsed(F.lit(s))) for s in (45.0, 83.0)] == ["45s", "1m23s"]
