import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, diff, gc, graph, ranking, retrieval
from tessera.operators import store as st
from tessera.plans import build, search, tables
from tessera.schema import META
from tessera.sources.extract import EXTRACTORS, extract_file
from tessera.sources.extract.python import doc_spans
from tessera.sources.languages import Embedded, Language, Registry, Symbols

BASE = {"a.py": "import b\nfrom pkg.c import helper\n\ndef f():\n    return 1\n\nclass K:\n    def m(self):\n        return 2\n", "b.py": "X = 1\ndef g():\n    return f\n", "pkg/c.py": "def helper():\n    pass\n", "README.md": "# Top\nsee [f](a.py#f)\n## Sub\ntext\n"}
HEAD = BASE | {"a.py": BASE["a.py"].replace("return 1", "return 3").replace("def m", "def n"), "d.py": "def new():\n    pass\n"}


def files(spark, given):
    return spark.createDataFrame(list(given.items()), "file_path string, content string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    s = tables.empty(spark)
    s = s.but(repos=st.register_repos(s.repos, spark.createDataFrame([("/r",)], "path string")))
    s = build.build(s, 1, "base", files(spark, BASE), at=F.expr("timestamp '2024-01-01'"))
    root = "file://" + str(tmp_path_factory.mktemp("index"))
    tables.commit(s, root)
    s = build.build(tables.load(spark, root), 1, "head", files(spark, HEAD), at=F.expr("timestamp '2024-01-02'"))
    s = build.embed(s, build.hashed_vectors)
    tables.commit(s, root)
    return tables.load(spark, root)


def test_build_shares_chunks_and_finds_edges(spark, built):
    assert built.chunks.groupBy("id").count().filter("count > 1").count() == 0
    names = {r.name for r in st.get_chunks(built, 1, "head").collect()}
    assert {"f", "K", "n", "g", "helper", "new", "Top", "Sub"} <= names and "m" not in names
    chunks = {r.id: (r.file_path, r.name) for r in built.chunks.collect()}
    edges = {(chunks[r.source_id][0], chunks[r.target_id], r.kind) for r in built.edges.filter("snapshot_sha = 'head'").collect()}
    assert ("a.py", ("pkg/c.py", "helper"), "imports") in edges
    assert ("a.py", ("b.py", "g"), "imports") in edges and ("a.py", ("b.py", "X"), "imports") in edges
    assert built.chunks.filter("embedding is null").count() == 0


def test_diff(spark, built):
    got = {(r.change_kind, r.scope, r.name) for r in diff.diff_symbols(built, 1, "base", "head").collect()}
    assert got == {("added", "K", "n"), ("added", "", "new"), ("removed", "K", "m"), ("modified", "", "f"), ("modified", "", "K")}
    only = diff.diff_symbols(built, 1, "base", "head", spark.createDataFrame([("d.py",)], "file_path string"))
    assert [r.name for r in only.collect()] == ["new"]


def test_search_and_symbols(spark, built):
    refs = st.latest_snapshots(built)
    assert [r.snapshot_sha for r in refs.collect()] == ["head"]
    hits = search.search(built, refs, "helper", k=3).collect()
    assert hits[0].name == "helper" and hits[0].query_kind == "identifier" and hits[0].preview_line == 0
    vectors = [build.hashed_vectors(["helper"])[0][0]]
    assert search.search(built, refs, "helper", vectors, k=3, scorer=search.overlap_scorer, changed=spark.createDataFrame([("d.py",)], "file_path string")).count() <= 3
    broken = search.search(built, refs, "helper", k=3, scorer=lambda q, t: 1 / 0)
    assert [r.id for r in broken.collect()] == [r.id for r in hits]
    assert [r.name for r in search.read_symbol(built, refs, "HELPER").collect()] == ["helper"]


def test_collection_agrees_with_its_forecast(spark, built):
    drop = spark.createDataFrame([(1, "base")], "repo_id int, snapshot_sha string")
    forecast = gc.dry_run(built, drop).first()
    after = gc.drop_snapshots(built, drop)
    assert built.chunks.count() - after.chunks.count() == forecast.chunks > 0
    assert built.edges.count() - after.edges.count() == forecast.edges
    heads = spark.createDataFrame([(1, "head")], "repo_id int, sha string")
    none = spark.createDataFrame([], "repo_id int, name string, sha string")
    kept = gc.collect(built, "HEAD_ONLY", heads, none)
    assert {r.snapshot_sha for r in kept.indexed_snapshots.collect()} == {"head"} and kept.chunks.count() == after.chunks.count()
    assert gc.collect(built, "ORPHANS", heads, none).chunks.count() == built.chunks.count()


def test_upsert_keeps_vectors(spark):
    old = spark.createDataFrame([("1", "a", [1.0], True), ("2", "b", None, False)], "id string, name string, embedding array<float>, embedding_truncated boolean")
    new = spark.createDataFrame([("1", "A", None, False), ("3", "C", None, False), ("3", "C", None, False)], old.schema)
    got = {r.id: (r.name, r.embedding, r.embedding_truncated) for r in st.upsert_chunks(old, new).collect()}
    assert got == {"1": ("A", [1.0], True), "2": ("b", None, False), "3": ("C", None, False)}


def test_versions_and_pointer(spark, built, tmp_path):
    root = f"file://{tmp_path}"
    first = tables.commit(built, root)
    second = tables.compact(spark, root, {"chunks": 1})
    assert tables.current_version(spark, root) == second != first
    assert tables.load(spark, root).chunks.count() == tables.load(spark, root, first).chunks.count()


@pytest.mark.parametrize("stored,verdict", [(None, "wipe"), ("2024.5.1", "wipe"), ("2024.6.1", "keep"), ("2024.10.0", "refuse")])
def test_version_gate(stored, verdict):
    assert build.version_gate(stored, "2024.6.1") == verdict


def test_read_snapshot(spark, built):
    assert build.read_snapshot(built, 1, None) == "head" and build.read_snapshot(built, 1, "base") == "base"
    for repo, ref in ((1, "nope"), (9, None)):
        with pytest.raises(LookupError):
            build.read_snapshot(built, repo, ref)


# --- graph ----------------------------------------------------------------------

def resolve(spark, imports, repo):
    rows = [(str(i), *r) for i, r in enumerate(imports)]
    df = spark.createDataFrame(rows, "id string, file_path string, language string, module string, dots string, language_hint string")
    got = graph.resolve_modules(df, spark.createDataFrame([(f,) for f in repo], "file_path string"), Registry().languages)
    found = {r.id: r.target_file for r in got.collect()}
    return [found.get(str(i)) for i in range(len(imports))]


def test_module_resolution(spark):
    repo = ["src/a/b.py", "a/__init__.py", "x/y/util/io.py", "z/util/io.py", "q/r/deep/mod.py", "web/main.ts", "web/main.js", "lib/w/view.ts", "lib/w/view.js", "web/style.css", "src/m.rs", "os.py/x", "n/os.py"]
    imports = [
        ("main.py", "python", "a.b", "", ""), ("main.py", "python", "a", "", ""), ("main.py", "python", "util.io", "", ""), ("main.py", "python", "deep.mod", "", ""), ("src/a/c.py", "python", "b", "1", ""),
        ("web/app.ts", "typescript", "./main", "", ""), ("p/app.ts", "typescript", "w/view", "", ""), ("web/i.html", "html", "./style.css", "", "css"), ("src/x.rs", "rust", "crate/m", "", ""), ("main.py", "python", "os", "", ""), ("a.py", "python", "x", "5", ""),
    ]
    assert resolve(spark, imports, repo) == ["src/a/b.py", "a/__init__.py", None, "q/r/deep/mod.py", "src/a/b.py", "web/main.ts", "lib/w/view.ts", "web/style.css", "src/m.rs", None, None]


def test_edges_by_name_text_and_file(spark):
    rows = [
        ("s1", "a.py", "function", "f", "python", 3, None), ("s2", "a.py", "function", "f", "python", 9, None), ("c1", "a.py", "comment", "note", "python", 1, None), ("d1", "g.md", "doc_section", "Intro", "markdown", 1, None),
        ("i1", "m.rst", "import", "role:f", "rst", 1, ("", "f,none", "", "")), ("i2", "x.foo", "import", "load helper_a now", "foo", 1, ("", "", "", "")), ("s3", "lib/helper_a.py", "class", "H", "python", 1, None), ("i3", "h.md", "import", "link", "markdown", 2, ("./g.md", "Intro", "", "")),
        ("i4", "b.py", "import", "import a", "python", 1, ("a", "", "", "")),
    ]
    chunks = spark.createDataFrame(rows, f"id string, file_path string, kind string, name string, language string, line_start int, metadata {META}")
    files_ = chunks.select("file_path").distinct()
    got = {tuple(r) for r in graph.infer_edges(chunks, files_, Registry().languages).select("source_id", "target_id", "kind").collect()}
    assert got == {("i1", "s1", "documents"), ("i2", "s3", "imports"), ("i3", "d1", "documents"), ("i4", "s1", "imports"), ("i4", "s2", "imports")}


def test_registry():
    r = Registry()
    with pytest.raises(ValueError):
        r.register(Language("python"))
    assert len(r.languages) == 25


# --- ranking --------------------------------------------------------------------

def test_weights():
    assert ranking.weights_for("concept", False) == pytest.approx((0.0, 0.8, 0.2))
    assert ranking.weights_for("code", False, (1.0, 0.0, 0.0)) == (0.0, 0.5, 0.5)
    with pytest.raises(ValueError):
        ranking.weights_for("code", True, (0.5, 0.6, 0.1))


def test_one_candidate_scores_zero(spark):
    df = spark.createDataFrame([("a", 0.7, 3.0, 1.0)], "id string, semantic double, lexical double, name_score double")
    assert ranking.fuse(df, (0.5, 0.4, 0.1)).first().score == 0.0


def test_order_by_lexical(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 0.0), ("b", 0.0, 5.0, 0.0)], "id string, semantic double, lexical double, name_score double")
    assert [r.id for r in ranking.top(ranking.fuse(df, (0.0, 1.0, 0.0)), 2).collect()] == ["b", "a"]


@pytest.mark.parametrize("name,want", [("Chunk", ["Chunk"]), ("chunk", ["Chunk"]), ("fuse_", ["fuse_scores"]), ("unk", ["Chunk", "_CHUNK_SQL", "make_chunk"])])
def test_name_tiers(spark, name, want):
    df = spark.createDataFrame([(n,) for n in ("Chunk", "make_chunk", "_CHUNK_SQL", "fuse_scores", "fuse")], "name string")
    rows = retrieval.name_tiers(df, name).collect()
    best = min(r.match_tier for r in rows)
    assert sorted(r.name for r in rows if r.match_tier == best) == want


def test_postings_on_disk(spark, built, tmp_path):
    retrieval.write_postings(built.chunks, f"file://{tmp_path}/fts", 4)
    postings, stats = spark.read.parquet(f"file://{tmp_path}/fts/postings"), spark.read.parquet(f"file://{tmp_path}/fts/stats")
    fresh = retrieval.bm25(*retrieval.build_postings(built.chunks), "helper f")
    assert {(r.id, round(r.score, 9)) for r in retrieval.bm25(postings, stats, "helper f").collect()} == {(r.id, round(r.score, 9)) for r in fresh.collect()}


# --- chunks ---------------------------------------------------------------------

def test_markdown_sections(spark):
    text = "# A\none\n## B\ntwo\n```\n# not\n```\n### C\n## D ##\n# E\n"
    got = [(r.name, r.scope, r.level, r.line_start) for r in chunking.markdown_sections(spark.createDataFrame([("f", text)], "file_path string, content string")).orderBy("line_start").collect()]
    assert got == [("A", "", 1, 1), ("B", "A", 2, 3), ("C", "A::B", 3, 8), ("D", "A", 2, 9), ("E", "", 1, 10)]


def test_line_windows_at_the_edge(spark):
    df = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(46))), ("e", ""), ("n", None)], "file_path string, content string")
    assert [(r.line_start, r.line_end) for r in chunking.line_windows(df).collect()] == [(1, 46), (46, 46)]


SAMPLES = {
    "python": ('"""Doc."""\nimport os\nfrom ..x import a, b\n# note\ndef f():\n    pass\n\nclass A:\n    def m(self):\n        pass\nX, Y = 1, 2\n', [("comment", "Doc.", ""), ("import", "import os", ""), ("import", "from ..x import a, b", ""), ("function", "f", ""), ("class", "A", ""), ("method", "m", "A"), ("variable", "X", ""), ("variable", "Y", "")]),
    "javascript": ('import a, {b as c} from "./x.js";\nexport class A extends B {\n  m(x) {\n    if (x) { y() }\n  }\n}\nconst f = (a) => { return 1 };\nconst z = 3;\n', [("import", 'import a, {b as c} from "./x.js"', ""), ("class", "A", ""), ("method", "m", "A"), ("function", "f", ""), ("variable", "z", "")]),
    "go": ('package x\nimport (\n "fmt"\n "a/b"\n)\ntype T struct {\n  a int\n}\nfunc (t *T) M() int {\n return 1\n}\nfunc F() {}\n', [("import", "fmt", ""), ("import", "a/b", ""), ("class", "T", ""), ("method", "M", "T"), ("function", "F", "")]),
    "rust": ("use crate::a::{B, C};\nimpl Foo for Bar {\n  fn x(&self) -> i32 { 1 }\n}\npub fn main() {\n}\n", [("import", "use crate::a::{B, C};", ""), ("class", "Bar", ""), ("method", "x", "Bar"), ("function", "main", "")]),
    "java": ("import java.util.List;\npublic class A {\n  private int x = 1;\n  public void m(int a) {\n    call();\n  }\n}\n", [("import", "import java.util.List;", ""), ("class", "A", ""), ("variable", "x", "A"), ("method", "m", "A")]),
    "c": ('#include "x.h"\n#define MAX 3\nstruct s {\n int a;\n};\nint f(int a) {\n return a;\n}\n', [("import", '#include "x.h"', ""), ("variable", "MAX", ""), ("class", "s", ""), ("function", "f", "")]),
    "css": ("a b {\n  color: red;\n}\n@media x {\n .y { margin: 0 }\n}\n", [("class", "a b", ""), ("class", "@media x", ""), ("class", ".y", "@media x")]),
    "rst": ("Title\n=====\n\n:func:`x.y`\n\nSub\n---\nz\n", [("doc_section", "Title", ""), ("doc_section", "Sub", "Title"), ("import", "role:x.y", "")]),
    "json": ('{"a": {"b": [1, {"c": 2}]}}', [("config_key", "a", ""), ("config_key", "b", "a"), ("config_key", "c", "a::b")]),
    "toml": ("[a.b]\nx=1\n[[c]]\ny=2\n", [("config_key", "b", "a"), ("config_key", "c", "")]),
    "yaml": ("a:\n  b: 1\nc: 2\n", [("config_key", "a", ""), ("config_key", "c", "")]),
    "bash": ("x=1\nf() {\n echo\n}\nsource ./b.sh\n", [("variable", "x", ""), ("function", "f", ""), ("import", "source ./b.sh", "")]),
    "ruby": ('class A\n  def m\n    if x\n    end\n  end\nend\nrequire_relative "b"\n', [("class", "A", ""), ("method", "m", "A"), ("import", 'require_relative "b"', "")]),
    "sql": ("create table t (a int);\ninsert into u values (1);\n", [("class", "t", ""), ("function", "u", "")]),
    "vue": ('<template><a/></template>\n<script lang="ts">\nexport class A {}\n</script>', [("raw_chunk", "template", ""), ("class", "A", "")]),
    "markdown": ("# A\n```py\ndef f(): pass\n```\n", [("doc_section", "A", ""), ("function", "f", "")]),
    "hcl": ('resource "a" "b" {\n x = 1\n}\n', [("config_key", "resource.a.b", "")]),
    "tree_sitter_query": ("(a) @x\n(b (c)) @y.z\n", [("doc_section", "x", ""), ("doc_section", "y.z", "")]),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_extraction(language):
    text, want = SAMPLES[language]
    assert [(c["kind"], c["name"], c["scope"]) for c in extract_file("f", text, language)] == want


def test_comments_fold_into_what_follows():
    got = {c["name"]: (c["kind"], c["line_start"]) for c in extract_file("f.py", "# alone\n\n# about f\ndef f():\n    # inside\n    pass\n", "python")}
    assert got == {"# alone": ("comment", 1), "f": ("function", 3)}


@pytest.mark.parametrize("language", sorted(set(EXTRACTORS) | {"svelte", "vue", "unknown"}))
@pytest.mark.parametrize("text", ["", "\n\n", "plain words only.\nand more | of (them [ { here\n", "\"'`/*<!--", "}}}))]]>\n# x\n; y", "é日🎉" * 50])
def test_any_text_is_extracted(language, text):
    """Text that isn't in the language gives windows or at least a row in it."""
    rows = extract_file("f", text, language)
    assert rows and all(c["line_start"] <= c["line_end"] for c in rows)


def test_doc_spans():
    text = "# about f\n# more\ndef f():\n    pass\n\nclass A:\n    '''Doc\n    of A.'''\n    def m(self):\n        pass\n"
    assert doc_spans(text) == [("f", 1, 2), ("A", 7, 8)]


def test_registered_extractors_patterns_and_hooks_are_called(spark, tmp_path):
    r = Registry()
    r.register(Language("ini", (".ini",), symbols=(Symbols("config_key", r"^(?P<name>\w+)\s*=.*$", one_line=True), Symbols("class", r"^\[(?P<name>\w+)\]$"), Symbols("import", r"^include (?P<name>(?P<module>\S+))$", one_line=True)), import_hook=lambda c, text: {"names": "all"}))
    r.register(Language("shout", (".shout",), extractor=lambda path, text: [{"kind": "function", "name": w, "line_start": 1, "line_end": 1, "content": w} for w in text.split()], name_hook=lambda c, text: None if c["name"] == "no" else c["name"].upper(), scope_hook=lambda c, text: str(len(text.split()))))
    r.register(Language("broken", (".broken",), extractor=lambda path, text: 1 / 0))
    r.register(Language("page", (".page",), embedded=(Embedded(r"<<(?P<language>\w+)\n(?P<code>[\s\S]*?)>>", priority=2), Embedded(r"<<(?P<code>[\s\S]*?)>>", "ini", 1))))
    given = {"a.ini": "[A]\nx = 1\n\ny=2\ninclude b.ini\n", "b.shout": "yes no maybe", "c.broken": "some text\n", "d.page": "text\n<<shout\nhello\n>>\n<<z = 3>>\n", "e.py": "(" * 5000}
    s = build.build(tables.empty(spark), 1, "head", files(spark, given), r)
    got = {(x.file_path, x.kind, x.name, x.scope, x.language, x.line_start, x.line_end) for x in s.chunks.collect()}
    assert {("a.ini", "class", "A", "", "ini", 1, 1), ("a.ini", "config_key", "x", "", "ini", 2, 2), ("a.ini", "config_key", "y", "", "ini", 4, 4), ("a.ini", "import", "b.ini", "", "ini", 5, 5)} <= got
    assert {g[2:4] for g in got if g[0] == "b.shout"} == {("YES", "3"), ("MAYBE", "3")}
    assert ("c.broken", "raw_chunk", "c.broken:1-2", "", "broken", 1, 2) in got and ("e.py", "raw_chunk", "e.py:1-1", "", "python", 1, 1) in got
    assert {(g[1], g[2], g[4], g[5]) for g in got if g[0] == "d.page"} == {("raw_chunk", "d.page:1-6", "page", 1), ("function", "HELLO", "shout", 3), ("config_key", "z", "ini", 5)}
    imports = s.chunks.filter("kind = 'import'").first()
    assert imports.metadata.module == "b.ini" and imports.metadata.names == "all"


def test_discovery_skips_what_cannot_be_loaded(monkeypatch):
    from importlib.metadata import EntryPoint

    from tessera.sources import languages

    points = [EntryPoint("good", "fake_languages:GOOD", languages.GROUP), EntryPoint("made", "fake_languages:make", languages.GROUP), EntryPoint("bad", "fake_languages:missing", languages.GROUP)]
    module = type(languages)("fake_languages")
    module.GOOD, module.make = Language("good", (".good",)), lambda: Language("made", (".made",))
    monkeypatch.setitem(__import__("sys").modules, "fake_languages", module)
    monkeypatch.setattr(languages, "entry_points", lambda group: points)
    r = Registry()
    assert r.discover() == ["good", "made"] and "made" in r.languages
    with pytest.raises(ValueError):
        r.discover()


def test_parser_that_runs_out_of_stack():
    deep = "x = " + "(" * 3000 + ")" * 3000
    assert [c["kind"] for c in extract_file("f.py", deep, "python")] == ["raw_chunk"]
    assert doc_spans(deep) == []


def test_search_reads_the_written_postings(spark, built):
    """The index on disk gives what postings built on the spot give, and only the buckets of the words are read."""
    refs = st.latest_snapshots(built)
    assert built.postings is not None and built.but(chunks=built.chunks).postings is None
    for text in ("helper", "return new", "nothing of the kind", ""):
        a = [tuple(r) for r in retrieval.lexical(built, refs, text, 5).select("id", "lexical").collect()]
        assert a == [tuple(r) for r in retrieval.lexical(built.but(chunks=built.chunks), refs, text, 5).select("id", "lexical").collect()]
    plan = retrieval.postings_for(built, *retrieval.words_of(spark, "helper"))[0]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_commit_of_changed_tables_keeps_the_others(spark, built, tmp_path):
    root = f"file://{tmp_path}/store"
    tables.commit(built, root)
    more = built.but(watched_refs=spark.createDataFrame([(1, "main")], "repo_id int, ref string"))
    version = tables.commit(more, root, changed=("watched_refs",))
    assert [p.name for p in sorted((tmp_path / "store" / version).iterdir())] == ["manifest", "watched_refs"]
    again = tables.load(spark, root)
    assert again.watched_refs.count() == 1 and again.chunks.count() == built.chunks.count() and again.postings.count() == built.postings.count()


def test_weights_as_columns(spark):
    df = spark.createDataFrame([(k, h) for k in ranking.WEIGHTS for h in (True, False)], "k string, h boolean")
    for r in df.select("k", "h", *[w.alias(f"w{i}") for i, w in enumerate(ranking.weight_columns(F.col("k"), F.col("h")))]).collect():
        assert [r.w0, r.w1, r.w2] == pytest.approx(list(ranking.weights_for(r.k, r.h)))


def test_settings_gate_and_wipe(spark, built):
    own = ("model", "2")
    marked = build.opened(built, "2024.1", own)
    assert marked.chunks.count() == 0 and {(r.key, r.value) for r in marked.meta.collect()} == {("schema_version", "2024.1"), ("embedding_model", "model"), ("embedding_version", "2")}
    full = st.set_meta(built, schema_version="2024.1", embedding_model="model", embedding_version="2")
    same = build.opened(full, "2024.1", own)
    assert same.chunks.filter("embedding is null").count() == 0 and same.chunks.count() == built.chunks.count()
    assert build.opened(full, "2024.1", ("model", "3")).chunks.filter("embedding is not null").count() == 0
    with pytest.raises(ValueError):
        build.opened(full, "2023.9", own)
    assert {r.value for r in st.get_meta(st.set_meta(full, schema_version="9"), "schema_version", "absent").collect()} == {"9"}


def test_watched_refs_resolve_by_name_then_origin_then_sha(spark, built):
    sha = "a" * 40
    s = built.but(watched_refs=spark.createDataFrame([(1, "main"), (1, "dev"), (1, sha), (1, "gone"), (2, "main")], "repo_id int, ref string"))
    refs = spark.createDataFrame([(1, "main", "head"), (1, "origin/main", "base"), (1, "origin/dev", "base"), (2, "main", "head")], "repo_id int, name string, sha string")
    got = {(r.repo_id, r.ref): (r.sha, r.indexed, r.total > 0, r.total == r.embedded) for r in st.watched_status(s, refs).collect()}
    assert got == {(1, "main"): ("head", True, True, True), (1, "dev"): ("base", True, True, True), (1, sha): (sha, False, False, True), (1, "gone"): (None, False, False, True), (2, "main"): ("head", False, False, True)}


def test_embedding_resumes_after_a_crash(spark, built, tmp_path):
    root, calls = f"file://{tmp_path}/store", tmp_path / "calls"
    tables.commit(built.but(chunks=st.clear_embeddings(built.chunks)), root)
    total = built.chunks.count()

    def failing(texts):
        seen = int(calls.read_text()) if calls.exists() else 0
        calls.write_text(str(seen + len(texts)))
        if seen >= 5:
            raise RuntimeError("the model went away")
        return build.hashed_vectors(texts)

    with pytest.raises(Exception):  # noqa: B017  Spark wraps what the model raises
        build.embed_pages(spark, root, failing, page=5)
    left = tables.load(spark, root).chunks.filter("embedding is null").count()
    assert left == total - 5
    assert build.embed_pages(spark, root, build.hashed_vectors, page=5) == -(-left // 5)
    done = tables.load(spark, root)
    assert done.chunks.filter("embedding is null").count() == 0 and done.chunks.count() == total


def test_profile_counts_kinds_by_language(spark, built):
    counts, percent = build.profile(built)
    rows = {r.language: r for r in counts.collect()}
    assert rows["python"].total == built.chunks.filter("language = 'python'").count() and rows["markdown"].doc_section == built.chunks.filter("kind = 'doc_section'").count()
    for r in percent.collect():
        assert abs(sum(v for k, v in r.asDict().items() if k != "language") - 100) < 1


def test_batch_search_agrees_with_single_searches(spark, built):
    from tessera.plans import batch

    refs = st.latest_snapshots(built)
    texts = ["helper", "g", "return something of the kind", "K", "", "nothing\\here", "h%r"]
    vectors = [[build.hashed_vectors([t])[0][0]] for t in texts]
    queries = spark.createDataFrame(list(zip(range(len(texts)), texts, vectors, strict=True)), "query bigint, text string, vectors array<array<double>>")
    got = {}
    for r in batch.search_many(built, refs, queries, 3).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.id, round(r.score, 6)))
    for i, t in enumerate(texts):
        want = [(r.id, round(r.score, 6)) for r in search.search(built, refs, t, vectors[i], k=3).collect()]
        assert got.get(i, []) == want, t
    targets = queries.select("query", "text", F.lit("pkg/c.py").alias("t_file"), F.lit("helper").alias("t_name"), F.lit("a").alias("arm"))
    found, report = batch.measure(built, refs, targets.limit(0), {"file_path": "t_file", "name": "t_name"}, levels=((),), dimensions=("arm",))
    assert found.count() == 0 and report.count() == 0
    found, _ = batch.measure(built, refs, targets, {"file_path": "t_file", "name": "t_name"}, levels=((),), dimensions=("arm",))
    assert {r["query"]: r["rank"] for r in found.collect()}[0] == 1 and found.count() == len(texts)


def test_frames_are_checked(spark):
    from tessera.schema import frame, struct_of

    edges = frame(spark, "edges", [{"source_id": "a", "target_id": "b", "kind": "calls"}], repo_id=1, snapshot_sha="head")
    assert edges.schema == struct_of("edges") and tuple(edges.first()) == (1, "a", "b", "calls", "head")
    assert frame(spark, "repos", []).count() == 0
    for table, rows in (("edges", [{"source_id": "a"}]), ("repos", [{"id": 1, "name": "x"}]), ("chunks", [{"id": "a", "embedding": [1.0]}, {"id": "b", "embedding": [1.0, 2.0]}])):
        with pytest.raises(ValueError):
            frame(spark, table, rows)


def test_first_by_orders_nulls_first_and_breaks_ties_by_value(spark):
    rows = spark.createDataFrame([("f", 2, "x"), ("f", 1, "z"), ("f", 1, "y"), ("g", None, "n"), ("g", 1, "m")], "file string, line int, name string")
    assert sorted(map(tuple, graph.first_by(rows, ["file"], ["line"], "name").collect())) == [("f", "y"), ("g", "n")]
    assert graph.first_by(rows.limit(0), ["file"], ["line"], "name").count() == 0
