"""Queries of the remaining operators: small reads, name and stem joins, pools, tuning, sinks, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.fixture import refs, store, table
from tessera.catalog.index import AT, REFS, REPOS, ROW, SEEN, TWO, at_repo, plain
from tessera.catalog.registry import query
from tessera.functions import paths as p
from tessera.functions import text as tx
from tessera.operators import evaluation as ev
from tessera.operators import graph, ranking, retrieval
from tessera.operators import store as st
from tessera.plans import build as plan
from tessera.schema import CHUNK_KINDS
from tessera.session import scratch_path
from tessera.sources.languages import Registry


@query("s11_meta_lookup", "SELECT n_name AS key, CASE n_name WHEN 'NATION_1' THEN 'later' ELSE n_regionkey::VARCHAR END AS value FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'ABSENT') UNION ALL SELECT 'own', '2' WHERE EXISTS (SELECT 1 FROM nation)")
def s11(spark, d):
    """Nations as settings; a value that is set again replaces the one before, and a key that isn't set has none."""
    s = store(spark, d).but(meta=table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")))
    s = st.set_meta(st.set_meta(s, NATION_1="once", own="1"), NATION_1="later", own="2")
    return st.get_meta(s, "NATION_1", "NATION_2", "ABSENT", "own")


_REFS = "refs(repo_id, name, sha) AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'main' ELSE 'origin/main' END, CASE WHEN id % 3 = 0 THEN 'base' ELSE 'head' END FROM repos WHERE id % 5 <> 0)"


@query("q7_status", f"WITH {_REFS}, n AS (SELECT fs.repo_id, fs.snapshot_sha, count(*) AS total, count(*) FILTER (c.has_embedding) AS embedded FROM {SEEN} GROUP BY 1, 2) SELECT w.repo_id, w.ref, r.sha, i.repo_id IS NOT NULL AS indexed, CASE WHEN i.repo_id IS NULL THEN 0 ELSE coalesce(n.total, 0) END::BIGINT AS total, CASE WHEN i.repo_id IS NULL THEN 0 ELSE coalesce(n.embedded, 0) END::BIGINT AS embedded FROM watched_refs w LEFT JOIN refs r ON r.repo_id = w.repo_id AND r.name IN (w.ref, 'origin/' || w.ref) LEFT JOIN indexed_snapshots i ON i.repo_id = w.repo_id AND i.snapshot_sha = r.sha LEFT JOIN n ON n.repo_id = w.repo_id AND n.snapshot_sha = r.sha", True)
def q7(spark, d):
    """Every watched ref with the snapshot that it resolves to, by its own name or at origin, and that snapshot's counts."""
    s = store(spark, d)
    known = s.repos.filter("id % 5 <> 0").select(F.col("id").alias("repo_id"), F.when(F.col("id") % 4 == 0, "main").otherwise("origin/main").alias("name"), F.when(F.col("id") % 3 == 0, "base").otherwise("head").alias("sha"))
    return st.watched_status(s, known)


@query("q17_profile", "SELECT language, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in CHUNK_KINDS) + ", count(*) AS total FROM chunks GROUP BY 1", True)
def q17(spark, d):
    return plan.profile(store(spark, d))[0]


@query("q17_profile_percent", "SELECT language, " + ", ".join(f"round(100.0 * count(*) FILTER (kind = '{k}') / count(*), 1)::DOUBLE AS {k}" for k in CHUNK_KINDS) + " FROM chunks GROUP BY 1", True)
def q17_percent(spark, d):
    return plan.profile(store(spark, d))[1]


for _r, _t in REPOS:

    @query("p1_presence_flag" + _t, at_repo(f"SELECT c.has_embedding, count(*) AS n FROM {SEEN} WHERE {AT} GROUP BY 1", _r), True)
    def p1(spark, d, r=_r):
        return st.get_chunks(store(spark, d), r, "head").groupBy("has_embedding").agg(F.count("*").alias("n"))


@query("p5_kind_filter", f"SELECT c.id, fs.repo_id, c.kind FROM {SEEN} WHERE {REFS} AND c.kind NOT IN ('import', 'doc_section')", True)
def p5(spark, d):
    return st.at_snapshots(store(spark, d), refs(spark, *TWO)).filter(~F.col("kind").isin("import", "doc_section")).select("id", "repo_id", "kind")


@query("p10_null_fills", "SELECT c_custkey, coalesce(count(o_orderkey), 0) AS n, coalesce(max(o_totalprice), 0.0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def p10(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("total"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna({"n": 0, "total": 0.0})


for _r, _t in REPOS:

    @query("p11_path_scope" + _t, at_repo(f"SELECT c.id, c.file_path FROM {SEEN} WHERE {AT} AND c.file_path IN (SELECT file_path FROM chunks WHERE kind = 'class')", _r), True)
    def p11(spark, d, r=_r):
        s = store(spark, d)
        return st.get_chunks(s, r, "head").join(s.chunks.filter("kind = 'class'").select("file_path").distinct(), "file_path", "left_semi").select("id", "file_path")


@query("p12_path_normalise", "SELECT doc_id, lang || '/a/' || doc_id || '.txt' AS path FROM documents")
def p12(spark, d):
    raw = F.concat(F.lit("/repos/x/./"), "lang", F.lit("//a\\"), "doc_id", F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", p.repo_relative(raw, "/repos/x").alias("path"))


for _r, _t in REPOS:

    @query("j3_scores_join" + _t, at_repo(f"SELECT c.id, fs.repo_id, length(c.name) AS score FROM {SEEN} WHERE {AT} ORDER BY score DESC, c.id, fs.repo_id LIMIT 15", _r), True)
    def j3(spark, d, r=_r):
        s = store(spark, d)
        scores = s.chunks.select("id", F.char_length("name").cast("long").alias("score"))
        return scores.join(st.at_snapshots(s, repo_id=r, snapshot="head").select("id", "repo_id"), "id").orderBy(F.desc("score"), "id", "repo_id").limit(15)


@query("j14_parameter_grid", "SELECT p_partkey, w::DOUBLE AS w FROM part, (VALUES (0.0), (0.5), (1.0)) v(w)")
def j14(spark, d):
    return ev.with_settings(table(spark, d, "part").select("p_partkey"), spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "w double"))


@query("j19_first_definitions", "WITH r AS (SELECT file_path, name, id AS symbol, line_start, row_number() OVER (PARTITION BY file_path, name ORDER BY line_start, id) AS n FROM chunks WHERE kind IN ('function', 'class', 'method', 'variable')) SELECT file_path, name, symbol, line_start FROM r WHERE n = 1", True)
def j19(spark, d):
    return graph.first_definitions(store(spark, d).chunks)


_IMPORTS = "SELECT doc_id::VARCHAR AS id, CASE doc_id % 3 WHEN 0 THEN 'm' || (doc_id + 1) WHEN 1 THEN 'pkg.m' || (doc_id + 1) ELSE 'deep.m' || (doc_id + 1) END AS module FROM documents"


@query(
    "j20_module_resolution",
    f"WITH i AS ({_IMPORTS}), f AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'm' || doc_id || '.py' WHEN 1 THEN 'src/pkg/m' || doc_id || '/__init__.py' WHEN 2 THEN 'x' || doc_id || '/deep/m' || doc_id || '.py' ELSE 'other/z' || doc_id || '.py' END AS p FROM documents), "
    "t AS (SELECT id, replace(module, '.', '/') AS m FROM i), "
    "d AS (SELECT id, p FROM t JOIN f ON p IN (m, m || '.py', m || '.pyi', m || '/__init__.py', 'src/' || m, 'src/' || m || '.py', 'src/' || m || '.pyi', 'src/' || m || '/__init__.py')), "
    "s AS (SELECT id, min(p) AS p FROM t JOIN f ON contains(m, '/') AND (p = m || '.py' OR ends_with(p, '/' || m || '.py')) WHERE id NOT IN (SELECT id FROM d) GROUP BY 1 HAVING count(*) = 1) "
    "SELECT id, p AS target_file FROM d UNION ALL SELECT id, p FROM s",
)
def j20(spark, d):
    """Python imports of every tier: by root, by index file, by the suffix of a path."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    named = F.concat(F.when(k % 3 == 0, "m").when(k % 3 == 1, "pkg.m").otherwise("deep.m"), (k + 1).cast("string"))
    imports = docs.select(k.cast("string").alias("id"), F.lit("main.py").alias("file_path"), F.lit("python").alias("language"), named.alias("module"), F.lit("").alias("dots"), F.lit("").alias("language_hint"))
    path = F.when(k % 4 == 0, F.concat(F.lit("m"), k, F.lit(".py"))).when(k % 4 == 1, F.concat(F.lit("src/pkg/m"), k, F.lit("/__init__.py"))).when(k % 4 == 2, F.concat(F.lit("x"), k, F.lit("/deep/m"), k, F.lit(".py"))).otherwise(F.concat(F.lit("other/z"), k, F.lit(".py")))
    return graph.resolve_modules(imports, docs.select(path.alias("file_path")), Registry().languages).select("id", "target_file")


@query("j21_stem_search", "WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) AS stem FROM conversations) SELECT conv_id, turn, count(*) AS n FROM w JOIN (SELECT DISTINCT p_type AS stem FROM part UNION SELECT 'the' UNION SELECT 'tion') USING (stem) WHERE length(stem) >= 3 GROUP BY 1, 2")
def j21(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("stem"))
    stems = table(spark, d, "part").select(F.col("p_type").alias("stem")).unionByName(spark.createDataFrame([("the",), ("tion",)], "stem string")).distinct().filter(F.char_length("stem") >= 3)
    return words.join(stems, "stem").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


@query("j22_expansion_join", "SELECT a.conv_id, a.turn, b.text AS expansion FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn AND b.role = 'assistant'")
def j22(spark, d):
    c = table(spark, d, "conversations")
    more = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expansion"))
    return ev.with_expansions(c.select("conv_id", "turn"), more, ["conv_id", "turn"])


@query("a21_sum_of_counts", "SELECT sum(n)::BIGINT AS chunks, count(*) AS repos FROM (SELECT repo_id, count(*) AS n FROM file_snapshots GROUP BY 1)", True)
def a21(spark, d):
    return store(spark, d).file_snapshots.groupBy("repo_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("chunks"), F.count("*").alias("repos"))


@query("w7_first_symbol_per_file", "SELECT file_path, min(name) AS name FROM (SELECT file_path, name, row_number() OVER (PARTITION BY file_path ORDER BY line_start, id) AS n FROM chunks) WHERE n = 1 GROUP BY 1", True)
def w7(spark, d):
    return graph.first_by(store(spark, d).chunks, ["file_path"], ["line_start", "id"], "name")


@query("t4_pools", "WITH a AS (SELECT p_partkey, p_type, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100) SELECT p_partkey, p_retailprice FROM a WHERE p_partkey % 3 <> 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def t4(spark, d):
    """The limit comes before the filter, so the pool may end up short."""
    pool = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)
    return retrieval.kept_of_pool(pool, F.col("p_partkey") % 3 != 0, 50, "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query("t7_seeded_examples", "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(p_partkey || '|1'), p_partkey) AS n FROM part) SELECT p_partkey, p_brand FROM r WHERE n <= 3")
def t7(spark, d):
    return ev.stratified(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"], ["p_partkey"], 3, seed=1)


@query("u1_union_branches", f"SELECT 'head' AS side, count(*) AS n FROM {SEEN} WHERE {AT} UNION ALL SELECT 'base', count(*) FROM {SEEN} WHERE fs.repo_id = 1 AND fs.snapshot_sha = 'base'", True)
def u1(spark, d):
    s = store(spark, d)
    side = lambda sha: st.at_snapshots(s, repo_id=1, snapshot=sha).agg(F.count("*").alias("n")).select(F.lit(sha).alias("side"), "n")
    return side("head").unionByName(side("base"))


@query("f10_has_semantic_by_key", "SELECT vec_id % 7 AS key, max(label - 3 - vec_id % 7) <> 0 AS has_semantic FROM embeddings GROUP BY 1")
def f10_keys(spark, d):
    """Similarities from above zero to below: a key whose largest is 0 has none, one whose largest is negative has."""
    return ranking.has_semantic(table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("key"), (F.col("label") - 3 - F.col("vec_id") % 7).alias("semantic")), ["key"])


@query("f10_has_semantic", "SELECT max(label) <> 0 AS has FROM embeddings")
def f10(spark, d):
    return ranking.has_semantic(table(spark, d, "embeddings"), column="label").withColumnRenamed("has_semantic", "has")


@query("f17_instruction", "SELECT conv_id, turn, 'Find code: ' || text AS q FROM conversations")
def f17(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.instructed(F.col("text"), "Find code: ").alias("q"))


@query("f30_unnest", "SELECT l_orderkey, unnest(list(l_partkey ORDER BY l_linenumber, l_partkey)) AS part, unnest(range(count(*)))::INT AS pos FROM lineitem GROUP BY 1")
def f30(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return lists.select("l_orderkey", F.posexplode("x").alias("pos", "y")).select("l_orderkey", F.col("y.l_partkey").alias("part"), "pos")


@query("q4_list_symbols", f"SELECT {ROW} FROM {SEEN} WHERE fs.repo_id = 0 AND fs.snapshot_sha = 'head' AND c.file_path = (SELECT min(file_path) FROM file_snapshots WHERE repo_id = 0 AND snapshot_sha = 'head')", True)
def q4(spark, d):
    s = store(spark, d)
    path = s.file_snapshots.filter("repo_id = 0 and snapshot_sha = 'head'").agg(F.min("file_path")).first()[0]
    return plain(st.get_chunks(s, 0, "head", file_path=path))


@query("q9_embed", "SELECT count(*) AS n, count(*) AS embedded FROM chunks", True)
def q9(spark, d):
    done = plan.embed(store(spark, d), plan.hashed_vectors)
    return done.chunks.agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"))


@query("q15_tune", "WITH c AS (SELECT o_custkey AS q, o_orderkey AS id, o_totalprice / 500000 AS a, (o_orderkey % 13) / 12.0::DOUBLE AS b FROM orders), g AS (SELECT c.*, w FROM c, (SELECT w::DOUBLE AS w FROM (VALUES (0.0), (0.3), (0.7), (1.0)) v(w))), r AS (SELECT *, row_number() OVER (PARTITION BY w, q ORDER BY w * a + (1 - w) * b DESC, id) AS rank FROM g) SELECT w, count(*) AS n, round(avg(1.0 / rank), 8) AS mrr FROM r WHERE id % 5 = 0 GROUP BY 1")
def q15(spark, d):
    """A grid over the weight instead of trials: every weight rescored in one job."""
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("a"), (F.col("o_orderkey") % 13 / F.lit(12.0)).alias("b"))
    grid = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (1.0,)], "w double")
    scored = ev.with_settings(c, grid).withColumn("score", F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b"))
    ranked = retrieval.per_query_top(scored, 1 << 30, ["w", "q"])
    return ranked.filter("id % 5 = 0").groupBy("w").agg(F.count("*").alias("n"), F.round(F.avg(1 / F.col("rank")), 8).alias("mrr"))


@query("k18_parquet_sink", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def k18(spark, d):
    path = scratch_path(spark, "report")
    table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).write.parquet(path)
    return spark.read.parquet(path)


@query("k15_compaction", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM chunks", True)
def k15(spark, d):
    from tessera.plans import tables

    root = scratch_path(spark, "compacted")
    tables.commit(store(spark, d), root, {"chunks": 2})
    return tables.load(spark, root).chunks.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


for _r, _t in REPOS:

    @query("st1_changed_since" + _t, at_repo(f"SELECT c.id FROM {SEEN} WHERE {AT} AND c.file_path IN (SELECT coalesce(b.file_path, h.file_path) FROM (SELECT * FROM file_snapshots WHERE repo_id = 1 AND snapshot_sha = 'base') b FULL JOIN (SELECT * FROM file_snapshots WHERE repo_id = 1 AND snapshot_sha = 'head') h ON b.file_path = h.file_path WHERE b.blob_sha IS DISTINCT FROM h.blob_sha)", _r), True)
    def st1(spark, d, r=_r):
        s = store(spark, d)
        return st.at_snapshots(s, repo_id=r, snapshot="head").join(st.changed_files(s, r, "base", "head"), "file_path", "left_semi").select("id")


@query("q8_build")
def q8(spark, d):
    """Documents as files of one snapshot: detection, windows and sections, ids, edges."""
    from tessera.catalog.fixture import documents
    from tessera.plans import tables

    files = documents(spark, d).select("file_path", F.col("text").alias("content"))
    made = plan.build(tables.empty(spark), 1, "head", files)
    return made.chunks.groupBy("language", "kind").agg(F.count("*").alias("n"))


_TEXT_FILES = "f0 AS (SELECT 'notes/' || doc_id || '.txt' AS file_path, text AS content, md5(text) AS blob_sha FROM documents WHERE text IS NOT NULL), l0 AS (SELECT *, string_split(content, chr(10)) AS l FROM f0), s0 AS (SELECT *, unnest(range(0, len(l), 45)) AS s FROM l0), w0 AS (SELECT file_path, blob_sha, s, least(s + 50, len(l)) AS e, array_to_string(l[s + 1:s + 50], chr(10)) AS body FROM s0)"


@query(
    "q8_build_text",
    f"WITH {_TEXT_FILES}, kept AS (SELECT *, file_path || ':' || (s + 1) || '-' || e AS name FROM w0 WHERE regexp_matches(body, '\\S')) "
    "SELECT substr(sha256(file_path || ':' || blob_sha || ':' || name || ':' || s), 1, 16) AS id, file_path, 'raw_chunk' AS kind, name, language, (s + 1)::INT AS line_start, e::INT AS line_end FROM kept, (SELECT '' AS language) "
    "UNION ALL SELECT substr(sha256(file_path || ':' || blob_sha || ':' || file_path || ':host:0'), 1, 16), file_path, 'raw_chunk', file_path || ':host', '', 1, 1 FROM f0 WHERE file_path NOT IN (SELECT file_path FROM kept)",
)
def q8_text(spark, d):
    """Every document as a file of plain text, built into an index: line windows with their ids, and a row for a file without any."""
    from tessera.plans import tables

    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    files = docs.select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))
    made = plan.build(tables.empty(spark), 1, "head", files)
    return made.chunks.select("id", "file_path", "kind", "name", "language", "line_start", "line_end")
