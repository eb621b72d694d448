"""Queries of the index: scans, joins, mutations, diffs, collection, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.fixture import documents, refs, some_ids, store, table
from tessera.catalog.registry import query
from tessera.operators import diff, gc, graph
from tessera.operators import store as st
from tessera.plans import build as plan
from tessera.plans import search as hybrid
from tessera.session import written
from tessera.sources.languages import Registry

AT = "fs.repo_id = 1 AND fs.snapshot_sha = 'head'"
SEEN = "chunks c JOIN file_snapshots fs ON c.blob_sha = fs.blob_sha AND c.file_path = fs.file_path"
ROW = "c.id, fs.repo_id, c.blob_sha, c.file_path, c.kind, c.name, c.scope, c.language, c.content, c.line_start, c.line_end, c.has_embedding"
REFS = "((fs.repo_id = 0 AND fs.snapshot_sha = 'head') OR (fs.repo_id = 1 AND fs.snapshot_sha = 'base'))"
EREFS = REFS.replace("fs.", "e.")
TWO = ((0, "head"), (1, "base"))
#: Repository 1 is empty at head by the fixture's rule, which is a case of its own; 5 holds files there.
REPOS = ((1, ""), (5, "_filled"))


def at_repo(sql: str, repo_id: int) -> str:
    return sql.replace("repo_id = 1", f"repo_id = {repo_id}")


def plain(df):
    """Without the metadata struct, which the fixture leaves empty."""
    return df.drop("metadata")


@query("s3_changed_files", "SELECT coalesce(b.file_path, h.file_path) AS file_path FROM (SELECT * FROM file_snapshots WHERE repo_id = 1 AND snapshot_sha = 'base') b FULL JOIN (SELECT * FROM file_snapshots WHERE repo_id = 1 AND snapshot_sha = 'head') h ON b.file_path = h.file_path WHERE b.blob_sha IS DISTINCT FROM h.blob_sha", True)
def s3(spark, d):
    return st.changed_files(store(spark, d), 1, "base", "head")


@query("s4_read_blob", "SELECT blob_sha, content FROM c1 WHERE snapshot_sha = 'head' AND doc_id = 12", True)
def s4(spark, d):
    s = store(spark, d)
    return st.read_blob(s, "head", s.file_snapshots.filter(F.col("file_path").rlike(r"/m12\.py$")))


for _r, _t in REPOS:

    @query("s5_get_chunks" + _t, at_repo(f"SELECT {ROW} FROM {SEEN} WHERE {AT}", _r), True)
    def s5(spark, d, r=_r):
        return plain(st.get_chunks(store(spark, d), r, "head"))


@query("p2_optional_predicates", f"SELECT {ROW} FROM {SEEN} WHERE fs.repo_id = 0 AND fs.snapshot_sha = 'head' AND c.kind = 'function'", True)
def p2(spark, d):
    return plain(st.get_chunks(store(spark, d), 0, "head", kind="function"))


for _r, _t in REPOS:

    @query("s6_content_frame" + _t, at_repo(f"SELECT c.id, c.file_path, c.kind, c.name, c.line_start, c.content FROM {SEEN} WHERE {AT}", _r), True)
    def s6(spark, d, r=_r):
        return st.get_chunks(store(spark, d), r, "head").select("id", "file_path", "kind", "name", "line_start", "content")


@query("s7_unembedded", f"SELECT c.id, c.name, c.content, c.file_path, c.line_start FROM {SEEN} WHERE fs.repo_id = 0 AND fs.snapshot_sha = 'head' AND NOT c.has_embedding ORDER BY c.file_path, c.line_start, c.id LIMIT 50", True)
def s7(spark, d):
    return st.get_unembedded(store(spark, d), 0, "head", 50)


@query("s8_get_edges", f"SELECT e.repo_id, source_id, target_id, kind, snapshot_sha FROM edges e WHERE {EREFS} AND kind = 'imports'", True)
def s8(spark, d):
    return st.get_edges(store(spark, d), refs(spark, *TWO), kind="imports").select("repo_id", "source_id", "target_id", "kind", "snapshot_sha")


@query("s9_list_repos", "SELECT r.id, path, count(w.ref) AS watched FROM repos r LEFT JOIN watched_refs w ON r.id = w.repo_id GROUP BY r.id, path", True)
def s9(spark, d):
    s = store(spark, d)
    return st.list_repos(s)


@query("s9_snapshot_language", "SELECT detected_language FROM file_snapshots WHERE repo_id = (SELECT repo_id FROM d WHERE doc_id = 12) AND file_path LIKE '%/m12.py' ORDER BY snapshot_sha LIMIT 1", True)
def s9_language(spark, d):
    s = store(spark, d)
    return st.snapshot_languages(s, documents(spark, d).filter("doc_id = 12")).select("detected_language")


@query("s10_has_indexed", "SELECT r.id, count(*) FILTER (i.snapshot_sha = 'head') > 0 AS has_head, count(i.snapshot_sha) > 0 AS has_any FROM repos r LEFT JOIN indexed_snapshots i ON r.id = i.repo_id GROUP BY r.id", True)
def s10(spark, d):
    return st.indexed_flags(store(spark, d), "head").withColumnRenamed("has", "has_head")


@query("s13_all_content", "SELECT file_path, name, line_start, content FROM chunks", True)
def s13(spark, d):
    return st.all_content(store(spark, d))


@query("s18_chunk_paths", "SELECT id, file_path FROM chunks WHERE id IN (SELECT id FROM chunks WHERE file_path LIKE 'docs/%')", True)
def s18(spark, d):
    s = store(spark, d)
    return st.chunk_paths(s, some_ids(s))


@query("j1_snapshot_resolution", f"SELECT fs.repo_id, fs.snapshot_sha, count(*) AS n, count(DISTINCT c.id) AS ids FROM {SEEN} GROUP BY 1, 2", True)
def j1(spark, d):
    return st.at_snapshots(store(spark, d)).groupBy("repo_id", "snapshot_sha").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("j2_refs_join", f"SELECT c.id, fs.repo_id, c.file_path FROM {SEEN} WHERE {REFS}", True)
def j2(spark, d):
    return st.at_snapshots(store(spark, d), refs(spark, *TWO)).select("id", "repo_id", "file_path")


@query("j7_inbound_refs", f"SELECT e.source_id, e.target_id, e.kind, e.repo_id, c.file_path, c.kind AS source_kind, c.name, c.line_start FROM edges e JOIN chunks c ON e.source_id = c.id WHERE {EREFS} AND e.target_id IN (SELECT id FROM chunks WHERE file_path LIKE 'docs/%')", True)
def j7(spark, d):
    s = store(spark, d)
    return st.inbound_refs(s, refs(spark, *TWO), some_ids(s))


@query("a2_inbound_degree", f"SELECT target_id AS id, count(*) AS degree FROM edges e WHERE {EREFS} GROUP BY 1", True)
def a2(spark, d):
    return st.inbound_degree(store(spark, d), refs(spark, *TWO))


@query(
    "j8_blob_is_current",
    "SELECT w.blob_sha, count(*) FILTER (c.language = w.language) > 0 AND count(*) FILTER (c.language IS NOT NULL AND v.language IS NULL) = 0 AS up_to_date "
    "FROM (SELECT DISTINCT blob_sha, 'en' AS language FROM chunks) w LEFT JOIN chunks c ON w.blob_sha = c.blob_sha "
    "LEFT JOIN (VALUES ('en', 1), ('en', 2), ('fr', 1), ('de', 3)) v(language, extraction_serial) ON c.language = v.language AND c.extraction_serial = v.extraction_serial GROUP BY 1",
    True,
)
def j8(spark, d):
    s = store(spark, d)
    serials = spark.createDataFrame([("en", 1), ("en", 2), ("fr", 1), ("de", 3)], "language string, extraction_serial int")
    return st.blobs_current(s, s.chunks.select("blob_sha", F.lit("en").alias("language")).distinct(), serials)


@query("a1_counts", f"SELECT fs.repo_id, fs.snapshot_sha, count(*) AS total, count(*) FILTER (c.has_embedding) AS embedded FROM {SEEN} GROUP BY 1, 2", True)
def a1(spark, d):
    return st.snapshot_status(store(spark, d))


@query("w9_latest_snapshot", "SELECT repo_id, max_by(snapshot_sha, indexed_at) AS snapshot_sha, max(indexed_at) AS indexed_at FROM indexed_snapshots GROUP BY 1", True)
def w9(spark, d):
    return st.latest_snapshots(store(spark, d))


DIFF = """WITH h AS (SELECT {row} FROM {seen} WHERE fs.repo_id = {repo} AND fs.snapshot_sha = 'head' AND c.kind IN ('function', 'class', 'method') {scope}),
b AS (SELECT {row} FROM {seen} WHERE fs.repo_id = {repo} AND fs.snapshot_sha = 'base' AND c.kind IN ('function', 'class', 'method') {scope})
SELECT 'added' AS change_kind, * FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.file_path, b.name, b.scope) = (h.file_path, h.name, h.scope))
UNION ALL SELECT 'removed', * FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE (b.file_path, b.name, b.scope) = (h.file_path, h.name, h.scope))
UNION ALL SELECT 'modified', * FROM h WHERE EXISTS (SELECT 1 FROM b WHERE (b.file_path, b.name, b.scope) = (h.file_path, h.name, h.scope))
AND NOT EXISTS (SELECT 1 FROM b WHERE (b.file_path, b.name, b.scope, b.content) = (h.file_path, h.name, h.scope, h.content))"""


@query("q6_diff_symbols", DIFF.format(row=ROW, seen=SEEN, repo=0, scope=""), True)
def q6(spark, d):
    return plain(diff.diff_symbols(store(spark, d), 0, "base", "head"))


@query("p3_diff_scoped", DIFF.format(row=ROW, seen=SEEN, repo=0, scope="AND c.file_path LIKE 'src/%'"), True)
def p3(spark, d):
    s = store(spark, d)
    return plain(diff.diff_symbols(s, 0, "base", "head", s.file_snapshots.filter(F.col("file_path").like("src/%")).select("file_path").distinct()))


# --- mutations ------------------------------------------------------------------

STAGED = "SELECT id, blob_sha, file_path, kind, upper(name) AS name, language, line_start FROM chunks WHERE doc_id % 3 = 0"


@query("k1_upsert_chunks", f"WITH stg AS ({STAGED}) SELECT c.id, coalesce(s.name, c.name) AS name, c.has_embedding, coalesce(c.embedding_truncated, false) AS embedding_truncated FROM chunks c LEFT JOIN stg s ON c.id = s.id", True)
def k1(spark, d):
    s = store(spark, d)
    staged = s.chunks.filter(F.regexp_extract("file_path", r"(\d+)\.\w+$", 1).cast("long") % 3 == 0).withColumns({"name": F.upper("name"), "embedding": F.lit(None).cast("array<float>"), "embedding_truncated": F.lit(False)})
    out = st.upsert_chunks(s.chunks, staged)
    return out.select("id", "name", F.col("embedding").isNotNull().alias("has_embedding"), "embedding_truncated")


@query("k2_replace_snapshots", "SELECT repo_id, snapshot_sha, file_path, CASE WHEN repo_id = 1 THEN 'new' ELSE blob_sha END AS blob_sha FROM file_snapshots", True)
def k2(spark, d):
    s = store(spark, d)
    rows = s.file_snapshots.filter("repo_id = 1").withColumn("blob_sha", F.lit("new"))
    return st.replace_rows(s.file_snapshots, rows, ["repo_id", "snapshot_sha", "file_path"]).drop("detected_language")


@query("k3_insert_edges", "SELECT repo_id, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT * FROM edges UNION ALL SELECT repo_id, target_id, source_id, kind, snapshot_sha FROM edges WHERE repo_id < 3)) GROUP BY 1", True)
def k3(spark, d):
    s = store(spark, d)
    extra = s.edges.filter("repo_id < 3").select("repo_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "kind", "snapshot_sha")
    out = st.insert_missing(s.edges, extra, ["repo_id", "source_id", "target_id", "kind", "snapshot_sha"])
    return out.groupBy("repo_id").agg(F.count("*").alias("n"))


@query("k4_update_embeddings", "SELECT id, CASE WHEN file_path LIKE 'docs/%' THEN 2 ELSE coalesce(len(embedding), 0) END::INT AS size, CASE WHEN file_path LIKE 'docs/%' THEN true ELSE embedding_truncated END AS truncated FROM chunks", True)
def k4(spark, d):
    s = store(spark, d)
    vectors = some_ids(s).select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), F.lit(True).alias("truncated"))
    return st.update_embeddings(s.chunks, vectors).select("id", F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0)).alias("size"), F.col("embedding_truncated").alias("truncated"))


@query("k5_clear_embeddings", "SELECT count(*) AS n, 0::BIGINT AS embedded, 0::BIGINT AS truncated FROM chunks", True)
def k5(spark, d):
    return st.clear_embeddings(store(spark, d).chunks).agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"), F.count_if("embedding_truncated").alias("truncated"))


@query("k6_mark_indexed", "SELECT * FROM indexed_snapshots WHERE NOT (repo_id = 1 AND snapshot_sha = 'head') UNION ALL SELECT 1, 'head', TIMESTAMP '2024-02-01 00:00:00'", True)
def k6(spark, d):
    return st.mark_indexed(store(spark, d).indexed_snapshots, 1, "head", F.expr("timestamp '2024-02-01 00:00:00'"))


@query("k7_replace_edges", "SELECT repo_id, snapshot_sha, count(*) AS n FROM edges WHERE NOT (repo_id = 1 AND snapshot_sha = 'head') GROUP BY 1, 2 UNION ALL SELECT 1, 'head', count(*) FROM edges WHERE repo_id = 1 AND snapshot_sha = 'head' AND kind = 'imports' HAVING count(*) > 0", True)
def k7(spark, d):
    s = store(spark, d)
    out = st.replace_snapshot(s.edges, 1, "head", s.edges.filter("repo_id = 1 and snapshot_sha = 'head' and kind = 'imports'"))
    return out.groupBy("repo_id", "snapshot_sha").agg(F.count("*").alias("n"))


@query("k8_delete_for_blobs", "SELECT id FROM chunks WHERE blob_sha NOT IN (SELECT blob_sha FROM file_snapshots WHERE repo_id = 1)", True)
def k8(spark, d):
    s = store(spark, d)
    return s.chunks.join(s.file_snapshots.filter("repo_id = 1").select("blob_sha").distinct(), "blob_sha", "left_anti").select("id")


DROP = "(fs.repo_id % 2 = 0 AND fs.snapshot_sha = 'base')"


@query("k9_drop_snapshots", f"SELECT 'chunks' AS t, count(*) AS n FROM chunks c WHERE EXISTS (SELECT 1 FROM file_snapshots fs WHERE NOT {DROP} AND fs.blob_sha = c.blob_sha AND fs.file_path = c.file_path) UNION ALL SELECT 'files', count(*) FROM file_snapshots fs WHERE NOT {DROP} UNION ALL SELECT 'edges', count(*) FROM edges fs WHERE NOT {DROP} UNION ALL SELECT 'snapshots', count(*) FROM indexed_snapshots fs WHERE NOT {DROP}", True)
def k9(spark, d):
    s = store(spark, d)
    return _sizes(gc.drop_snapshots(s, _dropped(s)))


def _dropped(s):
    return s.indexed_snapshots.filter("repo_id % 2 = 0 and snapshot_sha = 'base'").select("repo_id", "snapshot_sha")


def _sizes(s):
    out = None
    for name, t in (("chunks", s.chunks), ("files", s.file_snapshots), ("edges", s.edges), ("snapshots", s.indexed_snapshots)):
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a8_gc_chunk_split", f"WITH cand AS (SELECT DISTINCT c.id, c.blob_sha, c.file_path FROM {SEEN} WHERE {DROP}), kept AS (SELECT DISTINCT id FROM cand JOIN file_snapshots fs ON cand.blob_sha = fs.blob_sha AND cand.file_path = fs.file_path WHERE NOT {DROP}) SELECT (SELECT count(*) FROM cand) - (SELECT count(*) FROM kept) AS dropped, (SELECT count(*) FROM kept) AS kept", True)
def a8(spark, d):
    s = store(spark, d)
    return gc.chunk_split(s, _dropped(s))


@query("k10_sweep_incomplete", "SELECT repo_id, snapshot_sha, count(*) AS n FROM file_snapshots fs WHERE EXISTS (SELECT 1 FROM indexed_snapshots i WHERE i.repo_id = fs.repo_id AND i.snapshot_sha = fs.snapshot_sha) GROUP BY 1, 2", True)
def k10(spark, d):
    return st.sweep_incomplete(store(spark, d)).file_snapshots.groupBy("repo_id", "snapshot_sha").agg(F.count("*").alias("n"))


@query("k12_forget_repo", "SELECT 'chunks' AS t, count(*) AS n FROM chunks UNION ALL SELECT 'files', count(*) FROM file_snapshots WHERE repo_id <> 1 UNION ALL SELECT 'edges', count(*) FROM edges WHERE repo_id <> 1 UNION ALL SELECT 'snapshots', count(*) FROM indexed_snapshots WHERE repo_id <> 1", True)
def k12(spark, d):
    return _sizes(st.forget_repo(store(spark, d), 1))


@query("k13_register_repos", "SELECT id, path FROM repos UNION ALL SELECT (SELECT max(id) FROM repos) + row_number() OVER (ORDER BY path), path FROM (VALUES ('/new/a'), ('/new/b')) v(path)", True)
def k13(spark, d):
    paths = spark.createDataFrame([("/new/b",), ("/new/a",), ("/repos/src1",), ("/new/a",)], "path string")
    return st.register_repos(store(spark, d).repos, paths).withColumn("id", F.col("id").cast("long"))


@query("k14_watch", "SELECT repo_id, ref FROM watched_refs WHERE NOT (repo_id = 2) UNION SELECT id, 'dev' FROM repos WHERE id < 3", True)
def k14(spark, d):
    s = store(spark, d)
    more = s.repos.filter("id < 3").select(F.col("id").alias("repo_id"), F.lit("dev").alias("ref"))
    return st.insert_missing(st.delete_where(s.watched_refs, F.col("repo_id") == 2), more, ["repo_id", "ref"])


@query("j10_orphans", "SELECT c.id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM file_snapshots fs WHERE fs.snapshot_sha = 'head' AND fs.blob_sha = c.blob_sha AND fs.file_path = c.file_path)", True)
def j10(spark, d):
    s = store(spark, d)
    return st.orphan_chunks(s.but(file_snapshots=s.file_snapshots.filter("snapshot_sha = 'head'"))).select("id")


@query("j10_orphan_repos", "SELECT DISTINCT repo_id FROM file_snapshots fs WHERE NOT EXISTS (SELECT 1 FROM indexed_snapshots i WHERE i.repo_id = fs.repo_id AND i.snapshot_sha = fs.snapshot_sha)", True)
def j10_repos(spark, d):
    return st.orphan_repo_ids(store(spark, d))


@query("j11_prune_edges", "SELECT repo_id, count(*) AS n FROM edges WHERE repo_id <> 0 OR snapshot_sha IN (SELECT snapshot_sha FROM file_snapshots WHERE repo_id = 0 AND snapshot_sha = 'head') GROUP BY 1", True)
def j11(spark, d):
    s = store(spark, d)
    live = s.but(file_snapshots=s.file_snapshots.filter("snapshot_sha = 'head'"))
    return st.prune_edges(live, 0).edges.groupBy("repo_id").agg(F.count("*").alias("n"))


def _gc_inputs(spark, s):
    heads = s.repos.select(F.col("id").alias("repo_id"), F.lit("head").alias("sha"))
    local = s.repos.filter("id % 2 = 0").select(F.col("id").alias("repo_id"), F.lit("refs/heads/main").alias("name"), F.lit("base").alias("sha"))
    return heads, local


for _mode, _keep in (("HEAD_ONLY", "snapshot_sha = 'head'"), ("WATCHED", "snapshot_sha = 'head' OR repo_id % 2 = 0"), ("WATCHED_ONLY", "snapshot_sha = 'head' OR repo_id % 2 = 0")):

    @query(f"k19_gc_{_mode.lower()}", f"SELECT repo_id, snapshot_sha FROM indexed_snapshots WHERE NOT ({_keep})", True)
    def k19(spark, d, mode=_mode):
        s = store(spark, d)
        heads, local = _gc_inputs(spark, s)
        return gc.drop_set(s, gc.keep_set(mode, heads, local, s.watched_refs))


@query("k19_gc_dry_run", f"WITH drop_ AS (SELECT fs.repo_id, fs.snapshot_sha FROM indexed_snapshots fs WHERE {DROP}), cand AS (SELECT DISTINCT c.id, c.blob_sha, c.file_path FROM {SEEN} WHERE {DROP}) SELECT (SELECT count(*) FROM drop_) AS snapshots, (SELECT count(*) FROM file_snapshots fs WHERE {DROP}) AS file_snapshots, (SELECT count(*) FROM edges fs WHERE {DROP}) AS edges, (SELECT count(*) FROM cand WHERE NOT EXISTS (SELECT 1 FROM file_snapshots fs WHERE NOT {DROP} AND fs.blob_sha = cand.blob_sha AND fs.file_path = cand.file_path)) AS chunks", True)
def k19_dry(spark, d):
    s = store(spark, d)
    return gc.dry_run(s, _dropped(s))


# --- reports and plans --------------------------------------------------------------

@query("q13_repo_report", "SELECT r.path, count(DISTINCT c.id) AS chunks, count(DISTINCT c.id) FILTER (c.has_embedding) AS embedded, count(DISTINCT c.id) FILTER (c.embedding_truncated) AS truncated, coalesce(any_value(e.n), 0) AS edges FROM repos r LEFT JOIN file_snapshots fs ON r.id = fs.repo_id LEFT JOIN chunks c ON c.blob_sha = fs.blob_sha AND c.file_path = fs.file_path LEFT JOIN (SELECT repo_id, count(*) AS n FROM edges GROUP BY 1) e ON e.repo_id = r.id GROUP BY 1", True)
def q13(spark, d):
    return plan.repo_report(store(spark, d))


for _by, _label in (("kind", "kind"), ("language", "CASE WHEN language = 'en' THEN '(plaintext)' ELSE language END")):

    @query(f"j17_{_by}_report", f"WITH c AS (SELECT id, {_label} AS g FROM chunks) SELECT g AS {_by}, count(*) AS n, coalesce(any_value(o.n), 0) AS outbound_edges, coalesce(any_value(i.n), 0) AS inbound_edges FROM c LEFT JOIN (SELECT g, count(*) AS n FROM edges JOIN c ON source_id = id GROUP BY 1) o USING (g) LEFT JOIN (SELECT g, count(*) AS n FROM edges JOIN c ON target_id = id GROUP BY 1) i USING (g) GROUP BY 1", True)
    def j17(spark, d, by=_by):
        s = store(spark, d)
        return plan.group_report(s.but(chunks=s.chunks.withColumn("language", F.when(F.col("language") == "en", "").otherwise(F.col("language")))), by)


@query("a4_totals", "SELECT count(*) AS total_chunks, count(*) FILTER (has_embedding) AS with_embedding, count(*) FILTER (embedding_truncated) AS truncated, (SELECT count(*) FROM edges) AS total_edges FROM chunks", True)
def a4(spark, d):
    return plan.totals(store(spark, d))


@query("j18_truncated_targets", f"SELECT DISTINCT r.path, c.file_path, c.scope, c.name, c.line_start FROM {SEEN} JOIN repos r ON r.id = fs.repo_id WHERE c.embedding_truncated", True)
def j18(spark, d):
    return plan.truncated_targets(store(spark, d))


@query("q18_pending_jobs", f"WITH want AS (SELECT id AS repo_id, 'head' AS snapshot_sha FROM repos), lack AS (SELECT fs.repo_id, fs.snapshot_sha FROM {SEEN} GROUP BY 1, 2 HAVING count(*) FILTER (NOT c.has_embedding) > 0) SELECT repo_id, snapshot_sha, 'build' AS job FROM want WHERE (repo_id, snapshot_sha) NOT IN (SELECT repo_id, snapshot_sha FROM indexed_snapshots) UNION ALL SELECT repo_id, snapshot_sha, 'embed' FROM want WHERE (repo_id, snapshot_sha) IN (SELECT repo_id, snapshot_sha FROM indexed_snapshots) AND (repo_id, snapshot_sha) IN (SELECT repo_id, snapshot_sha FROM lack)", True)
def q18(spark, d):
    s = store(spark, d)
    return plan.pending_jobs(s, s.repos.select(F.col("id").alias("repo_id"), F.lit("head").alias("snapshot_sha")))


@query("q21_missing_languages", "SELECT DISTINCT language FROM chunks WHERE language NOT IN ('en', 'fr')", True)
def q21(spark, d):
    from tessera.sources.languages import Language

    return plan.missing_languages(store(spark, d), Registry((Language("en"), Language("fr"))))


@query("q3_read_symbol", f"WITH r AS (SELECT {ROW}, CASE WHEN c.name = 'The' THEN 1 WHEN c.name ILIKE 'The' THEN 2 WHEN c.name ILIKE 'The%' THEN 3 ELSE 4 END AS t FROM {SEEN} WHERE {REFS} AND c.name ILIKE '%The%') SELECT * EXCLUDE (t) FROM r WHERE t = (SELECT min(t) FROM r)", True)
def q3(spark, d):
    return plain(hybrid.read_symbol(store(spark, d), refs(spark, *TWO), "The"))


@query(
    "e11_infer_edges",
    "WITH p AS (SELECT page_id, 'site/' || split_part(url, '/', 4) AS dir FROM pages), f AS (SELECT DISTINCT dir, page_id, dir || '/p' || page_id || '.html' AS path FROM p) "
    "SELECT 'i' || md5(a.path) AS source_id, md5(b.path) AS target_id, 'imports' AS kind FROM f a JOIN f b ON b.dir = a.dir AND b.page_id = a.page_id + 1",
)
def e11(spark, d):
    """Pages as files that import each other by relative links."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("site/"), F.element_at(F.split("url", "/"), 4), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), "html", "page_id")
    base = pages.select(F.md5("file_path").alias("id"), "file_path", F.lit("html").alias("language"), "page_id")
    none = F.lit("")
    meta = lambda module, names=none: F.struct(module.alias("module"), names.alias("names"), none.alias("dots"), none.alias("language_hint"))
    sections = base.select("id", "file_path", "language", F.lit("doc_section").alias("kind"), F.lit("body").alias("name"), F.lit(1).alias("line_start"), meta(none).alias("metadata"))
    links = base.select(F.concat(F.lit("i"), "id").alias("id"), "file_path", "language", F.lit("import").alias("kind"), F.lit("link").alias("name"), F.lit(1).alias("line_start"), meta(F.concat(F.lit("./p"), (F.col("page_id") + 1).cast("string"), F.lit(".html"))).alias("metadata"))
    return graph.infer_edges(written(sections.unionByName(links), "linked"), base.select("file_path"), Registry().languages)
