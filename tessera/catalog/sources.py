"""Queries of sources and row generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.fixture import PATH, documents, table
from tessera.catalog.registry import query
from tessera.functions.paths import ignored
from tessera.functions.text import first_sentence
from tessera.operators import chunking
from tessera.operators import store as st
from tessera.sources.files import MAX_FILE_BYTES, admitted, footprint_by
from tessera.sources.languages import Registry, resolve_language
from tessera.sources.symbols import extract_symbols

FILES = f"(SELECT doc_id, text, lang, source, {PATH} AS file_path FROM documents)"
IGNORE = ["vendor/", "*.toml", "!c1*.toml", "/docs/fr/**"]


@query("s1_admitted_files", f"SELECT file_path, md5(text) AS blob_sha FROM {FILES} WHERE strlen(text) <= {MAX_FILE_BYTES} AND NOT contains(file_path, 'vendor/') AND NOT (file_path LIKE '%.toml' AND NOT regexp_matches(file_path, '(^|/)c1[^/]*\\.toml$')) AND NOT file_path LIKE 'docs/fr/%'")
def s1(spark, d):
    files = documents(spark, d).select("file_path", F.col("text").cast("binary").alias("content")).filter(F.octet_length("content") <= MAX_FILE_BYTES)
    return admitted(files, IGNORE).select("file_path", F.md5("content").alias("blob_sha"))


@query("s2_ignore_rules", f"SELECT file_path, contains(file_path, 'vendor/') OR (file_path LIKE '%.toml' AND NOT regexp_matches(file_path, '(^|/)c1[^/]*\\.toml$')) OR file_path LIKE 'docs/fr/%' AS ignored FROM {FILES}")
def s2(spark, d):
    return documents(spark, d).select("file_path", ignored(F.col("file_path"), IGNORE).alias("ignored"))


@query("s12_parquet_parts", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents")
def s12(spark, d):
    from tessera.sources.files import read_parts

    return read_parts(spark, f"{d}/documents.parquet").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s14_footprint", "SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def s14(spark, d):
    return footprint_by(table(spark, d, "documents"), "source", "text")


@query("s15_detect_language", f"SELECT file_path, CASE regexp_extract(file_path, '(\\.[^.]+)$', 1) WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.js' THEN 'javascript' WHEN '.toml' THEN 'toml' WHEN '.go' THEN 'go' ELSE '' END AS language FROM {FILES}")
def s15(spark, d):
    return documents(spark, d).select("file_path", Registry().detect(F.col("file_path")).alias("language"))


_MARKED = "CASE doc_id % 4 WHEN 0 THEN '# A' || chr(10) || text WHEN 1 THEN 'A' || chr(10) || '=====' || chr(10) || text WHEN 2 THEN text ELSE '## B' || chr(10) || 'C' || chr(10) || '----' END"


@query("s16_prose_markup", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'rst' WHEN 3 THEN 'markdown' END AS markup FROM documents")
def s16(spark, d):
    marked = F.expr(_MARKED.replace("chr(10)", "'\\n'"))
    return table(spark, d, "documents").select("doc_id", chunking.prose_markup(marked).alias("markup"))


@query("s17_resolve_language", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'python' END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN lang END, ''), 'markdown') AS language FROM documents")
def s17(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", resolve_language(F.when(k % 3 == 0, "").otherwise("python"), F.when(k % 2 == 0, F.col("lang")), F.lit("markdown")).alias("language"))


@query("s19_resolve_refs", "SELECT r.ref, coalesce(a.sha, b.sha, CASE WHEN regexp_full_match(r.ref, '[0-9a-fA-F]{40}') THEN r.ref END) AS sha FROM (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'x' || s_suppkey WHEN 2 THEN sha1(s_name) ELSE 'none' END AS ref FROM supplier) r LEFT JOIN (SELECT s_name AS name, md5(s_name) AS sha FROM supplier WHERE s_suppkey % 4 = 0) a ON a.name = r.ref LEFT JOIN (SELECT 'origin/x' || s_suppkey AS name, md5(s_name) AS sha FROM supplier) b ON b.name = 'origin/' || r.ref")
def s19(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    wanted = s.select(F.when(k % 4 == 0, F.col("s_name")).when(k % 4 == 1, F.concat(F.lit("x"), k)).when(k % 4 == 2, F.sha1("s_name")).otherwise("none").alias("ref")).distinct()
    known = s.filter(k % 4 == 0).select(F.col("s_name").alias("name"), F.md5("s_name").alias("sha")).unionByName(s.select(F.concat(F.lit("origin/x"), k).alias("name"), F.md5("s_name").alias("sha")))
    return st.resolve_refs(wanted, known)


@query("s20_names_for_commits", "SELECT c_nationkey::VARCHAR AS sha, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS names FROM customer GROUP BY 1")
def s20(spark, d):
    refs = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("sha"), F.col("c_mktsegment").alias("name"))
    return st.names_for_commits(refs).select("sha", F.array_join("names", ",").alias("names"))


_WINDOWS = "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), w AS (SELECT doc_id, l, unnest(range(0, len(l), {step})) AS s FROM t), c AS (SELECT doc_id, s, least(s + {n}, len(l)) AS e, regexp_replace(array_to_string(l[s + 1:s + {n}], chr(10)), '^\\s+|\\s+$', '', 'g') AS chunk FROM w) SELECT doc_id, (s + 1)::INT AS line_start, e::INT AS line_end, concat(doc_id, ':', s + 1, '-', e) AS name, md5(chunk) AS chunk_md5 FROM c WHERE chunk <> ''"

for _n, _o in ((50, 5), (4, 1)):

    @query(f"x1_line_windows_{_n}", _WINDOWS.format(n=_n, step=_n - _o))
    def x1(spark, d, n=_n, o=_o):
        docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
        return chunking.line_windows(docs, lines=n, overlap=o).select("doc_id", "line_start", "line_end", "name", F.md5("chunk").alias("chunk_md5"))


@query("x3_comment_runs", "SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM (SELECT user_id, event_id, CASE WHEN event_id > lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 30 THEN 1 WHEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)")
def x3(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") + 29).alias("end"))
    return chunking.comment_runs(e, "user_id", "event_id", "end").select("user_id", "event_id", "run")


_HEADED = "h AS (SELECT doc_id::VARCHAR AS file_path, '# Top' || chr(10) || regexp_replace(text, '(?m)^(\\w+) (.*)$', '## \\1' || chr(10) || '\\2', 'g') AS content FROM documents WHERE text IS NOT NULL)"


@query(
    "x6_markdown_sections",
    f"WITH {_HEADED}, l AS (SELECT file_path, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS n FROM h), "
    "f AS (SELECT *, sum(regexp_matches(line, '^\\s*(```|~~~)')::INT) OVER (PARTITION BY file_path ORDER BY n) % 2 = 1 AS fenced FROM l), "
    "m AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '^ {0,3}#{1,6}(\\s|$)') THEN length(regexp_extract(line, '^ *(#+)', 1)) END AS level FROM f), "
    "s AS (SELECT *, count(level) OVER (PARTITION BY file_path ORDER BY n) AS section FROM m), "
    "head AS (SELECT file_path, section, level, n, regexp_replace(regexp_replace(line, '^\\s*#+\\s*', ''), '\\s+#*\\s*$', '') AS name FROM s WHERE level IS NOT NULL), "
    "body AS (SELECT file_path, section, string_agg(line, chr(10) ORDER BY n) AS content FROM s WHERE section > 0 GROUP BY 1, 2), "
    # only levels 1 and 2 occur, and level 1 once a file, at its top
    "scope AS (SELECT file_path, name AS top FROM head WHERE level = 1) "
    "SELECT file_path, name, CASE WHEN level > 1 THEN top ELSE '' END AS scope, level::INT AS level, (n + 1)::INT AS line_start, content FROM head JOIN body USING (file_path, section) JOIN scope USING (file_path)",
)
def x6(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.regexp_replace("text", r"(?m)^(\w+) (.*)$", "## $1\n$2").alias("content"))
    return chunking.markdown_sections(docs.withColumn("content", F.concat(F.lit("# Top\n"), "content")))


@query("x7_markdown_links", "SELECT DISTINCT doc_id::VARCHAR AS file_path, 'p' || doc_id || '.md' AS module, lang AS names FROM documents UNION SELECT DISTINCT doc_id::VARCHAR, '../' || source, '' FROM documents")
def x7(spark, d):
    body = F.concat(F.lit("see [a](p"), "doc_id", F.lit(".md#"), "lang", F.lit(") and [b](../"), "source", F.lit(") not [c](http://x.y) ![i](z.png) [d](#e)"))
    return chunking.markdown_links(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), body.alias("content")))


_CODE = "'import os' || chr(10) || chr(10) || '# about' || chr(10) || 'def f' || doc_id || '(a):' || chr(10) || '    return a' || chr(10) || chr(10) || 'class C' || doc_id || ':' || chr(10) || '    def m(self):' || chr(10) || '        pass' || chr(10)"


@query(
    "x2_extract_symbols",
    f"WITH f AS (SELECT 'm' || doc_id || '.py' AS file_path, md5({_CODE}) AS blob_sha, doc_id FROM documents), s AS ("
    "SELECT *, 'import' AS kind, 'import os' AS name, '' AS scope, 1 AS line_start, 1 AS line_end, 'import os' AS name_tokens FROM f "
    "UNION ALL SELECT *, 'function', 'f' || doc_id, '', 3, 5, 'f' || doc_id || ' f ' || doc_id FROM f "
    "UNION ALL SELECT *, 'class', 'C' || doc_id, '', 7, 9, 'c' || doc_id || ' c ' || doc_id FROM f "
    "UNION ALL SELECT *, 'method', 'm', 'C' || doc_id, 8, 9, 'm' FROM f) "
    "SELECT file_path, substr(sha256(file_path || ':' || blob_sha || ':' || name || ':' || (line_start - 1)), 1, 16) AS id, kind, name, scope, line_start::INT AS line_start, line_end::INT AS line_end, name_tokens FROM s",
)
def x2(spark, d):
    docs = table(spark, d, "documents")
    code = F.concat(F.lit("import os\n\n# about\ndef f"), "doc_id", F.lit("(a):\n    return a\n\nclass C"), "doc_id", F.lit(":\n    def m(self):\n        pass\n"))
    files = docs.select(F.concat(F.lit("m"), "doc_id", F.lit(".py")).alias("file_path"), F.md5(code).alias("blob_sha"), F.lit("python").alias("language"), code.alias("content"))
    return extract_symbols(files, Registry().serials()).select("file_path", "id", "kind", "name", "scope", "line_start", "line_end", "name_tokens")


@query("x13_symbol_queries", "WITH s AS (SELECT p_partkey, p_name, p_type FROM part) SELECT p_partkey, 'name' AS provenance, p_name AS text FROM s UNION ALL SELECT p_partkey, 'body', p_type || ' of brand ' || p_name FROM s WHERE length(p_type || ' of brand ' || p_name) >= 15")
def x13(spark, d):
    part = table(spark, d, "part")
    body = first_sentence(F.concat("p_type", F.lit(" of brand "), "p_name"))
    rows = F.explode(F.array(F.struct(F.lit("name").alias("provenance"), F.col("p_name").alias("text")), F.struct(F.lit("body").alias("provenance"), body.alias("text"))))
    return part.select("p_partkey", rows.alias("r")).select("p_partkey", "r.provenance", "r.text").filter(F.col("text").isNotNull())
