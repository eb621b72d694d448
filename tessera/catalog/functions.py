"""Queries of scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.fixture import table
from tessera.catalog.registry import query
from tessera.functions import paths as p
from tessera.functions import text as tx
from tessera.functions import vectors as v
from tessera.schema import CHUNK_KINDS

_IDENTS = "list_transform(regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x))"
_SPLIT = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({x}, '_'), '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'),"
    " '([0-9])([A-Za-z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')"
)
#: All tokens of a text: identifiers and their parts, distinct; order is compared in unit tests, not here.
TOKENS = (
    "list_sort(list_distinct(list_concat(" + _IDENTS + ", list_filter(list_transform(flatten(list_transform(regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: string_split("
    + _SPLIT.format(x="x") + ", '_'))), lambda y: lower(y)), lambda y: y <> ''))))"
)


@query("f1_tokenise_code", f"SELECT doc_id, array_to_string({TOKENS.format(t='text')}, ' ') AS tokens FROM documents")
def f1(spark, d):
    tokens = F.split(tx.tokenise_code(F.col("text")), " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.filter(tokens, lambda t: t != "")), " ").alias("tokens"))


_PARTS = ["small ring", "ring", "LARGE", "s", "ring small"]


@query(
    "f2_name_score",
    "SELECT p_partkey, q, CASE WHEN lower(p_name) = lower(q) THEN 1.0 WHEN starts_with(lower(p_name), lower(q)) THEN 0.8 WHEN contains(lower(p_name), lower(q)) THEN 0.5 "
    "WHEN len(string_split(q, ' ')) > 1 AND len(list_filter(string_split(lower(q), ' '), lambda t: NOT contains(lower(p_name), t))) = 0 THEN 0.4 ELSE 0.0 END::DOUBLE AS score "
    "FROM part, (VALUES ('small ring'), ('ring'), ('LARGE'), ('s'), ('ring small')) v(q)",
)
def f2(spark, d):
    asked = table(spark, d, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, _PARTS))).alias("q"))
    return asked.select("p_partkey", "q", tx.name_score(F.col("q"), F.col("p_name")).alias("score"))


@query("f3_kind_boost", "SELECT p_partkey, k, CASE k " + " ".join(f"WHEN '{k}' THEN {b}" for k, b in tx.KIND_BOOST.items()) + f" ELSE 1.0 END::DOUBLE AS boost FROM (SELECT p_partkey, ([{', '.join(repr(k) for k in CHUNK_KINDS)}, 'other'])[p_partkey % 13 + 1] AS k FROM part)")
def f3(spark, d):
    kinds = F.array(*map(F.lit, [*CHUNK_KINDS, "other"]))
    k = table(spark, d, "part").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 13 + 1).cast("int")).alias("k"))
    return k.select("p_partkey", "k", tx.kind_boost(F.col("k")).alias("boost"))


_PATHS = ["vendor/lib/a.py", "src/x_pb2.py", "a/b.gen.go", "src/tests/conftest.py", "test_a.py", "docs/guide.md", "pyproject.toml", "src/Main.java", "a/node_modules/x.js", "README.TXT", "app/contest.rs", "deploy.YAML"]


@query(
    "f4_file_penalty",
    f"SELECT p_partkey, f, CASE WHEN contains(f, 'vendor/') OR contains(f, 'node_modules/') OR contains(f, 'third_party/') THEN 0.3 WHEN f LIKE '%\\_pb2.py' ESCAPE '\\' OR f LIKE '%.pb.go' OR contains(f, '_generated.') OR contains(f, '.gen.') THEN 0.3 "
    "WHEN regexp_matches(f, 'test_|/tests/|_test\\.|/test/|tests\\.|conftest\\.') THEN 0.5 WHEN regexp_matches(f, '\\.(md|rst|txt|adoc)$') THEN 0.8 WHEN regexp_matches(f, '\\.(json|yaml|yml|toml|ini|cfg)$') THEN 0.7 ELSE 1.0 END::DOUBLE AS penalty "
    f"FROM (SELECT p_partkey, lower(([{', '.join(repr(x) for x in _PATHS)}])[p_partkey % {len(_PATHS)} + 1]) AS f FROM part)",
)
def f4(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % len(_PATHS) + 1).cast("int")).alias("f"))
    return f.select("p_partkey", F.lower("f").alias("f"), tx.file_penalty(F.col("f")).alias("penalty"))


@query("f5_importance", "SELECT l_partkey, round(least(1 + log2(1 + count(*)) / 4, 3.0), 9) AS importance FROM lineitem GROUP BY 1")
def f5(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).select("l_partkey", F.round(tx.importance(F.col("n")), 9).alias("importance"))


@query("f12_cosine", "SELECT a.vec_id, b.vec_id AS q, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id < 3")
def f12(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id < 3").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", "q", F.round(v.cosine(F.col("embedding"), F.col("qe")), 6).alias("cosine"))  # three query vectors


_KEYWORDS = ", ".join(f"'{k}'" for k in tx.CODE_KEYWORDS)
_SCORE = (
    "(CASE WHEN regexp_matches(q, '[{{}}]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(q, '\\w\\(') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(q, '==|!=|<=|>=|=>|->') THEN 2 ELSE 0 END + CASE WHEN contains(q, ';') THEN 2 ELSE 0 END"
    " + CASE WHEN regexp_matches(q, '<\\w') AND regexp_matches(q, '\\w>') THEN 2 WHEN regexp_matches(q, '<\\w') OR regexp_matches(q, '\\w>') THEN 1 ELSE 0 END + CASE WHEN NOT regexp_matches(q, '\\w\\(') AND regexp_matches(q, '[()]') THEN 1 ELSE 0 END"
    " + CASE WHEN regexp_matches(q, '\\w=\\w') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(q, '(?m):\\s*$') THEN 1 ELSE 0 END + CASE WHEN lower(regexp_extract(q, '^(\\S*)', 1)) IN ({k}) THEN 1 ELSE 0 END)"
)


@query(
    "f13_classify_query",
    "WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q FROM conversations) SELECT conv_id, turn, CASE WHEN " + _SCORE.format(k=_KEYWORDS) + " >= 2 THEN 'code' "
    "WHEN q <> '' AND len(regexp_split_to_array(q, '\\s+')) >= 3 AND 1.0 - length(regexp_replace(q, '[^\\p{L}\\p{N} ]', '', 'g')) / length(q) <= 0.04 THEN 'concept' ELSE 'identifier' END AS kind FROM t",
)
def f13(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.classify_query(F.col("text")).alias("kind"))


@query(
    "f14_preview",
    "WITH t AS (SELECT doc_id, string_split(lower(text), chr(10)) AS l, lower(text) AS low, ['the', 'ing', 'ion'] AS q FROM documents), c AS (SELECT *, list_transform(l, lambda x: len(list_filter(q, lambda y: contains(x, y)))) AS n FROM t) "
    "SELECT doc_id, CASE WHEN list_max(n) > 0 THEN list_position(n, list_max(n)) - 1 END AS line, array_to_string(list_filter(q, lambda y: contains(low, y)), ' ') AS matched FROM c",
)
def f14(spark, d):
    shown = table(spark, d, "documents").select("doc_id", tx.preview(F.col("text"), F.array(*map(F.lit, ["the", "ing", "ion"]))).alias("p"))
    return shown.select("doc_id", F.col("p.line").alias("line"), F.array_join("p.matched", " ").alias("matched"))


@query("f16_embedding_text", "SELECT p_partkey, p_name || chr(10) || p_type AS text FROM part")
def f16(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws("\n", "p_name", "p_type").alias("text"))


_MODULES = ["./a/b", "../x", "../../y/z", "plain/m", "a.b.c", "crate/q"]


@query("f19_relative_parts", f"SELECT p_partkey, CASE WHEN m LIKE './%' THEN 1 WHEN m LIKE '../%' THEN length(regexp_extract(m, '^((?:\\.\\./)+)', 1)) // 3 + 1 ELSE 0 END::INT AS dots, CASE WHEN m LIKE './%' THEN m[3:] ELSE regexp_replace(m, '^(?:\\.\\./)+', '') END AS rest, replace(CASE WHEN m LIKE 'crate/%' THEN 'src/' || m[7:] ELSE m END, '.', '/') AS slashed FROM (SELECT p_partkey, ([{', '.join(map(repr, _MODULES))}])[p_partkey % 6 + 1] AS m FROM part)")
def f19(spark, d):
    m = F.element_at(F.array(*map(F.lit, _MODULES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", p.relative_parts(F.col("m"))["dots"].alias("dots"), p.relative_parts(F.col("m"))["rest"].alias("rest"), p.dotted_to_path(p.substitute_prefix(F.col("m"), [("crate/", "src/")])).alias("slashed"))


@query("f20_path_parts", f"SELECT p_partkey, regexp_extract(f, '[^/]+?(\\.[^./]+)$', 1) AS suffix, regexp_replace(f, '/[^/]+$', '') AS parent, regexp_replace(regexp_extract(f, '([^/]*)$', 1), '(.)\\.[^./]+$', '\\1') AS stem, regexp_extract(f, '([^/]*)$', 1) AS slug FROM (SELECT p_partkey, ([{', '.join(map(repr, _PATHS))}])[p_partkey % {len(_PATHS)} + 1] AS f FROM part)")
def f20(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % len(_PATHS) + 1).cast("int")).alias("f"))
    return f.select("p_partkey", p.suffix(F.col("f")).alias("suffix"), p.parent(F.col("f")).alias("parent"), p.stem(F.col("f")).alias("stem"), p.slug(F.col("f")).alias("slug"))


@query(
    "f23_first_sentence",
    "WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+|\\n\\s*\\n', '\\1' || chr(1), 'g') AS x FROM documents), s AS (SELECT doc_id, regexp_replace(string_split(x, chr(1))[1], '^\\s+|\\s+$', '', 'g') AS c FROM t), "
    "u AS (SELECT doc_id, CASE WHEN length(c) > 200 THEN regexp_replace(c[1:200], '\\s+$', '') ELSE c END AS c FROM s) "
    "SELECT doc_id, CASE WHEN length(c) >= 15 AND NOT regexp_matches(lower(regexp_replace(c, '^[\\s/#*\\-!\"''`]+', '')), '^(" + "|".join(tx.REJECTED_PREFIXES) + ")') THEN c END AS sentence FROM u",
)
def f23(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"))


@query("f24_excluded_identifiers", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([lang], list_filter([source, 'a'], lambda x: x <> ''), ['src', 'mod' || doc_id]))), ',') AS names FROM documents")
def f24(spark, d):
    path = F.concat(F.lit("src/mod"), "doc_id", F.lit(".py"))
    scope = F.concat("source", F.lit("::a"))
    names = tx.excluded_identifiers(F.col("lang"), scope, path)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(names, lambda n: ~F.contains(n, F.lit("::"))), ",").alias("names"))


@query("f25_mentions_any", "SELECT doc_id, contains(lower(text), 'tion') OR contains(lower(text), 'zzz') AS hit FROM documents")
def f25(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.mentions_any(F.col("text"), F.array(F.lit("tion"), F.lit("zzz"))).alias("hit"))


@query("f26_simplex", "SELECT p_partkey, round(u, 9) AS a, round(v * (1 - u), 9) AS b, round((1 - u) * (1 - v), 9) AS c FROM (SELECT p_partkey, p_partkey % 11 / 10.0::DOUBLE AS u, p_partkey % 7 / 6.0::DOUBLE AS v FROM part)")
def f26(spark, d):
    from tessera.operators.evaluation import simplex

    uv = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 11 / F.lit(10.0)).alias("u"), (F.col("p_partkey") % 7 / F.lit(6.0)).alias("v"))
    return uv.select("p_partkey", *[F.round(c, 9).alias(n) for c, n in zip(simplex(F.col("u"), F.col("v")), "abc", strict=True)])


@query("f28_formatting", "SELECT o_orderkey, printf('%.1f %%', round(o_totalprice / 10000, 1)) AS pct, CASE WHEN n < 1000 THEN n::VARCHAR ELSE printf('%.1fk', n / 1000.0) END AS human FROM (SELECT *, o_orderkey * 100 + 7 AS n FROM orders)")
def f28(spark, d):
    o = table(spark, d, "orders").withColumn("n", F.col("o_orderkey") * 100 + 7)
    return o.select("o_orderkey", tx.percentage(F.col("o_totalprice") / 10000).alias("pct"), tx.human_count(F.col("n")).alias("human"))


@query("f29_json_struct", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f29(spark, d):
    decoded = F.from_json("props", "k long")
    again = F.from_json(F.to_json(decoded), "k long")
    return table(spark, d, "events").select("event_id", again["k"].alias("k"))


@query("f31_calver", "SELECT o_orderkey, list_transform(string_split(v, '.'), lambda x: x::INT) >= [2024, 6, 1] AS newer FROM (SELECT o_orderkey, (2020 + o_orderkey % 7) || '.' || (o_orderkey % 12 + 1) || '.' || (o_orderkey % 3) AS v FROM orders)")
def f31(spark, d):
    k = F.col("o_orderkey")
    ver = F.concat_ws(".", (2020 + k % 7).cast("string"), (k % 12 + 1).cast("string"), (k % 3).cast("string"))
    a = p.version_parts(ver)
    own = [2024, 6, 1]
    newer = F.when(a[0] != own[0], a[0] > own[0]).when(a[1] != own[1], a[1] > own[1]).otherwise(a[2] >= own[2])
    return table(spark, d, "orders").select("o_orderkey", newer.alias("newer"))


@query("f32_short_ref", "SELECT o_orderkey, regexp_replace(r, '^refs/(heads|tags|remotes)/', '') AS ref, regexp_full_match(r, '[0-9a-fA-F]{40}') AS sha FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'refs/heads/m' || o_orderkey WHEN 1 THEN 'refs/tags/v1' WHEN 2 THEN sha1(o_orderkey::VARCHAR) ELSE 'refs/remotes/origin/x' END AS r FROM orders)")
def f32(spark, d):
    k = F.col("o_orderkey")
    ref = F.when(k % 4 == 0, F.concat(F.lit("refs/heads/m"), k)).when(k % 4 == 1, "refs/tags/v1").when(k % 4 == 2, F.sha1(k.cast("string"))).otherwise("refs/remotes/origin/x")
    return table(spark, d, "orders").select("o_orderkey", p.short_ref(ref).alias("ref"), p.is_sha(ref).alias("sha"))


@query("f35_heading_label", "WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 1 THEN l[1] || ' …' ELSE l[1] END AS label FROM t WHERE len(l) > 0")
def f35(spark, d):
    docs = table(spark, d, "documents").filter(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) != "")
    return docs.select("doc_id", tx.heading_label(F.col("text")).alias("label"))


@query("f36_chunk_id", "SELECT doc_id, substr(sha256(source || ':' || md5(text) || ':' || lang || ':' || doc_id), 1, 16) AS id FROM documents")
def f36(spark, d):
    return table(spark, d, "documents").select("doc_id", p.chunk_id(F.col("source"), F.md5("text"), F.col("lang"), F.col("doc_id") + 1).alias("id"))


@query("f37_compose_scope", "SELECT doc_id, array_to_string(list_filter([source, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, 'f'], lambda x: x <> ''), '::') AS scope FROM documents")
def f37(spark, d):
    return table(spark, d, "documents").select("doc_id", p.compose_scope(F.array("source", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.lit("f"))).alias("scope"))


@query("p13_keywords", "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations), u AS (SELECT conv_id, turn, unnest(w) AS k, unnest(range(len(w))) AS i FROM w), f AS (SELECT conv_id, turn, k, min(i) AS i, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(i)) AS n FROM u GROUP BY 1, 2, 3) SELECT conv_id, turn, string_agg(k, ' ' ORDER BY i) AS k FROM f WHERE n <= 10 GROUP BY 1, 2")
def p13(spark, d):
    k = tx.clean_keywords(F.split("text", r"\s+"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(k, " ").alias("k")).filter("k <> ''")
