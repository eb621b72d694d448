"""Queries of retrieval and ranking, the flagship search among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.fixture import refs, store, table
from tessera.catalog.functions import TOKENS
from tessera.catalog.index import REFS, ROW, SEEN, TWO
from tessera.catalog.registry import query
from tessera.functions.text import tokenise_code
from tessera.operators import impacts, ranking, retrieval
from tessera.operators import store as st
from tessera.plans import search as hybrid
from tessera.session import scratch_path

#: BM25 over all chunks; {q} is a list of query terms.
BM25 = (
    "toks AS (SELECT id, list_concat(" + TOKENS.format(t="name") + ", " + TOKENS.format(t="content") + ") AS t FROM chunks), "
    "avgs AS (SELECT avg(len(t)) AS a FROM toks), hits AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN {q} GROUP BY 1, 2), "
    "bm AS (SELECT id, sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS lexical FROM hits, avgs GROUP BY 1)"
)


@query("f11_bm25", "WITH " + BM25.format(q="('the', 'tion', 'with')") + " SELECT id, round(lexical, 6) AS score FROM bm", True)
def f11(spark, d):
    postings, stats = retrieval.postings_for(store(spark, d))
    return retrieval.bm25(postings, stats, "the tion with").select("id", F.round("score", 6).alias("score"))


@query("f11_bm25_batch", "WITH " + BM25.format(q="(SELECT unnest(q) FROM qs)").replace("toks AS", "qs AS (SELECT item_id, " + TOKENS.format(t="text") + " AS q FROM benchmark), toks AS", 1).split(", bm AS")[0] + ", qt AS (SELECT item_id, unnest(q) AS term FROM qs), b AS (SELECT item_id AS query, id, sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s FROM hits JOIN qt USING (term), avgs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS rank FROM b) SELECT query, id, rank FROM r WHERE rank <= 5", True)
def f11_many(spark, d):
    postings, stats = retrieval.postings_for(store(spark, d))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    scored = retrieval.bm25(postings, stats, asked).withColumn("score", F.round("score", 9))
    return retrieval.per_query_top(scored, 5, ["query"]).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("q12_match_fulltext", "WITH " + BM25.format(q="('the', 'tion')") + f" SELECT c.id, fs.repo_id, round(bm.lexical, 6) AS lexical FROM {SEEN} JOIN bm ON bm.id = c.id WHERE {REFS} ORDER BY round(bm.lexical, 9) DESC, c.id, fs.repo_id LIMIT 20", True)
def q12_fulltext(spark, d):
    return retrieval.lexical(store(spark, d), refs(spark, *TWO), "the tion", 20).select("id", "repo_id", F.round("lexical", 6).alias("lexical"))


_VECS = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (0, 1, 2))"


def _vectors(spark, d):
    return [list(r.embedding) for r in table(spark, d, "embeddings").filter("vec_id < 3").orderBy("vec_id").collect()]  # a request's three vectors


@query("j4_similar", f"SELECT c.id, fs.repo_id, round(max(list_cosine_similarity(c.embedding::FLOAT[]::DOUBLE[], q.e)), 6) AS semantic FROM {SEEN}, {_VECS} q WHERE c.has_embedding GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20", True)
def j4(spark, d):
    s = store(spark, d)
    near = retrieval.semantic(s, s.file_snapshots, _vectors(spark, d), 20)
    return near.select("id", "repo_id", F.round("semantic", 6).alias("semantic"))


@query("a3_group_max", "SELECT label, max(round(list_cosine_similarity(a.embedding::DOUBLE[], q.e), 6)) AS best FROM embeddings a, " + _VECS + " q GROUP BY ALL")
def a3(spark, d):
    from tessera.functions.vectors import best_cosine

    e = table(spark, d, "embeddings").withColumn("s", F.round(best_cosine(F.col("embedding"), _vectors(spark, d)), 6))
    return e.groupBy("label").agg(F.max("s").alias("best"))


@query("p7_name_tiers", "SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 1 WHEN p_name ILIKE 'small ring' THEN 2 WHEN p_name ILIKE 'small ring%' THEN 3 ELSE 4 END AS match_tier FROM part WHERE p_name ILIKE '%small ring%'")
def p7(spark, d):
    return retrieval.name_tiers(table(spark, d, "part"), "small ring", "p_name").select("p_partkey", "match_tier")


@query("p6_wildcards", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%r_ng%'")
def p6(spark, d):
    return retrieval.name_tiers(table(spark, d, "part"), "r_ng", "p_name").select("p_partkey", "p_name")


@query("w5_best_tier", f"WITH r AS (SELECT DISTINCT c.id, fs.repo_id, CASE WHEN c.name = 'On' THEN 1 WHEN c.name ILIKE 'On' THEN 2 WHEN c.name ILIKE 'On%' THEN 3 ELSE 4 END AS t FROM {SEEN} WHERE c.name ILIKE '%On%') SELECT id, repo_id, count(*) AS n FROM r WHERE t = (SELECT min(t) FROM r) GROUP BY 1, 2", True)
def w5(spark, d):
    s = store(spark, d)
    return retrieval.match_by_name(s, s.file_snapshots, "On").groupBy("id", "repo_id").agg(F.count("*").alias("n"))


@query("j5_merge_channels", "SELECT coalesce(a.k, b.k) AS id, coalesce(a.x, 0)::DOUBLE AS lexical, coalesce(b.y, 0)::DOUBLE AS semantic FROM (SELECT o_custkey AS k, max(o_totalprice) AS x FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS y FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k")
def j5(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("lexical"))
    b = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("semantic"))
    return ranking.merge_channels((a, "lexical"), (b, "semantic"), keys=("id",))


_EDGE = "(SELECT l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_linenumber = 1)"


@query(
    "f6_proximity",
    f"WITH ch AS (SELECT p_partkey FROM part WHERE p_partkey % 50 = 0), e AS {_EDGE}, near AS (SELECT DISTINCT s FROM e WHERE t IN (SELECT p_partkey FROM ch)) "
    "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 1.5 WHEN o_orderkey IN (SELECT s FROM near) THEN 1.2 WHEN o_orderkey % 10 = 7 THEN 1.1 ELSE 1.0 END::DOUBLE AS proximity FROM orders",
)
def f6(spark, d):
    """Orders as candidates, line items as edges to parts; some parts' files, some orders' files and one directory are changed."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("c"), "o_orderkey")).otherwise(F.concat(F.lit("d"), F.col("o_orderkey") % 10, F.lit("/f"), "o_orderkey")).alias("file_path"), "o_orderkey")
    edges = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("o"), "l_orderkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"))
    paths = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("parts"), "p_partkey").alias("file_path"))
    changed = table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("parts"), "p_partkey").alias("file_path"))
    changed = changed.unionByName(o.filter("o_orderkey % 97 = 0").select("file_path")).unionByName(spark.createDataFrame([("d7/other",)], "file_path string"))
    return ranking.proximity(o, edges, paths, changed).select("o_orderkey", "proximity")


_FUSE = "WITH c AS (SELECT p_partkey AS id, p_size::DOUBLE AS semantic, p_retailprice AS lexical, CASE WHEN p_name LIKE '%ring%' THEN 0.5 ELSE 0.0 END::DOUBLE AS name_score FROM part), m AS (SELECT min(semantic) s0, max(semantic) s1, min(lexical) l0, max(lexical) l1, min(name_score) n0, max(name_score) n1 FROM c), f AS (SELECT id, 0.5 * CASE WHEN s1 = s0 THEN 0 ELSE (semantic - s0) / (s1 - s0) END + 0.4 * CASE WHEN l1 = l0 THEN 0 ELSE (lexical - l0) / (l1 - l0) END + 0.1 * CASE WHEN n1 = n0 THEN 0 ELSE (name_score - n0) / (n1 - n0) END AS score FROM c, m)"


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("semantic"), F.col("p_retailprice").alias("lexical"), F.when(F.col("p_name").contains("ring"), 0.5).otherwise(0.0).alias("name_score"))


@query("f8_fusion", _FUSE + " SELECT id, round(score, 8) AS score FROM f")
def f8(spark, d):
    return ranking.fuse(_parts(spark, d), ranking.weights_for("concept", True)).select("id", F.round("score", 8).alias("score"))


@query("t3_fused_top", _FUSE + " SELECT id, round(score, 8) AS score FROM f ORDER BY round(score, 10) DESC, id LIMIT 10")
def t3(spark, d):
    fused = ranking.fuse(_parts(spark, d), ranking.weights_for("concept", True)).withColumn("score", F.round("score", 10))
    return ranking.top(fused, 10).select("id", F.round("score", 8).alias("score"))


@query("w4_min_max", "SELECT o_orderkey, o_orderpriority, round(CASE WHEN max(o_totalprice) OVER w = min(o_totalprice) OVER w THEN 0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 8) AS scaled FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def w4(spark, d):
    o = table(spark, d, "orders")
    return ranking.scaled(o, ["o_totalprice"], ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", F.round("scaled_o_totalprice", 8).alias("scaled"))


_W = "(VALUES ('concept', false, 0.0, 0.8, 0.2), ('concept', true, 0.5, 0.4, 0.1), ('identifier', false, 0.0, 0.210526, 0.789474), ('identifier', true, 0.05, 0.2, 0.75), ('code', false, 0.0, 0.315789, 0.684211), ('code', true, 0.05, 0.3, 0.65)) w(kind, has, alpha, beta, gamma)"


@query("f9_weights", f"SELECT p_partkey, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, gamma::DOUBLE AS gamma FROM part JOIN {_W} ON kind = ['concept', 'identifier', 'code'][p_size % 3 + 1] AND has = (p_partkey % 2 = 0)")
def f9(spark, d):
    """Parts as requests of a class, half of them without a semantic signal."""
    kind = F.element_at(F.array(F.lit("concept"), F.lit("identifier"), F.lit("code")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", *[F.round(w, 6).alias(n) for n, w in zip(("alpha", "beta", "gamma"), ranking.weight_columns(kind, F.col("p_partkey") % 2 == 0), strict=True)])


@query("f15_blend", _FUSE + ", r AS (SELECT f.id, score, p_retailprice AS second FROM f JOIN part ON p_partkey = f.id), x AS (SELECT min(second) a, max(second) b FROM r) SELECT id, round(0.25 * score + 0.75 * (second - a) / (b - a), 8) AS blended FROM r, x")
def f15(spark, d):
    fused = ranking.fuse(_parts(spark, d), ranking.weights_for("concept", True))
    return ranking.blend(fused.withColumn("second", F.col("lexical")), "second", 0.25).select("id", F.round("blended", 8).alias("blended"))


def _search(spark, d, text="the tion with", **more):
    s = store(spark, d)
    latest = st.latest_snapshots(s)
    return hybrid.search(s, latest, text, _vectors(spark, d), k=10, **more)


_SEARCH_SQL = (
    "WITH latest AS (SELECT repo_id, max_by(snapshot_sha, indexed_at) AS snapshot_sha FROM indexed_snapshots GROUP BY 1), seen AS (SELECT c.*, fs.repo_id FROM chunks c JOIN file_snapshots fs ON c.blob_sha = fs.blob_sha AND c.file_path = fs.file_path JOIN latest l ON l.repo_id = fs.repo_id AND l.snapshot_sha = fs.snapshot_sha), "
    + BM25.format(q="('the', 'tion', 'with')")
    + ", lex AS (SELECT s.id, s.repo_id, bm.lexical FROM seen s JOIN bm ON bm.id = s.id ORDER BY bm.lexical DESC, s.id, s.repo_id LIMIT 50), "
    f"sem0 AS (SELECT s.id, s.repo_id, s.kind, max(list_cosine_similarity(s.embedding::FLOAT[]::DOUBLE[], q.e)) AS semantic FROM seen s, {_VECS} q WHERE s.has_embedding GROUP BY ALL ORDER BY 4 DESC, 1, 2 LIMIT 100), sem AS (SELECT id, repo_id, semantic FROM sem0 WHERE kind NOT IN ('import', 'doc_section') ORDER BY semantic DESC, id, repo_id LIMIT 50), "
    "nam AS (SELECT id, repo_id FROM (SELECT id, repo_id, 4 AS t FROM seen WHERE name ILIKE '%the tion with%')), keys AS (SELECT id, repo_id FROM lex UNION SELECT id, repo_id FROM sem UNION SELECT id, repo_id FROM nam), "
    "deg AS (SELECT target_id AS id, count(*) AS n FROM edges e JOIN latest l ON l.repo_id = e.repo_id AND l.snapshot_sha = e.snapshot_sha GROUP BY 1), "
    "cand AS (SELECT s.id, s.repo_id, s.kind, s.file_path, coalesce(lex.lexical, 0) AS lexical, coalesce(sem.semantic, 0) AS semantic, CASE WHEN lower(s.name) = 'the tion with' THEN 1.0 WHEN len(list_filter(['the', 'tion', 'with'], lambda t: NOT contains(lower(s.name), t))) = 0 THEN 0.4 ELSE 0 END AS name_score, coalesce(deg.n, 0) AS degree "
    "FROM keys JOIN seen s USING (id, repo_id) LEFT JOIN lex USING (id, repo_id) LEFT JOIN sem USING (id, repo_id) LEFT JOIN deg USING (id)), "
    "m AS (SELECT min(semantic) s0, max(semantic) s1, min(lexical) l0, max(lexical) l1, min(name_score) n0, max(name_score) n1 FROM cand), "
    "fused AS (SELECT id, repo_id, (0.5 * CASE WHEN s1 = s0 THEN 0 ELSE (semantic - s0) / (s1 - s0) END + 0.4 * CASE WHEN l1 = l0 THEN 0 ELSE (lexical - l0) / (l1 - l0) END + 0.1 * CASE WHEN n1 = n0 THEN 0 ELSE (name_score - n0) / (n1 - n0) END) "
    "* CASE kind WHEN 'class' THEN 1.5 WHEN 'function' THEN 1.3 WHEN 'method' THEN 1.3 WHEN 'doc_section' THEN 0.8 WHEN 'test_function' THEN 0.7 WHEN 'config_key' THEN 0.6 WHEN 'comment' THEN 0.5 WHEN 'raw_chunk' THEN 0.5 WHEN 'migration' THEN 0.4 WHEN 'import' THEN 0.3 ELSE 1.0 END "
    "* CASE WHEN file_path LIKE 'vendor/%' THEN 0.3 WHEN file_path LIKE 'tests/%' THEN 0.5 WHEN file_path LIKE '%.md' THEN 0.8 WHEN file_path LIKE '%.toml' THEN 0.7 ELSE 1.0 END * CASE WHEN degree <= 0 THEN 1.0 ELSE least(1 + log2(1 + degree) / 4, 3.0) END AS score FROM cand, m) "
    "SELECT id, repo_id, round(score, 6) AS score FROM fused ORDER BY round(score, 9) DESC, id, repo_id LIMIT 10"
)

_PREVIEW = (
    ", best AS (SELECT id, repo_id, score FROM fused ORDER BY round(score, 9) DESC, id, repo_id LIMIT 10), "
    "shown AS (SELECT best.id, best.repo_id, file_path, kind, name, round(score, 6) AS score, lower(content) AS low, ['the', 'tion', 'with'] AS q, list_transform(string_split(lower(content), chr(10)), lambda x: len(list_filter(['the', 'tion', 'with'], lambda y: contains(x, y)))) AS n FROM best JOIN chunks USING (id)) "
    "SELECT id, repo_id, file_path, kind, name, 'concept' AS query_kind, CASE WHEN list_max(n) > 0 THEN list_position(n, list_max(n)) - 1 END::INT AS preview_line, array_to_string(list_filter(q, lambda y: contains(low, y)), ' ') AS matched_terms, score FROM shown"
)


@query("q1_search", _SEARCH_SQL, True)
def q1(spark, d):
    return _search(spark, d).select("id", "repo_id", F.round("score", 6).alias("score"))


@query("q1_search_preview", _SEARCH_SQL.split(" SELECT id, repo_id, round(score, 6)")[0] + _PREVIEW, True)
def q1_preview(spark, d):
    return _search(spark, d).select("id", "repo_id", "file_path", "kind", "name", "query_kind", "preview_line", F.array_join("matched_terms", " ").alias("matched_terms"), F.round("score", 6).alias("score"))


_TERMS = "['class', 'of', 'the', 'ring']"
_RERANKED_SQL = (
    "WITH seen AS (SELECT DISTINCT c.id, fs.repo_id, c.kind, c.file_path, c.name, c.content FROM chunks c JOIN file_snapshots fs ON c.blob_sha = fs.blob_sha AND c.file_path = fs.file_path JOIN indexed_snapshots i ON i.repo_id = fs.repo_id AND i.snapshot_sha = fs.snapshot_sha), "
    + BM25.format(q="('class', 'of', 'the', 'ring')")
    + ", lex AS (SELECT s.id, s.repo_id, bm.lexical FROM seen s JOIN bm USING (id) ORDER BY bm.lexical DESC, s.id, s.repo_id LIMIT 50), "
    "nam0 AS (SELECT id, repo_id, CASE WHEN name = 'class of the ring' THEN 1 WHEN name ILIKE 'class of the ring' THEN 2 WHEN name ILIKE 'class of the ring%' THEN 3 ELSE 4 END AS t FROM seen WHERE name ILIKE '%class of the ring%'), "
    "keys AS (SELECT id, repo_id FROM lex UNION SELECT id, repo_id FROM nam0 WHERE t = (SELECT min(t) FROM nam0)), "
    "deg AS (SELECT target_id AS id, count(*) AS n FROM edges JOIN indexed_snapshots i USING (repo_id, snapshot_sha) GROUP BY 1), "
    "cand AS (SELECT s.*, coalesce(lex.lexical, 0) AS lexical, CASE WHEN lower(s.name) = 'class of the ring' THEN 1.0 WHEN starts_with(lower(s.name), 'class of the ring') THEN 0.8 WHEN contains(lower(s.name), 'class of the ring') THEN 0.5 "
    f"WHEN len(list_filter({_TERMS}, lambda t: NOT contains(lower(s.name), t))) = 0 THEN 0.4 ELSE 0 END AS name_score, coalesce(deg.n, 0) AS degree FROM keys JOIN seen s USING (id, repo_id) LEFT JOIN lex USING (id, repo_id) LEFT JOIN deg USING (id)), "
    "m AS (SELECT min(lexical) l0, max(lexical) l1, min(name_score) n0, max(name_score) n1 FROM cand), "
    "fused AS (SELECT cand.*, (0.8 * CASE WHEN l1 = l0 THEN 0 ELSE (lexical - l0) / (l1 - l0) END + 0.2 * CASE WHEN n1 = n0 THEN 0 ELSE (name_score - n0) / (n1 - n0) END) "
    + _SEARCH_SQL[_SEARCH_SQL.index("* CASE kind") : _SEARCH_SQL.index(" AS score FROM cand")]
    + " AS score FROM cand, m), "
    "pool AS (SELECT *, len(list_distinct(list_filter(regexp_split_to_array(lower(name || chr(10) || content), '\\s+'), "
    f"lambda x: list_contains({_TERMS}, x)))) / 4.0::DOUBLE AS second FROM (SELECT * FROM fused ORDER BY score DESC, id, repo_id LIMIT 20)), "
    "e AS (SELECT min(second) AS a, max(second) AS b FROM pool) "
    "SELECT id, repo_id, round(0.25 * score + 0.75 * CASE WHEN a = b THEN 0 ELSE (second - a) / (b - a) END, 6) AS blended FROM pool, e ORDER BY 0.25 * score + 0.75 * CASE WHEN a = b THEN 0 ELSE (second - a) / (b - a) END DESC, id LIMIT 10"
)


@query("q2_search_all_reranked", _RERANKED_SQL, True)
def q2(spark, d):
    s = store(spark, d)
    found = hybrid.search(s, s.indexed_snapshots, "class of the ring", k=10, scorer=hybrid.overlap_scorer)
    return found.select("id", "repo_id", F.round("blended", 6).alias("blended"))


@query("q5_find_refs", f"WITH r AS (SELECT {ROW}, CASE WHEN c.name = 'The' THEN 1 ELSE 2 END AS t FROM {SEEN} WHERE {REFS} AND c.name ILIKE '%The%'), ids AS (SELECT DISTINCT id FROM r WHERE t = 1) SELECT e.source_id, e.target_id, e.kind, e.repo_id FROM edges e WHERE ((e.repo_id = 0 AND e.snapshot_sha = 'head') OR (e.repo_id = 1 AND e.snapshot_sha = 'base')) AND e.target_id IN (SELECT id FROM ids)", True)
def q5(spark, d):
    s, r = store(spark, d), refs(spark, *TWO)
    named = st.at_snapshots(s, r).filter(F.col("name") == "The").select("id")
    return st.inbound_refs(s, r, named).select("source_id", "target_id", "kind", "repo_id")


@query("q5_find_refs_everywhere", f"WITH r AS (SELECT DISTINCT c.id FROM {SEEN} JOIN indexed_snapshots i ON i.repo_id = fs.repo_id AND i.snapshot_sha = fs.snapshot_sha WHERE c.name ILIKE 'The%' OR c.name ILIKE 'Er%') SELECT e.source_id, e.target_id, e.kind, e.repo_id FROM edges e JOIN indexed_snapshots i ON i.repo_id = e.repo_id AND i.snapshot_sha = e.snapshot_sha WHERE e.target_id IN (SELECT id FROM r)", True)
def q5_everywhere(spark, d):
    """References to all symbols of two prefixes, at every indexed snapshot."""
    s = store(spark, d)
    named = st.at_snapshots(s, s.indexed_snapshots, once=True).filter(F.col("name").ilike("The%") | F.col("name").ilike("Er%")).select("id")
    return st.inbound_refs(s, s.indexed_snapshots, named).select("source_id", "target_id", "kind", "repo_id")


@query("f18_lexical_query", "SELECT p_partkey, trim(p_name || ' ' || p_brand) AS q FROM part")
def f18(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("q"))


@query("k17_fts_build", "WITH toks AS (SELECT id, list_concat(" + TOKENS.format(t="name") + ", " + TOKENS.format(t="content") + ") AS t FROM chunks) SELECT term, count(DISTINCT id) AS df, count(*)::BIGINT AS occurrences FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY 1", True)
def k17(spark, d):
    postings, _ = retrieval.build_postings(store(spark, d).chunks)
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


_FREQUENT = ["the", "of", "licensed", "tion", "absent"]
_TOP = "WITH docs AS (SELECT doc_id, " + TOKENS.format(t="text") + " AS t FROM documents), a AS (SELECT avg(len(t)) AS a FROM docs), h AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs), b AS (SELECT doc_id, sum(2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / a))) AS s FROM h, a WHERE term IN ('" + "', '".join(_FREQUENT) + "') GROUP BY 1) SELECT doc_id::VARCHAR AS id, round(s, 6) AS score FROM b ORDER BY round(s, 9) DESC, id LIMIT 10"


@query("f11_best_by_blocks", _TOP)
def f11_blocks(spark, d):
    """The ten best documents for frequent words, from the blocks of postings that can hold one of them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), tokenise_code(F.col("text")).alias("content_tokens"), F.lit("").alias("name_tokens"))
    root = scratch_path(spark, "blocks")
    retrieval.write_postings(docs, root)
    impacts.write_blocks(*retrieval.written_postings(spark, root), f"{root}/blocks")
    found, _ = impacts.best(impacts.read_blocks(spark, f"{root}/blocks"), _FREQUENT, 10)
    return found.select("id", F.round("score", 6).alias("score"))


@query("flagship", "WITH docs AS (SELECT doc_id, " + TOKENS.format(t="text") + " AS t FROM documents), a AS (SELECT avg(len(t)) AS a FROM docs), h AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs), b AS (SELECT doc_id, sum(2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / a))) AS s FROM h, a WHERE term IN ('licensed', 'under', 'version') GROUP BY 1) SELECT doc_id, round(s, 6) AS score FROM b ORDER BY round(s, 9) DESC, doc_id LIMIT 10")
def flagship(spark, d):
    """The ten documents that match a question best: tokens, postings and BM25 end to end."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), tokenise_code(F.col("text")).alias("content_tokens"), F.lit("").alias("name_tokens"))
    path = scratch_path(spark, "tokens")  # read twice, by the postings and by their statistics
    docs.write.parquet(path)
    postings, stats = retrieval.build_postings(spark.read.schema(docs.schema).parquet(path))
    best = retrieval.bm25(postings, stats, "licensed under version").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(10)
    return best.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
