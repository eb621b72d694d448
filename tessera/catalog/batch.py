"""Queries of batch search, measurement and tuning: every fiftieth document's name is a query for its chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.fixture import store, versions
from tessera.catalog.functions import TOKENS
from tessera.catalog.registry import query
from tessera.functions import text as tx
from tessera.operators import evaluation as ev
from tessera.operators import store as st
from tessera.plans import batch

TARGET = {"file_path": "t_file", "name": "t_name"}

#: Latest snapshots, visible chunks, queries, and their candidates with all signals. No query has a vector, so the semantic weight goes to the others.
CANDIDATES = (
    "WITH latest AS (SELECT repo_id, max_by(snapshot_sha, indexed_at) AS snapshot_sha FROM indexed_snapshots GROUP BY 1), "
    "seen AS (SELECT DISTINCT c.id, fs.repo_id, c.file_path, c.kind, c.name FROM chunks c JOIN file_snapshots fs ON c.blob_sha = fs.blob_sha AND c.file_path = fs.file_path JOIN latest l ON l.repo_id = fs.repo_id AND l.snapshot_sha = fs.snapshot_sha), "
    "qs AS (SELECT doc_id AS query, name AS text, lang AS language, file_path AS t_file, name AS t_name FROM c1 WHERE snapshot_sha = 'head' AND doc_id % 50 = 0), "
    "qt AS (SELECT query, unnest(" + TOKENS.format(t="text") + ") AS term FROM qs), "
    "toks AS (SELECT id, list_concat(" + TOKENS.format(t="name") + ", " + TOKENS.format(t="content") + ") AS t FROM chunks), avgs AS (SELECT avg(len(t)) AS a FROM toks), "
    "hits AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), "
    "bm AS (SELECT query, id, round(sum(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * dl / a))), 9) AS lexical FROM hits JOIN qt USING (term), avgs GROUP BY 1, 2), "
    "lex AS (SELECT * FROM (SELECT bm.*, repo_id, row_number() OVER (PARTITION BY query ORDER BY lexical DESC, id, repo_id) AS n FROM bm JOIN seen USING (id)) WHERE n <= 50), "
    "tier AS (SELECT query, id, repo_id, CASE WHEN name = text THEN 1 WHEN lower(name) = lower(text) THEN 2 WHEN starts_with(lower(name), lower(text)) THEN 3 ELSE 4 END AS t FROM qs JOIN seen ON contains(lower(name), lower(text))), "
    "nam AS (SELECT query, id, repo_id FROM (SELECT *, min(t) OVER (PARTITION BY query) AS best FROM tier) WHERE t = best), "
    "keys AS (SELECT query, id, repo_id FROM lex UNION SELECT query, id, repo_id FROM nam), "
    "deg AS (SELECT target_id AS id, count(*) AS n FROM edges e JOIN latest l ON l.repo_id = e.repo_id AND l.snapshot_sha = e.snapshot_sha GROUP BY 1), "
    "cand AS (SELECT k.query, s.id, s.repo_id, s.file_path, s.name, qs.text, coalesce(lex.lexical, 0)::DOUBLE AS lexical, CASE WHEN lower(s.name) = lower(text) THEN 1.0 WHEN starts_with(lower(s.name), lower(text)) THEN 0.8 WHEN contains(lower(s.name), lower(text)) THEN 0.5 ELSE 0.0 END::DOUBLE AS name_score, "
    "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {b}" for k, b in tx.KIND_BOOST.items()) + " ELSE 1.0 END::DOUBLE AS kind_boost, "
    "CASE WHEN s.file_path LIKE 'vendor/%' THEN 0.3 WHEN s.file_path LIKE 'tests/%' THEN 0.5 WHEN s.file_path LIKE '%.md' THEN 0.8 WHEN s.file_path LIKE '%.toml' THEN 0.7 ELSE 1.0 END::DOUBLE AS file_penalty, "
    "CASE WHEN coalesce(deg.n, 0) <= 0 THEN 1.0 ELSE least(1 + log2(1 + deg.n) / 4, 3.0) END::DOUBLE AS importance "
    "FROM keys k JOIN seen s USING (id, repo_id) JOIN qs USING (query) LEFT JOIN lex ON lex.query = k.query AND lex.id = s.id AND lex.repo_id = s.repo_id LEFT JOIN deg ON deg.id = s.id), "
    "scaled AS (SELECT *, CASE WHEN max(lexical) OVER q = min(lexical) OVER q THEN 0 ELSE (lexical - min(lexical) OVER q) / (max(lexical) OVER q - min(lexical) OVER q) END AS sl, "
    "CASE WHEN max(name_score) OVER q = min(name_score) OVER q THEN 0 ELSE (name_score - min(name_score) OVER q) / (max(name_score) OVER q - min(name_score) OVER q) END AS sn FROM cand WINDOW q AS (PARTITION BY query))"
)
#: Weights of an identifier without a semantic signal: 0.05 goes to the other two in proportion.
_B, _G = "(0.2::DOUBLE + 0.05::DOUBLE * 0.2::DOUBLE / 0.95::DOUBLE)", "(0.75::DOUBLE + 0.05::DOUBLE * 0.75::DOUBLE / 0.95::DOUBLE)"
RANKED = CANDIDATES + f", ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id, repo_id) AS rank FROM (SELECT *, round(({_B} * sl + {_G} * sn) * kind_boost * file_penalty * importance, 9) AS score FROM scaled))"
OUTCOMES = RANKED + ", outcome AS (SELECT qs.query, qs.language, min(rank) FILTER (r.file_path = t_file AND r.name = t_name) AS rank FROM qs LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r USING (query) GROUP BY 1, 2)"


def queries(spark, d):
    head = versions(spark, d).filter("snapshot_sha = 'head' and doc_id % 50 = 0")
    return head.select(F.col("doc_id").alias("query"), F.col("name").alias("text"), F.col("lang").alias("language"), F.col("file_path").alias("t_file"), F.col("name").alias("t_name"))


@query("q22_candidates", CANDIDATES + " SELECT query, id, repo_id, round(lexical, 6) AS lexical, name_score, kind_boost, file_penalty, round(importance, 6) AS importance FROM cand", True)
def q22(spark, d):
    s = store(spark, d)
    return batch.candidates_many(s, st.latest_snapshots(s), queries(spark, d)).select("query", "id", "repo_id", F.round("lexical", 6).alias("lexical"), "name_score", "kind_boost", "file_penalty", F.round("importance", 6).alias("importance"))


@query("q1_search_many", RANKED + " SELECT query, id, repo_id, rank FROM ranked WHERE rank <= 10", True)
def q1_many(spark, d):
    s = store(spark, d)
    return batch.search_many(s, st.latest_snapshots(s), queries(spark, d), 10).select("query", "id", "repo_id", F.col("rank").cast("long").alias("rank"))


_METRICS = "count(*) AS n_queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 8) AS hit_at_1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 8) AS hit_at_10, round(avg(coalesce(1.0 / rank, 0)), 8) AS mrr, round(avg(coalesce(1.0 / log2(rank + 1), 0)), 8) AS ndcg_at_10"


@query("q14_measure_search", OUTCOMES + f" SELECT 'none' AS arm, CASE WHEN grouping(language) = 1 THEN '{ev.ALL}' ELSE language END AS language, {_METRICS} FROM outcome GROUP BY GROUPING SETS ((language), ())", True)
def q14(spark, d):
    s = store(spark, d)
    _, report = batch.measure(s, st.latest_snapshots(s), queries(spark, d).withColumn("arm", F.lit("none")), TARGET, levels=(("language",), ()), dimensions=("arm", "language"))
    return report.select("arm", "language", "n_queries", *[F.round(c, 8).alias(c) for c in ("hit_at_1", "hit_at_10", "mrr", "ndcg_at_10")])


@query("j15_target_ranks", OUTCOMES + " SELECT query, language, rank FROM outcome", True)
def j15(spark, d):
    """Queries whose target isn't found stay, with a null rank."""
    s, q = store(spark, d), queries(spark, d)
    return batch.outcomes(batch.search_many(s, st.latest_snapshots(s), q, 10), q, TARGET).select("query", "language", F.col("rank").cast("long").alias("rank"))


_TRIALS = [(0, 0.0, 0.0, 1.0), (1, 0.0, 0.3, 0.7), (2, 0.0, 0.7, 0.3), (3, 0.0, 1.0, 0.0)]
_TUNE = (
    CANDIDATES + ", grid(trial, alpha, beta, gamma) AS (VALUES " + ", ".join(f"({t}, {a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)" for t, a, b, g in _TRIALS) + "), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY trial, query ORDER BY score DESC, id, repo_id) AS rank FROM (SELECT scaled.*, trial, round((beta * sl + gamma * sn) * kind_boost * file_penalty * importance, 9) AS score FROM scaled, grid)), "
    "o AS (SELECT trial, qs.query, min(rank) FILTER (r.file_path = t_file AND r.name = t_name) AS rank FROM grid CROSS JOIN qs LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r USING (trial, query) GROUP BY 1, 2), "
    "t AS (SELECT trial, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM o GROUP BY 1)"
)


@query("q15_tune_weights", _TUNE + " SELECT 'identifier' AS query_kind, trial, n, round(mrr, 8) AS mrr, trial = (SELECT min_by(trial, (-mrr, trial)) FROM t) AS best FROM t", True)
def q15(spark, d):
    grid = spark.createDataFrame(_TRIALS, "trial int, alpha double, beta double, gamma double")
    s, q = store(spark, d), batch.with_leads(queries(spark, d))
    trials, best = batch.tune(batch.lead_candidates(s, st.latest_snapshots(s), q), q, TARGET, grid)
    return trials.join(best.select("query_kind", F.col("trial").alias("b")), "query_kind").select("query_kind", "trial", "n", F.round("mrr", 8).alias("mrr"), (F.col("trial") == F.col("b")).alias("best"))


_SETTINGS = [(5, 1.0), (5, 0.25), (20, 0.5), (20, 0.0)]
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"
_RERANK = (
    RANKED + ", grid(pool, blend) AS (VALUES " + ", ".join(f"({p}, {b}::DOUBLE)" for p, b in _SETTINGS) + "), "
    "judged AS (SELECT r.*, round(len(list_intersect(" + _WORDS.format("text") + ", " + _WORDS.format("r.name || chr(10) || c.content") + ")) / greatest(len(" + _WORDS.format("text") + "), 1), 9) AS reranker FROM ranked r JOIN chunks c ON c.id = r.id WHERE rank <= 20), "
    "p AS (SELECT judged.*, pool, blend, min(reranker) OVER w AS lo, max(reranker) OVER w AS hi FROM judged, grid WHERE rank <= pool WINDOW w AS (PARTITION BY pool, blend, query)), "
    "g AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY pool, blend, query ORDER BY blend * score + (1 - blend) * CASE WHEN hi = lo THEN 0.0 ELSE (reranker - lo) / (hi - lo) END DESC, id, repo_id) AS rank FROM p), "
    "o AS (SELECT pool, blend, qs.query, min(rank) FILTER (g.file_path = t_file AND g.name = t_name) AS rank FROM grid CROSS JOIN qs LEFT JOIN g USING (pool, blend, query) GROUP BY 1, 2, 3), "
    "t AS (SELECT pool, blend, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM o GROUP BY 1, 2)"
)


@query("q16_tune_reranker", _RERANK + " SELECT 'identifier' AS query_kind, pool, blend, n, round(mrr, 8) AS mrr FROM t WHERE mrr >= (SELECT max(mrr) FROM t) - 0.02 ORDER BY pool, mrr DESC, blend LIMIT 1", True)
def q16(spark, d):
    grid = spark.createDataFrame(_SETTINGS, "pool int, blend double")
    s, q = store(spark, d), batch.with_leads(queries(spark, d))
    _, chosen = batch.tune_reranker(s, batch.lead_candidates(s, st.latest_snapshots(s), q), q, TARGET, grid, tolerance=0.02)
    return chosen.select("query_kind", "pool", "blend", "n", F.round("mrr", 8).alias("mrr"))
