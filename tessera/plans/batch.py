"""Many queries at once: candidates of every query with their signals, ranked hits, measurement, and the tuning of weights and of a second scorer.

A batch of queries is a DataFrame (query, text) with more columns as each plan states. The query is
a partition key throughout, so a batch is one plan however many queries it has. Queries of equal
texts and vectors are searched, scored and ranked once, under the one that leads them
(``with_leads``); ``of_all`` gives what was found to each of them. Scores are rounded to nine digits
before they rank, so that the order of summation can't decide ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import evaluation as ev
from tessera.operators import ranking, retrieval
from tessera.operators.store import Store, at_snapshots, inbound_degree
from tessera.plans.search import LEXICAL_POOL, NOT_SEMANTIC, SEMANTIC_POOL
from tessera.session import written

#: Vectors of queries that every task holds as one matrix; larger batches are searched in so many parts.
MATRIX = 1 << 14
#: Queries and rows that are multiplied at once.
TILE = 1024
#: Names are indexed by their runs of so many characters.
GRAM = 3
ROW = ["query", "id", "repo_id"]


def with_leads(queries: DataFrame) -> DataFrame:
    """``queries`` with ``lead``, the smallest query of the same text (and vectors); written."""
    same = [c for c in ("text", "vectors") if c in queries.columns]
    leads = queries.groupBy(*[F.col(c).alias(f"__{c}") for c in same]).agg(F.min("query").alias("lead"))
    equal = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    return written(queries.join(leads, equal).select(*queries.columns, "lead"), "batch-queries")


def of_all(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``rows`` of leading queries as rows of every query that they lead."""
    return rows.withColumnRenamed("query", "lead").join(queries.select("query", "lead"), "lead").select(*rows.columns)


def lexical_many(store: Store, refs: DataFrame, queries: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """(query, id, repo_id, lexical): every query's ``k`` best by BM25 among the chunks visible at ``refs``.

    Queries of the same terms are scored once. A posting is the score of its term; only several terms are summed by chunk.
    """
    postings, stats = retrieval.postings_for(store)
    terms = F.array_sort(F.array_distinct(F.filter(F.split(tx.tokenise_code(F.col("text")), " "), lambda t: t != "")))
    asked = written(queries.select("query", "text", F.array_join(terms, " ").alias("terms")).filter("terms <> ''"), "batch-terms")
    sets = written(asked.groupBy("terms").agg(F.min("text").alias("text")), "batch-sets")  # a few rows, which Spark then sees
    single = ~F.contains("terms", F.lit(" "))
    one = postings.join(sets.filter(single).select("terms", F.col("terms").alias("term")), "term").crossJoin(F.broadcast(stats))  # stats is one row
    several = retrieval.bm25(postings, stats, sets.filter(~single).select(F.col("terms").alias("query"), "text"))
    scored = one.select("terms", "id", retrieval.impact().alias("score")).unionByName(several.withColumnRenamed("query", "terms")).withColumn("lexical", F.round("score", 9))
    seen = (at_snapshots(store, refs, once=True) if seen is None else seen).select("id", "repo_id")
    w = Window.partitionBy("terms").orderBy(F.desc("lexical"), "id", "repo_id")
    best = scored.join(seen, "id").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k)
    return best.join(asked.select("query", "terms"), "terms").select(*ROW, "lexical")


def _grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters; a shorter text is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.char_length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(F.char_length(text) < GRAM, F.array(text)).otherwise(F.array_distinct(runs))


def name_grams(names: DataFrame) -> DataFrame:
    """(gram, name) of distinct ``names``: the index that substrings are looked up in, with the runs of one and two characters and the empty one that short requests need."""
    low = F.lower("name")
    short = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n))))
    return names.select("name", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[short(n) for n in range(1, GRAM)], _grams(low)))).alias("gram"))


def named_many(store: Store, refs: DataFrame, queries: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(query, id, repo_id) of all chunks of the best tier that occurs at all for the query, as ``match_by_name`` has it.

    Names that equal the text are an equi-join. The other queries go by the rarest gram of their
    longest stretch without a wildcard: it is joined with the names' grams, and only names that hold
    it are compared with the text. A text without such a stretch means every name.
    """
    seen = (at_snapshots(store, refs, once=True) if seen is None else seen).select("id", "repo_id", "name").filter(F.col("name").isNotNull())
    names = written(seen.select("name").distinct(), "names")
    asked = queries.select("query", F.coalesce("text", F.lit("")).alias("text"))
    equal = asked.join(names, F.col("text") == F.col("name")).select("query", "name", F.lit(1).alias("tier"))
    stretches = F.split(F.lower("text"), "[%_]")
    longest = F.get(F.transform(F.array_sort(F.transform(stretches, lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x")))), lambda y: y["x"]), F.lit(0))
    open_ = asked.join(equal.select("query").distinct(), "query", "left_anti").withColumn("part", longest).select("query", "text", F.explode(_grams(F.col("part"))).alias("gram"))
    index = name_grams(names)
    sizes = index.join(open_.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = open_.join(sizes, "gram", "left").groupBy("query", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))  # a gram that no name has finds none
    pairs = index.join(written(rarest.filter("g.n > 0").select("query", "text", F.col("g.gram").alias("gram")), "grams"), "gram").select("query", "text", "name")
    wild, low, sought = F.rlike("text", F.lit("[%_]")), F.lower("name"), F.lower("text")
    like = lambda pattern, plain: F.when(wild, F.expr(f"name ILIKE {pattern} ESCAPE '\x01'")).otherwise(plain)
    within = like("concat('%', text, '%')", F.contains(low, sought))
    tier = F.when(like("text", low == sought), 2).when(like("concat(text, '%')", F.startswith(low, sought)), 3).otherwise(4)
    tiers = written(equal.unionByName(pairs.filter(within).select("query", "name", tier.alias("tier"))), "name-tiers")
    best = tiers.groupBy("query").agg(F.min("tier").alias("tier"))
    return tiers.join(best, ["query", "tier"]).select("query", "name").join(seen, "name").select(*ROW)


class Best:
    """The ``k`` best rows of each of some queries among those that came so far; of equal scores the one that came first stays."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full((queries, 1), -np.inf)
        self.query, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` of the queries (down) with ``rows`` (across); -inf and NaN never count."""
        q, r = np.nonzero(scores > self.least)
        if not len(q):
            return
        query, row, score = (np.concatenate(x) for x in ((self.query, q), (self.row, rows[r]), (self.score, scores[q, r])))
        order = np.lexsort((row, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
        order, place = order[place < self.k], place[place < self.k]
        self.query, self.row, self.score = query[order], row[order], score[order]
        full = place == self.k - 1
        self.least[self.query[full], 0] = self.score[full]


def _nearest(asked: list[tuple], query_type: str, k: int):
    """A pass over rows (id, repo_id, kind, v) in order of id and repo_id that gives each query's ``k`` best."""
    names = list(dict.fromkeys(q for q, _ in asked))
    number = {q: i for i, q in enumerate(names)}
    asked = sorted(asked, key=lambda a: number[a[0]])
    matrix = np.array([v for _, v in asked], np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    begins = np.searchsorted([number[q] for q, _ in asked], np.arange(len(names) + 1))  # of every query its first vector

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, seen = [Best(min(TILE, len(names) - q), k) for q in range(0, len(names), TILE)], None, 0
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, np.nan)
            for at in range(0, len(x), TILE):
                rows = np.arange(seen + at, seen + min(at + TILE, len(x)))
                for n, some in enumerate(best):
                    cuts = begins[n * TILE : n * TILE + TILE + 1]
                    cosine = matrix[cuts[0] : cuts[-1]] @ x[at : at + TILE].T
                    if len(cosine) > len(cuts) - 1:  # queries of several vectors
                        cosine = np.maximum.reduceat(cosine, cuts[:-1] - cuts[0], axis=0)
                    some.add(cosine.round(9), rows)
            fresh = batch.select(["id", "repo_id", "kind"])
            table = pa.Table.from_batches([fresh]).add_column(0, "row", pa.array(np.arange(seen, seen + len(x))))
            held = table if held is None else pa.concat_tables([held, table])
            seen += len(x)
            kept = np.unique(np.concatenate([b.row for b in best]))  # only rows that still count are held
            held = held.take(pa.array(np.searchsorted(held.column("row").to_numpy(), kept))).combine_chunks()
        if held is None:
            return
        for n, some in enumerate(best):
            part = held.take(pa.array(np.searchsorted(held.column("row").to_numpy(), some.row)))
            mine = pa.array([names[n * TILE + q] for q in some.query.tolist()])
            yield from pa.table([mine, *[part.column(c) for c in ("id", "repo_id", "kind")], pa.array(some.score)], names=["query", "id", "repo_id", "kind", "semantic"]).to_batches(max_chunksize=1 << 16)

    return near


def semantic_many(store: Store, refs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, repo_id, kind, semantic): every query's ``k`` best by the largest cosine to any of its ``vectors`` (array of vectors).

    A batch's vectors are one matrix, in parts of about ``MATRIX`` vectors by a hash of the query.
    A task meets them with its rows in tiles and keeps ``k`` rows a query over all of its rows.
    """
    query_type = queries.schema["query"].dataType.simpleString()
    seen = at_snapshots(store, refs, once=True).filter(F.col("embedding").isNotNull()).select("id", "repo_id", "kind", F.col("embedding").cast("array<double>").alias("v"))
    schema = f"query {query_type}, id string, repo_id int, kind string, semantic double"
    given = queries.filter(F.size(F.coalesce("vectors", F.array())) > 0).select("query", "vectors")
    parts = -(-(given.agg(F.sum(F.size("vectors"))).first()[0] or 0) // MATRIX)
    rows, out = seen.sortWithinPartitions("id", "repo_id"), []
    for i in range(parts):
        some = given.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == i).collect()  # a part of a request
        asked = [(r["query"], v) for r in some for v in r.vectors]
        if asked:
            near = rows.mapInArrow(_nearest(asked, query_type, k), schema)
            out.append(near if parts == 1 else written(near, "nearest"))
    if not out:
        return seen.select(F.lit(None).cast(query_type).alias("query"), "id", "repo_id", "kind", F.lit(0.0).alias("semantic")).limit(0)
    kept = out[0]
    for more in out[1:]:
        kept = kept.unionByName(more)
    w = Window.partitionBy("query").orderBy(F.desc("semantic"), "id", "repo_id")
    return kept.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def candidates_many(store: Store, refs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row per query and candidate: query, text, id, repo_id, file_path, kind, name, and the signals that fusion takes.

    The channels and their pools are those of ``search``; ``queries`` may have ``vectors``.
    """
    queries = with_leads(queries)
    return of_all(lead_candidates(store, refs, queries, k), queries)


def lead_candidates(store: Store, refs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``candidates_many`` of the leading ones of ``queries``, which have ``lead``. The result is written, so tuning under many settings reads it and runs no channel again."""
    queries = queries.filter(F.col("query") == F.col("lead"))
    seen = retrieval.visible(store, refs)
    channels = [(lexical_many(store, refs, queries, LEXICAL_POOL * k, seen), "lexical")]
    if "vectors" in queries.columns:
        near = semantic_many(store, refs, queries, SEMANTIC_POOL * k).filter(~F.col("kind").isin(*NOT_SEMANTIC))
        w = Window.partitionBy("query").orderBy(F.desc("semantic"), "id", "repo_id")
        channels.append((near.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= LEXICAL_POOL * k).select(*ROW, "semantic"), "semantic"))
    channels.append((named_many(store, refs, queries, seen).withColumn("by_name", F.lit(0.0)), "by_name"))
    merged = ranking.merge_channels(*channels, keys=tuple(ROW)).drop("by_name")
    if "vectors" not in queries.columns:
        merged = merged.withColumn("semantic", F.lit(0.0))
    rows = merged.join(seen, ["id", "repo_id"]).join(queries.select("query", "text"), "query")
    return written(ranking.signals(rows, F.col("text"), inbound_degree(store, refs)), "batch-candidates")


def ranked(candidates: DataFrame, k: int, weights: tuple[Column, Column, Column] | None = None, over: tuple[str, ...] = ("query",)) -> DataFrame:
    """The ``k`` best candidates of every query (of every key of ``over``), with score and rank; by default under the weights of the query's class."""
    keys = list(over)
    if weights is None:
        candidates = candidates.join(ranking.has_semantic(candidates, keys), keys)
        weights = ranking.weight_columns(tx.classify_query(F.col("text")), F.col("has_semantic"))
    fused = ranking.fuse(candidates, weights, keys).drop("has_semantic").withColumn("score", F.round("score", 9))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "repo_id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_many(store: Store, refs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best chunks of every query, ranked from 1."""
    queries = with_leads(queries)
    return of_all(ranked(lead_candidates(store, refs, queries, k), k), queries)


def outcomes(hits: DataFrame, queries: DataFrame, target: dict[str, str]) -> DataFrame:
    """``queries`` with the rank of the hit that is the target, null where none is, and the first hit; queries without any hit stay.

    ``target`` maps fields of a hit to columns of the query.
    """
    fields = sorted({*target, "file_path", "name"})
    lists = hits.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))), lambda h: F.struct(*[h[f].alias(f) for f in fields])).alias("hits"))  # at most k a query
    return ev.hit_ranks(queries.join(lists, "query", "left"), ["query"], target)


def measure(store: Store, refs: DataFrame, queries: DataFrame, target: dict[str, str], k: int = 10, levels=ev.LEVELS, dimensions=ev.DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rank metrics at every level): the batch is searched, each query's target is looked up among its hits, and ranks are rolled up.

    ``queries`` has the columns of ``dimensions``; ``query_kind`` is derived where it lacks.
    """
    if "query_kind" in dimensions and "query_kind" not in queries.columns:
        queries = queries.withColumn("query_kind", tx.classify_query(F.col("text")))
    found = written(outcomes(search_many(store, refs, queries, k), queries, target), "outcomes")
    return found, ev.rank_rollups(found, levels, dimensions)


def _hit_mrr(scored: DataFrame, queries: DataFrame, target: dict[str, str], setting: list[str], by: list[str]) -> DataFrame:
    """Mean reciprocal rank of the targets by ``setting`` and ``by``; a query that misses its target under a setting counts as 0. Where ``queries`` have ``lead``, ``scored`` holds the leading ones."""
    if "lead" in queries.columns:
        scored = of_all(scored, queries)
    same = F.lit(True)
    for field, column in target.items():
        same = same & (F.col(field) == F.col(column))
    wanted = queries.select("query", *by, *target.values())
    rank = scored.join(wanted.select("query", *target.values()), "query").filter(same).groupBy(*setting, "query").agg(F.min("rank").alias("rank"))
    every = wanted.select("query", *by).crossJoin(F.broadcast(scored.select(*setting).distinct()))  # one row a setting
    return every.join(rank, [*setting, "query"], "left").groupBy(*setting, *by).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 9).alias("mrr"))


def tune(candidates: DataFrame, queries: DataFrame, target: dict[str, str], grid: DataFrame, k: int = 10, by: str = "query_kind") -> tuple[DataFrame, DataFrame]:
    """(MRR of every trial and class of query, the best trial of every class): candidates collected once are scored anew under each (trial, alpha, beta, gamma).

    ``grid`` is a handful of parameter rows. Equal values go to the smaller trial. ``candidates`` are
    those of all ``queries`` or, where these have ``lead``, of the leading ones.
    """
    if by not in queries.columns:
        queries = queries.withColumn(by, tx.classify_query(F.col("text")))
    rescored = ranked(ev.with_settings(candidates, grid), k, (F.col("alpha"), F.col("beta"), F.col("gamma")), ("trial", "query"))
    trials = _hit_mrr(rescored, queries, target, ["trial"], [by])
    return trials, trials.groupBy(by).agg(F.min_by(F.struct("trial", "mrr"), F.struct(-F.col("mrr"), F.col("trial"))).alias("b")).select(by, "b.trial", "b.mrr")


def word_overlap(text: Column, content: Column) -> Column:
    """A stand-in for a model: the share of the query's words in the content."""
    parts = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(parts(text), parts(content))) / F.greatest(F.size(parts(text)), F.lit(1))


def tune_reranker(store: Store, candidates: DataFrame, queries: DataFrame, target: dict[str, str], grid: DataFrame, scorer: Callable[[Column, Column], Column] = word_overlap, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(MRR of every (pool, blend) and class of query, the cheapest setting of every class within ``tolerance`` of its best).

    Every query's candidates are ranked once, down to the largest pool; the second scorer sees each
    of them once, whatever the number of settings. ``grid`` is a handful of parameter rows.
    ``candidates`` are those of all ``queries`` or, where these have ``lead``, of the leading ones.
    """
    if "query_kind" not in queries.columns:
        queries = queries.withColumn("query_kind", tx.classify_query(F.col("text")))
    most = grid.agg(F.max("pool")).first()[0]
    best = ranked(candidates, most).withColumnRenamed("rank", "position")
    judged = best.join(store.chunks.select("id", "content"), "id").withColumn("reranker", F.round(scorer(F.col("text"), F.concat_ws("\n", "name", "content")), 9)).drop("content")
    scored = ev.grid_scores(written(judged, "judged"), grid, ["query"])
    settings = _hit_mrr(scored, queries, target, ["pool", "blend"], ["query_kind"])
    return settings, ev.cheapest_within(settings, ["query_kind"], tolerance)
