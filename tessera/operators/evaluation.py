"""Retrieval evaluation: rank metrics, rollups, pivots, sampling, parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import numbered

ALL = "__all__"


def rank_metrics(rank: str = "rank", weight: str | None = None) -> list[Column]:
    """Metrics of a nullable 1-based rank: a miss counts as 0 in all of them but the median. ``weight`` is a column of counts."""
    r = F.col(rank).cast("double")
    w = F.lit(1) if weight is None else F.col(weight)
    mean = lambda x, name: (F.sum(w * F.coalesce(x, F.lit(0.0))) / F.sum(w)).alias(name)
    hit = lambda k: mean(F.when(r <= k, 1.0), f"hit_at_{k}")
    return [
        F.sum(w).cast("long").alias("n_queries"),
        hit(1),
        hit(3),
        hit(10),
        mean(1 / r, "mrr"),
        mean(1 / F.log2(r + 1), "ndcg_at_10"),
        F.percentile(r, 0.5, w).alias("median_rank"),
        mean(F.when(r.isNull(), 1.0), "not_found_pct"),
    ]


def latency_quantiles(column: str = "latency_ms") -> list[Column]:
    """p50 and p95, interpolated linearly."""
    return [F.percentile(column, q).alias(f"search_p{round(q * 100)}_ms") for q in (0.5, 0.95)]


#: The levels of the report; each is kept apart by arm.
LEVELS = (("slug", "language", "provenance"), ("slug", "language"), ("slug",), ("language",), ("symbol_kind",), ("provenance",), ("query_kind",), ("symbol_kind", "query_kind"), ())
DIMENSIONS = ("arm", "slug", "language", "symbol_kind", "provenance", "query_kind")


def rollups(outcomes: DataFrame, metrics: list[Column], levels: tuple[tuple[str, ...], ...] = LEVELS, dimensions: tuple[str, ...] = DIMENSIONS, always: str = "arm") -> DataFrame:
    """Metrics at several levels in one pass of GROUPING SETS; dimensions that a level leaves out hold ``__all__``."""
    sets = [[F.col(always), *[F.col(d) for d in level]] for level in levels]
    keys = [F.when(F.grouping(d) == 1, F.lit(ALL)).otherwise(F.col(d)).alias(d) for d in dimensions if d != always]
    grouped = outcomes.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(*metrics, *[k.alias(f"__{d}") for k, d in zip(keys, [d for d in dimensions if d != always], strict=True)])
    names = [c for c in grouped.columns if not c.startswith("__") and c not in dimensions]
    return grouped.select(always, *[F.col(f"__{d}").alias(d) for d in dimensions if d != always], *names)


def rank_rollups(outcomes: DataFrame, levels: tuple[tuple[str, ...], ...] = LEVELS, dimensions: tuple[str, ...] = DIMENSIONS, rank: str = "rank") -> DataFrame:
    """The rank metrics at every level. Outcomes are first counted by dimensions and rank, so the levels expand a small table, whatever the number of outcomes."""
    counts = outcomes.groupBy(*dimensions, rank).agg(F.count("*").alias("__w"))
    return rollups(counts, rank_metrics(rank, "__w"), levels, dimensions)


def hit_ranks(batch: DataFrame, keys: list[str], target: dict[str, str], hits: str = "hits") -> DataFrame:
    """``batch`` without its hits, with the best position (from 1) of the hit that is the target, null if none is, and the first hit.

    ``target`` maps fields of a hit to columns of the query. Positions come from the array's order.
    """
    exploded = batch.select(*keys, *[c for c in target.values() if c not in keys], F.posexplode(hits).alias("__pos", "__hit"))
    same = F.lit(True)
    for field, column in target.items():
        same = same & (F.col(f"__hit.{field}") == F.col(column))
    ranks = exploded.groupBy(*keys).agg(F.min(F.when(same, F.col("__pos") + 1)).alias("rank"))
    out = batch.withColumn("top", F.get(hits, F.lit(0))).drop(hits)
    return out.join(ranks, keys, "left")


def truncation_mrr(outcomes: DataFrame) -> DataFrame:
    """Mean reciprocal rank of the hits alone, by whether the target's vector was truncated; misses don't count here."""
    return outcomes.groupBy("target_truncated").agg(F.count("*").alias("n_queries"), F.avg(1 / F.col("rank")).alias("mrr"))


def pivot(df: DataFrame, rows: str, columns: str, values: list[str], agg: Column, total: str | None = None) -> DataFrame:
    """A table of one aggregate by two keys with stated columns; empty cells are 0. ``total`` names a row sum."""
    out = df.groupBy(rows).pivot(columns, values).agg(agg).fillna(0.0 if total is None else 0)
    if total is not None:
        out = out.withColumn(total, sum((F.coalesce(F.col(v), F.lit(0)) for v in values[1:]), F.coalesce(F.col(values[0]), F.lit(0))))
    return out


def row_percent(table: DataFrame, values: list[str]) -> DataFrame:
    whole = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return table.select(*[c for c in table.columns if c not in values], *[F.round(F.when(whole != 0, 100.0 * F.col(v) / whole).otherwise(0.0), 1).alias(v) for v in values])


def stratified(df: DataFrame, cell: list[str], key: list[str], n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` rows of every cell, the same ones for the same seed: rows are ordered by a hash of key and seed."""
    order = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))), 256)
    w = Window.partitionBy(*cell).orderBy(order, *key)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def frequent_groups(df: DataFrame, by: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups with ``least`` rows or more, the groups left out with their counts)."""
    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    return df.join(sizes.filter(F.col("n") >= least).select(by), by, "left_semi"), sizes.filter(F.col("n") < least)


def with_settings(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row under every setting of ``grid``, a handful of parameter rows; Spark broadcasts it by its measured size."""
    return rows.crossJoin(grid)


def with_expansions(queries: DataFrame, expansions: DataFrame, keys: list[str]) -> DataFrame:
    """``queries`` with what a model added to them, null where it added nothing; ``expansions`` has one row a key."""
    return queries.join(expansions, keys, "left")


def grid_scores(candidates: DataFrame, grid: DataFrame, keys: list[str], second: str = "reranker", first: str = "score") -> DataFrame:
    """Every candidate under every (pool, blend) of a grid: those within the pool are blended, rescored and ranked anew.

    The grid is a handful of parameter rows.
    """
    pooled = with_settings(candidates, grid).filter(F.col("position") <= F.col("pool"))
    group = ["pool", "blend", *keys]
    w = Window.partitionBy(*group)
    span = F.max(second).over(w) - F.min(second).over(w)
    scaled = F.when(span == 0, 0.0).otherwise((F.col(second) - F.min(second).over(w)) / span)
    blended = pooled.withColumn("blended", F.col("blend") * F.col(first) + (1 - F.col("blend")) * scaled)
    return blended.withColumn("rank", F.row_number().over(w.orderBy(F.desc("blended"), "id", *[c for c in ("repo_id",) if c in candidates.columns])))


def cheapest_within(results: DataFrame, scope: list[str], tolerance: float, cost: str = "pool", value: str = "mrr") -> DataFrame:
    """In every scope the cheapest setting whose value is within ``tolerance`` of the best; equal costs go to the better value."""
    best = F.max(value).over(Window.partitionBy(*scope))
    near = results.withColumn("__best", best).filter(F.col(value) >= F.col("__best") - tolerance)
    w = Window.partitionBy(*scope).orderBy(cost, F.desc(value), *[c for c in results.columns if c not in (*scope, cost, value)])
    return near.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__best")


def best_so_far(trials: DataFrame, scope: list[str], order: str = "trial", value: str = "value") -> DataFrame:
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("best_so_far", F.max(value).over(w))


def simplex(u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Weights that sum to 1 from two numbers in 0..1."""
    return u, v * (1 - u), (1 - u) * (1 - v)


def content_digest(df: DataFrame, by: list[str], key: list[str], columns: list[str], block: int = 1024, levels: int | None = None) -> DataFrame:
    """(by, n, digest): a SHA-256 of every group's rows in order of ``key``.

    Rows are numbered by range, and hashes are folded ``block`` at a time, level by level, until the
    largest group has one; so no task sees more than a block, whatever the size of a group. A null
    counts as one, distinct from every text.

    The number of levels so found, and with it every digest, depends on the largest group. With
    ``levels`` given every group has just as many, and its own rows alone decide its digest; the last
    level then folds all that is left of a group, 64 bytes for ``block`` ** (``levels`` - 1) rows.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = numbered(df.select(*by, *key, F.sha2(F.concat_ws("\x1f", *map(text, columns)), 256).alias("__h")), *by, *key, "__h")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("number").alias("__first"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    mine = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], "n", "__first")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    level = rows.join(mine, same).select(*by, (F.col("number") - F.col("__first")).alias("__at"), "__h", "n")
    depth = 0
    while True:
        depth += 1
        last = most <= block if levels is None else depth == levels
        bucket = F.lit(0) if last else F.floor(F.col("__at") / block)
        parts = F.array_sort(F.collect_list(F.struct("__at", "__h")))  # at most ``block``, but for a last level of given ``levels``
        level = level.groupBy(*by, "n", bucket.alias("__b")).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["__h"]), ""), 256).alias("__h")).withColumnRenamed("__b", "__at")
        if last:
            return level.select(*by, "n", F.col("__h").alias("digest"))
        most = -(-most // block)


def list_stats(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean length of a list column and the share of rows where it isn't empty."""
    n = F.coalesce(F.size(column), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return df.groupBy(*by).agg(F.avg(n).alias("mean_length"), F.avg((n > 0).cast("double")).alias("share"))
