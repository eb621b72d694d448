"""Fusion of channels into one ranking, proximity to a diff, and the blend with a second scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.paths import parent

#: Weights of (semantic, lexical, name) per class of query.
WEIGHTS = {"concept": (0.50, 0.40, 0.10), "identifier": (0.05, 0.20, 0.75), "code": (0.05, 0.30, 0.65)}


def weights_for(kind: str, has_semantic: bool, override: tuple[float, float, float] | None = None) -> tuple[float, float, float]:
    """Weights that sum to 1; without any semantic signal its weight goes to the other two in proportion, or half each if both are 0."""
    alpha, beta, gamma = override or WEIGHTS[kind]
    if abs(alpha + beta + gamma - 1) > 1e-3:
        raise ValueError("weights must sum to 1")
    if has_semantic:
        return alpha, beta, gamma
    rest = beta + gamma
    return (0.0, beta + alpha * beta / rest, gamma + alpha * gamma / rest) if rest else (0.0, 0.5, 0.5)


def scaled(df: DataFrame, columns: list[str], over: list[str] | None = None) -> DataFrame:
    """Every column scaled to 0..1 as ``scaled_<column>``, over all rows or within each key of ``over``; 0 where all are equal.

    Over all rows the extremes are one aggregated row that is joined back, so the rows never meet in one task.
    """
    ends = [e for c in columns for e in (F.min(c).alias(f"__min_{c}"), F.max(c).alias(f"__max_{c}"))]
    if over:
        out = df.join(df.groupBy(*over).agg(*ends), over)  # partial extremes come before the shuffle, so a common key costs no more
    else:
        out = df.crossJoin(F.broadcast(df.agg(*ends)))  # one row
    low, span = (lambda c: F.col(f"__min_{c}")), (lambda c: F.col(f"__max_{c}") - F.col(f"__min_{c}"))
    out = out.withColumns({f"scaled_{c}": F.when(span(c) == 0, F.lit(0.0)).otherwise((F.col(c) - low(c)) / span(c)) for c in columns})
    return out.drop(*[f"__{e}_{c}" for c in columns for e in ("min", "max")])


def has_semantic(candidates: DataFrame, over: list[str] | None = None, column: str = "semantic") -> DataFrame:
    """``has_semantic``: whether the largest similarity is other than 0; one row, or one for each key of ``over``. Where some candidate has 0, which stands for none, negative ones don't count."""
    return candidates.groupBy(*over or []).agg((F.coalesce(F.max(column), F.lit(0.0)) != 0).alias("has_semantic"))


def merge_channels(*channels: tuple[DataFrame, str], keys: tuple[str, ...] = ("id", "repo_id")) -> DataFrame:
    """One row per key with every channel's score, 0 where it has none: one union and one aggregate instead of full joins."""
    names = [n for _, n in channels]
    out = None
    for df, name in channels:
        part = df.select(*keys, *[(F.col(name) if n == name else F.lit(None)).cast("double").alias(n) for n in names])
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys).agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])


def proximity(candidates: DataFrame, edges: DataFrame, paths: DataFrame, changed: DataFrame) -> DataFrame:
    """Adds ``proximity``: 1.5 in a changed file, 1.2 next to one by an edge, 1.1 in the same directory as one, else 1."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other")))
    touched = paths.join(changed.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("other"))
    near = both.join(touched, "other", "left_semi").select("id").distinct().withColumn("__near", F.lit(True))
    files = changed.select("file_path", F.lit(True).alias("__file")).distinct()
    dirs = changed.filter(F.contains("file_path", F.lit("/"))).select(parent(F.col("file_path")).alias("__dir")).distinct().withColumn("__in", F.lit(True))
    out = candidates.join(files, "file_path", "left").join(near, "id", "left").withColumn("__own", parent(F.col("file_path"))).join(dirs, F.col("__own") == F.col("__dir"), "left")
    value = F.when(F.col("__file"), 1.5).when(F.col("__near"), 1.2).when(F.col("__in"), 1.1).otherwise(1.0)
    return out.withColumn("proximity", value).select(*candidates.columns, "proximity")


def signals(candidates: DataFrame, query: str | Column, degree: DataFrame | None = None) -> DataFrame:
    """Adds name, kind_boost, file_penalty and importance to candidates with semantic and lexical scores."""
    out = candidates.withColumns({"name_score": tx.name_score(query if isinstance(query, Column) else F.lit(query), F.col("name")), "kind_boost": tx.kind_boost(F.col("kind")), "file_penalty": tx.file_penalty(F.col("file_path"))})
    if degree is None:
        return out.withColumn("importance", F.lit(1.0))
    return out.join(degree.select("id", "degree"), "id", "left").withColumn("importance", tx.importance(F.coalesce("degree", F.lit(0)))).drop("degree")


def weight_columns(kind: Column, has_semantic: Column, override: tuple[float, float, float] | None = None) -> tuple[Column, Column, Column]:
    """``weights_for`` as columns, where the class of the query and whether there is a semantic signal are columns."""
    pick = lambda i, has: F.coalesce(*[F.when(kind == k, F.lit(float(weights_for(k, has, override)[i]))) for k in WEIGHTS])
    return tuple(F.when(has_semantic, pick(i, True)).otherwise(pick(i, False)) for i in range(3))


def fuse(candidates: DataFrame, weights: tuple[float | Column, ...], over: list[str] | None = None) -> DataFrame:
    """Adds ``score``: the weighted sum of the min-max scaled signals, times the multipliers that are there. Weights are numbers or columns of ``candidates``."""
    alpha, beta, gamma = (w if isinstance(w, Column) else F.lit(float(w)) for w in weights)
    total = alpha * F.col("scaled_semantic") + beta * F.col("scaled_lexical") + gamma * F.col("scaled_name_score")
    for factor in ("kind_boost", "file_penalty", "importance", "proximity"):
        if factor in candidates.columns:
            total = total * F.col(factor)
    return scaled(candidates, ["semantic", "lexical", "name_score"], over).withColumn("score", total).select(*candidates.columns, "score")


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id", *[c for c in ("repo_id",) if c in scored.columns]).limit(k)


def blend(scored: DataFrame, second: str, weight: float, over: list[str] | None = None) -> DataFrame:
    """Adds ``blended``: weight * score + (1 - weight) * the second score, scaled to 0..1."""
    return scaled(scored, [second], over).withColumn("blended", weight * F.col("score") + (1 - weight) * F.col(f"scaled_{second}")).drop(f"scaled_{second}")
