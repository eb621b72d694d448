"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size != 0, dot(a, b) / size)


def best_cosine(vector: Column, queries: list[list[float]]) -> Column:
    """The largest cosine to any of a few query vectors, in one pass over the column and without a join."""
    scores = [cosine(vector, F.array(*[F.lit(float(x)) for x in q])) for q in queries]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]
