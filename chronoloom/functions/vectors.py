"""Vector functions on arrays, in double precision and inside code generation where arrays allow."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1; zero vectors stay."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def min_max(x: Column, *partition: str) -> Column:
    """Scaled to 0..1 within the partition; constant input gives 1."""
    w = Window.partitionBy(*partition)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi == lo, 1.0).otherwise((x - lo) / (hi - lo))
