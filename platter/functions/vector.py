"""Vector arithmetic as columns (arrays of float or double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def all_finite(vector: Column) -> Column:
    infinity = F.lit(float("inf"))
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))


def unit(vector: Column) -> Column:
    """The vector divided by its length, which is computed once; NULL for a zero vector."""
    length = F.nullif(norm(vector), F.lit(0.0))
    scaled = F.zip_with(vector, F.array_repeat(length, F.size(vector)), lambda x, n: x.cast("double") / n)
    return F.when(F.forall(scaled, lambda x: x.isNotNull()), scaled)
