"""Functions of vector columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; a vector of almost no length becomes zeros."""
    n = norm(v)
    return F.when(n <= EPSILON, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) / n))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size <= EPSILON, F.lit(0.0)).otherwise(dot(a, b) / size)


def rounded(x: Column) -> Column:
    """A weight to 6 places as SQL engines round doubles, by whole millionths; ``F.round`` goes by the decimal digits, and takes other ties up."""
    return F.floor(x * 1e6 + 0.5) / 1e6
