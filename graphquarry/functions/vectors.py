"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector at length 1."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda s: F.transform(s["v"], lambda x: (x / s["n"]).cast("float"))), 1)


def is_valid(a: Column, dimensions: int) -> Column:
    """Of the right size, finite, not zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimensions) & finite & F.exists(a, lambda x: x != 0), F.lit(False))
