"""Vectors as arrays of doubles: Column -> Column, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def unit(a: Column, eps: float = 1e-12) -> Column:
    n = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x.cast("double") / n)
