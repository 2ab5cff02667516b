"""Vector and rank functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b) + F.lit(epsilon))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def rrf_term(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def yake_similarity(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + score)


def fulltext_similarity(score: Column) -> Column:
    return F.least(score / 10.0, F.lit(1.0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
