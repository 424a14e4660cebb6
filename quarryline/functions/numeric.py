"""Guarded ratios, clamps, vector and score functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, the default where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def higher_is_better(x: Column, base: Column) -> Column:
    return F.when((x > 0) & (base > 0), x / (x + base)).otherwise(0.5)


def lower_is_better(x: Column, base: Column) -> Column:
    return F.when((x > 0) & (base > 0), base / (x + base)).otherwise(0.5)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths and for zero vectors."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of bits differ, their difference in length included."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)


def nearest_rank(values: Column, q: float) -> Column:
    """The sorted value at floor((n - 1) * q + 0.999999)."""
    own = F.array_sort(values)
    return F.element_at(own, F.floor((F.size(own) - 1) * F.lit(q) + F.lit(0.999999)).cast("int") + 1)


def rank_prior(rank: Column, count: Column) -> Column:
    """1 for the first of count, 0 for the last."""
    return F.when(count > 1, 1 - rank / (count - 1)).otherwise(1.0)


def in_order(x: Column, order: list[str]) -> Column:
    """The place of a name in a fixed order, from 0; -1 for others."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in order]), x), F.lit(0)) - 1
