"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """NULL where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def scaled(a: Column | str, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def root_unit(a: Column | str) -> Column:
    """Square roots of the shares of the sum: turns Euclidean into Hellinger distance."""
    s = total(F.transform(a, lambda x: x.cast("double")))
    return F.transform(a, lambda x: F.sqrt(x.cast("double") / F.greatest(s, F.lit(1e-12))))


def power_mean(values: Column | str, p: float = 3.0) -> Column:
    """Generalised mean of clamped values (p = 3: GeM pooling)."""
    clamped = F.transform(values, lambda x: F.pow(F.greatest(x.cast("double"), F.lit(1e-6)), F.lit(p)))
    return F.pow(total(clamped) / F.size(clamped), F.lit(1.0 / p))


def finite(a: Column | str, size: int) -> Column:
    """Whether the array has ``size`` finite values that are not all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) == size) & ~bad & F.exists(a, lambda x: x != 0), F.lit(False))
