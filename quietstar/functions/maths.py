"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def safe_divisor(value: Column, floor: float = 0.001) -> Column:
    """``abs(value)``, or 1 when that is too small to divide by."""
    return F.when(F.abs(value) > floor, F.abs(value)).otherwise(F.lit(1.0))


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate that is null, not an error, when a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def cochran_n(population: Column, z: float = 1.96, e: float = 0.05, p: float = 0.5) -> Column:
    """Minimum sample for a proportion, with the finite-population correction."""
    n0 = (z ** 2 * p * (1 - p)) / (e ** 2)
    return F.ceil(F.lit(n0) / (1 + F.lit(n0 - 1) / population)).cast("bigint")


def first_max_label(values: dict[str, Column]) -> Column:
    """Name of the largest value; the earlier one on ties."""
    top = F.greatest(*values.values())
    return F.coalesce(*[F.when(value == top, F.lit(name)) for name, value in values.items()])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), l2_norm(a) * l2_norm(b))


def seeded_key(identifier: Column, seed: int | str) -> Column:
    """A reproducible random order: md5 of the id and the seed."""
    return F.md5(F.concat(identifier.cast("string"), F.lit(str(seed))))
