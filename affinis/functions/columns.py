"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(numerator: Column, denominator: Column) -> Column:
    """The quotient, 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def steady(value: Column) -> Column:
    """Nine decimals: what sums in another order leave behind is gone before anything is compared with it."""
    return F.round(value, 9)


def shown(value: Column) -> Column:
    """Six decimals, with ties decided upwards a little early, so that another summation order shows the same."""
    return F.floor(value * 1e6 + F.lit(0.501)) / F.lit(1e6)


def shuffled(*parts: Column) -> Column:
    """A hash to order by: a reproducible shuffle."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of that hash."""
    return F.conv(F.substring(shuffled(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def logistic(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(value, -500.0, 500.0)))


def discount(rank: Column, cutoff: int) -> Column:
    return F.when(rank <= cutoff, F.lit(1.0) / F.log2(rank + F.lit(1.0))).otherwise(F.lit(0.0))
