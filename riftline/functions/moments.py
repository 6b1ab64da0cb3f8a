"""Moments and guarded arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8  #: fixed value, added to denominators of ratios


def side(value: Column, period: int) -> Column:
    """The value in one period, null in the other; aggregates pass over nulls."""
    return F.when(F.col("period") == period, value)


def skew(value: Column) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurt(value: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    n = F.count(value)
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(value) + 6))


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(df, digits: int = 6, nudge: float = 0.0):
    """Rounds every double column; results then agree across engines that sum in other orders."""
    return df.select(*[F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
