"""Shapiro and Wilk's and Anderson and Darling's tests of normality, for each period of each series.

Values meet their normal order scores by rank, in rows; sums over the rows give the statistics.  A constant period, or one too short
for a test (3 values, 8 for Anderson and Darling's p-value), gives null.  Equal values take successive ranks.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riftline.functions.moments import over
from riftline.functions.special import normal_tail

# Polynomials, lowest power first, of Royston's algorithm for Shapiro and Wilk's test.
ENDS = ((0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
SMALL_GAMMA, SMALL_MEAN, SMALL_SCALE = (-2.273, 0.459), (0.544, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
MEAN, SCALE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
# From where on, and the exponents' polynomials, of D'Agostino's p for Anderson and Darling's test.
TAILS = ((0.6, (1.2937, -5.709, 0.0186), False), (0.34, (0.9177, -4.279, -1.38), False), (0.2, (-8.318, 42.796, -59.938), True), (-math.inf, (-13.436, 101.14, -223.73), True))

_quantile = np.vectorize(NormalDist().inv_cdf, otypes=[float])


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Where the normal distribution reaches a share between 0 and 1."""
    return pd.Series(_quantile(p.to_numpy(float)) if len(p) else np.zeros(0))


@F.pandas_udf(DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """P(Z > z), null for null."""
    return pd.Series(np.where(z.isna(), np.nan, normal_tail(z.fillna(0).to_numpy(float))) if len(z) else np.zeros(0)).where(z.notna().to_numpy())


def polynomial(x: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        out = out * x + c
    return out


def ordered_values(series: DataFrame) -> DataFrame:
    """series_id, period, i (rank from 1), n, x (centred), s (sample deviation) of the periods of three values or more that aren't constant."""
    each = Window.partitionBy("series_id", "period")
    rows = series.select("series_id", "period", F.row_number().over(each.orderBy("value", "t")).alias("i"), F.count("*").over(each).alias("n"), (F.col("value") - F.avg("value").over(each)).alias("x"), F.stddev_samp("value").over(each).alias("s"), (F.max("value").over(each) > F.min("value").over(each)).alias("varied"))
    return rows.where("n >= 3 AND varied").drop("varied")


def shapiro_wilk(series: DataFrame) -> DataFrame:
    """W and its p-value by Royston's approximation, which was fitted up to 5000 values."""
    each = Window.partitionBy("series_id", "period")
    score = normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25))
    rows = ordered_values(series).withColumn("m", score)
    place = lambda k: F.max(F.when(F.col("i") == F.col("n") + 1 - k, F.col("m"))).over(each)
    rows = rows.select("*", F.sum(F.col("m") ** 2).over(each).alias("mm"), place(1).alias("m1"), place(2).alias("m2"))
    root = 1 / F.sqrt("n")
    a1 = polynomial(root, ENDS[0]) + F.col("m1") / F.sqrt("mm")
    a2 = polynomial(root, ENDS[1]) + F.col("m2") / F.sqrt("mm")
    rows = rows.select("*", F.when(F.col("n") == 3, math.sqrt(0.5)).otherwise(a1).alias("a1"), F.when(F.col("n") > 5, a2).alias("a2"))
    left = F.when(F.col("n") > 5, (F.col("mm") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2))
    left = left.when(F.col("n") > 3, (F.col("mm") - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("a1") ** 2))
    end = F.least(F.col("i"), F.col("n") + 1 - F.col("i"))
    weight = F.when(end == 1, F.signum(F.col("i") - (F.col("n") + 1) / 2) * F.col("a1")).when((end == 2) & (F.col("n") > 5), F.signum(F.col("i") - (F.col("n") + 1) / 2) * F.col("a2")).otherwise(F.coalesce(F.col("m") / F.sqrt(left), F.lit(0.0)))
    g = rows.groupBy("series_id", "period").agg(F.first("n").alias("n"), F.sum(weight * F.col("x")).alias("b"), F.sum(F.col("x") ** 2).alias("ss"))
    w = F.least(over(F.col("b") ** 2, F.col("ss")), F.lit(1.0))
    n, y = F.col("n").cast("double"), F.log(1 - F.col("w"))
    small = F.when(y < polynomial(n, SMALL_GAMMA), -F.log(polynomial(n, SMALL_GAMMA) - y))
    z = F.when(n <= 11, (small - polynomial(n, SMALL_MEAN)) / F.exp(polynomial(n, SMALL_SCALE))).otherwise((y - polynomial(F.log(n), MEAN)) / F.exp(polynomial(F.log(n), SCALE)))
    exact = F.greatest(6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))), F.lit(0.0))
    p = F.when(F.col("w") >= 1, 1.0).when(n == 3, exact).when((n <= 11) & small.isNull(), 0.0).otherwise(F.col("tail"))
    return g.select("series_id", "period", "n", w.alias("w")).withColumn("tail", upper_tail(z)).select("series_id", "period", "n", F.col("w").alias("shapiro_w"), p.alias("shapiro_p"))


def anderson_darling(series: DataFrame) -> DataFrame:
    """A squared against the normal distribution of the period's own mean and deviation, with its p-value."""
    rows = ordered_values(series).withColumn("upper", upper_tail(F.col("x") / F.col("s")))
    rows = rows.withColumn("lower", upper_tail(-F.col("x") / F.col("s")))
    floor = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-300)))
    n, i = F.col("n"), F.col("i")
    g = rows.groupBy("series_id", "period").agg(F.first("n").alias("n"), F.sum((2 * i - 1) * floor("lower") + (2 * n + 1 - 2 * i) * floor("upper")).alias("s"))
    g = g.select("series_id", "period", "n", (-n - F.col("s") / n).alias("ad"))
    a = F.col("ad") * (1 + 0.75 / n + 2.25 / n**2)
    p = None
    for least, terms, mirrored in TAILS:
        value = 1 - F.exp(polynomial(a, terms)) if mirrored else F.exp(polynomial(a, terms))
        p = F.when(a >= least, value) if p is None else p.when(a >= least, value)
    return g.select("*", F.when(n >= 8, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).alias("ad_p"))


def tests(series: DataFrame) -> DataFrame:
    """Both tests, a row for each period of a series."""
    return shapiro_wilk(series).join(anderson_darling(series).drop("n"), ["series_id", "period"])
