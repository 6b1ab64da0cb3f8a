"""Two-sample contrasts between the periods of each series: moments, tests on means, spread and ranks, ECDF distances.

Tests are null where a period has fewer than MIN_SAMPLE values or no spread; distances need two values in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.moments import TINY, kurt, over, side, skew

MIN_SAMPLE = 8


def _v(period: int) -> Column:
    return side(F.col("value"), period)


def counts(series: DataFrame) -> DataFrame:
    """n, mean and sample variance of each period, one row per series."""
    return series.groupBy("series_id").agg(*[x for p in (0, 1) for x in (F.count(_v(p)).alias(f"n{p}"), F.avg(_v(p)).alias(f"m{p}"), F.var_samp(_v(p)).alias(f"v{p}"))])


def testable(n0: str = "n0", n1: str = "n1", v0: str = "v0", v1: str = "v1") -> Column:
    return (F.col(n0) >= MIN_SAMPLE) & (F.col(n1) >= MIN_SAMPLE) & (F.col(v0) > 0) & (F.col(v1) > 0)


def descriptive(series: DataFrame) -> DataFrame:
    """Mean, population deviation, skewness and kurtosis of each period, with differences and ratios."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    moments = lambda p: (zero(F.avg(_v(p))).alias(f"mean_{p}"), zero(F.stddev_pop(_v(p))).alias(f"std_{p}"), skew(_v(p)).alias(f"skew_{p}"), kurt(_v(p)).alias(f"kurt_{p}"), F.count(_v(p)).alias(f"n_{p}"))
    d = series.groupBy("series_id").agg(*moments(0), *moments(1))
    names = ("mean", "std", "skew", "kurt")
    return d.select("*", *[(F.col(f"{x}_1") - F.col(f"{x}_0")).alias(f"{x}_diff") for x in names], *[(F.col(f"{x}_1") / (F.col(f"{x}_0") + TINY)).alias(f"{x}_ratio") for x in ("mean", "std")], (F.col("n_1") / (F.col("n_0") + 1)).alias("length_ratio"))


def student_t(series: DataFrame) -> DataFrame:
    """Equal-variance t statistic (before minus after) and its degrees of freedom."""
    c = counts(series)
    df = F.col("n0") + F.col("n1") - 2
    pooled = over((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), df)
    t = over(F.col("m0") - F.col("m1"), F.sqrt(pooled * (over(F.lit(1), F.col("n0")) + over(F.lit(1), F.col("n1")))))
    return c.select("series_id", F.when(testable(), t).alias("t"), F.when(testable(), df.cast("double")).alias("df"))


def welch_t(series: DataFrame) -> DataFrame:
    c = counts(series)
    a, b = over(F.col("v0"), F.col("n0")), over(F.col("v1"), F.col("n1"))
    df = over((a + b) ** 2, over(a**2, F.col("n0") - 1) + over(b**2, F.col("n1") - 1))
    return c.select("series_id", F.when(testable(), over(F.col("m0") - F.col("m1"), F.sqrt(a + b))).alias("t"), F.when(testable(), df).alias("df"))


def levene(series: DataFrame) -> DataFrame:
    """Brown-Forsythe statistic: one-way analysis of variance of distances to each period's median."""
    middle = series.groupBy("series_id", "period").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    z = series.join(middle, ["series_id", "period"]).withColumn("z", F.abs(F.col("value") - F.col("median")))
    g = z.groupBy("series_id").agg(
        *[x for p in (0, 1) for x in (F.count(_v(p)).alias(f"n{p}"), F.var_samp(_v(p)).alias(f"v{p}"), F.avg(side(F.col("z"), p)).alias(f"z{p}"), F.var_pop(side(F.col("z"), p)).alias(f"s{p}"))], F.avg("z").alias("zz")
    )
    between = F.col("n0") * (F.col("z0") - F.col("zz")) ** 2 + F.col("n1") * (F.col("z1") - F.col("zz")) ** 2
    within = F.col("n0") * F.col("s0") + F.col("n1") * F.col("s1")
    return g.select("series_id", F.when(testable(), over((F.col("n0") + F.col("n1") - 2) * between, within)).alias("w"))


def _ranked(series: DataFrame) -> DataFrame:
    """Adds the average rank among all values of the series, and how many share it."""
    same = Window.partitionBy("series_id", "value")
    ordered = Window.partitionBy("series_id").orderBy("value")
    return series.withColumn("ties", F.count("*").over(same)).withColumn("rank", F.rank().over(ordered) + (F.col("ties") - 1) / 2)


def mann_whitney(series: DataFrame) -> DataFrame:
    """U of the first period and its normal score with corrections for ties and continuity."""
    g = _ranked(series).groupBy("series_id").agg(
        F.sum(side(F.col("rank"), 0)).alias("r0"), *[x for p in (0, 1) for x in (F.count(_v(p)).alias(f"n{p}"), F.var_samp(_v(p)).alias(f"v{p}"))], F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("tied")
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n, u = n0 + n1, F.col("r0") - n0 * (n0 + 1) / 2
    spread = F.sqrt(n0 * n1 / 12 * ((n + 1) - over(F.col("tied"), n * (n - 1))))
    z = over(F.greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5, spread)
    return g.select("series_id", F.when(testable(), u).alias("u"), F.when(testable(), z).alias("z"))


def ecdf(series: DataFrame) -> DataFrame:
    """One row per distinct value of a series: counts of both periods up to it and in all, and the next value."""
    distinct = series.groupBy("series_id", "value").agg(F.count(_v(0)).alias("f0"), F.count(_v(1)).alias("f1"))
    whole = Window.partitionBy("series_id")
    ordered = whole.orderBy("value")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return distinct.select(
        "series_id", "value", "f0", "f1", F.sum("f0").over(upto).alias("c0"), F.sum("f1").over(upto).alias("c1"), F.sum("f0").over(whole).alias("n0"), F.sum("f1").over(whole).alias("n1"), (F.lead("value").over(ordered) - F.col("value")).alias("gap")
    )


def ecdf_distances(series: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov, Wasserstein and energy distance from one pooled scan."""
    e = ecdf(series).withColumn("d", over(F.col("c0"), F.col("n0")) - over(F.col("c1"), F.col("n1")))
    g = e.groupBy("series_id").agg(F.first("n0").alias("n0"), F.first("n1").alias("n1"), F.max(F.abs("d")).alias("ks"), F.sum(F.abs("d") * F.coalesce("gap", F.lit(0.0))).alias("w1"), F.sqrt(2 * F.sum(F.col("d") ** 2 * F.coalesce("gap", F.lit(0.0)))).alias("energy"))
    enough = (F.col("n0") >= 2) & (F.col("n1") >= 2)
    return g.select("series_id", F.col("n0").cast("long").alias("n0"), F.col("n1").cast("long").alias("n1"), *[F.when(enough, F.col(x)).alias(y) for x, y in (("ks", "ks"), ("w1", "wasserstein"), ("energy", "energy"))])


def cramer_von_mises(series: DataFrame) -> DataFrame:
    own = _ranked(series).withColumn("i", F.row_number().over(Window.partitionBy("series_id", "period").orderBy("value", "t")))
    off = (F.col("rank") - F.col("i")) ** 2
    g = own.groupBy("series_id").agg(*[x for p in (0, 1) for x in (F.count(_v(p)).cast("double").alias(f"n{p}"), F.sum(side(off, p)).alias(f"q{p}"))])
    n0, n1 = F.col("n0"), F.col("n1")
    t = over(n0 * F.col("q0") + n1 * F.col("q1"), n0 * n1 * (n0 + n1)) - over(4 * n0 * n1 - 1, 6 * (n0 + n1))
    return g.select("series_id", F.when((n0 >= 2) & (n1 >= 2), t).alias("cvm"))


def anderson_darling(series: DataFrame) -> DataFrame:
    """Two-sample Anderson-Darling statistic with midranks."""
    e = ecdf(series)
    n = (F.col("n0") + F.col("n1")).cast("double")
    ties = (F.col("f0") + F.col("f1")).cast("double")
    b = F.col("c0") + F.col("c1") - ties / 2
    part = lambda p: over(ties / n * (n * (F.col(f"c{p}") - F.col(f"f{p}") / 2) - b * F.col(f"n{p}")) ** 2, b * (n - b) - n * ties / 4)
    g = e.select("series_id", "n0", "n1", part(0).alias("a0"), part(1).alias("a1")).groupBy("series_id").agg(F.first("n0").alias("n0"), F.first("n1").alias("n1"), F.sum("a0").alias("a0"), F.sum("a1").alias("a1"))
    total = F.col("n0") + F.col("n1")
    return g.select("series_id", F.when((F.col("n0") >= 5) & (F.col("n1") >= 5), over(total - 1, total) * (over(F.col("a0"), F.col("n0")) + over(F.col("a1"), F.col("n1")))).alias("ad"))
