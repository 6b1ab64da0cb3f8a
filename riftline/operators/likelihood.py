"""Likelihood-based detectors and evidence from quantiles, extremes and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.functions.moments import clipped, over, side, sigmoid

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def _sides(series: DataFrame) -> DataFrame:
    v = F.col("value")
    return series.groupBy("series_id").agg(*[x for k, c in (("", v), ("0", side(v, 0)), ("1", side(v, 1))) for x in (F.count(c).cast("double").alias(f"n{k}"), F.avg(c).alias(f"m{k}"), F.var_pop(c).alias(f"v{k}"))])


def _fit(n: Column, v: Column) -> Column:
    """Largest Gaussian log likelihood of n values with this variance."""
    return -n / 2 * (F.log(2 * F.pi() * F.greatest(v, F.lit(1e-12))) + 1)


def likelihood_ratio(series: DataFrame) -> DataFrame:
    """Twice the gain in Gaussian log likelihood by two periods over one, and its logistic transform."""
    s = _sides(series)
    lr = 2 * (_fit(F.col("n0"), F.col("v0")) + _fit(F.col("n1"), F.col("v1")) - _fit(F.col("n"), F.col("v")))
    return s.select("series_id", lr.alias("lr"), sigmoid(clipped(lr / 2, -10, 10)).alias("probability"))


def information_criteria(series: DataFrame) -> DataFrame:
    """AIC of no break, a break in mean, in variance, and in both, with weights relative to the best of them."""
    s = _sides(series)
    n, pooled = F.col("n"), over(F.col("n0") * F.col("v0") + F.col("n1") * F.col("v1"), F.col("n"))
    around = lambda k: F.col(f"v{k}") + (F.col(f"m{k}") - F.col("m")) ** 2
    models = {
        "none": 4 - 2 * _fit(n, F.col("v")),
        "mean": 6 - 2 * _fit(n, pooled),
        "variance": 6 - 2 * (_fit(F.col("n0"), around("0")) + _fit(F.col("n1"), around("1"))),
        "both": 8 - 2 * (_fit(F.col("n0"), F.col("v0")) + _fit(F.col("n1"), F.col("v1"))),
    }
    a = s.select("series_id", *[c.alias(f"aic_{k}") for k, c in models.items()])
    best = F.least(*[F.col(f"aic_{k}") for k in models])
    weight = {k: F.exp(-(F.col(f"aic_{k}") - best) / 2) for k in models}
    return a.select("*", (1 - weight["none"] / (weight["none"] + weight["mean"] + weight["variance"] + weight["both"])).alias("break_weight"))


def laplace_criterion(series: DataFrame) -> DataFrame:
    """BIC gain of two Laplace periods over one, around medians."""
    v = F.col("value")
    half = F.lit(0.5)
    middle = series.groupBy("series_id").agg(F.percentile(v, half).alias("q"), F.percentile(side(v, 0), half).alias("q0"), F.percentile(side(v, 1), half).alias("q1"))
    own = F.when(F.col("period") == 0, F.col("q0")).otherwise(F.col("q1"))
    d = series.join(middle, "series_id").groupBy("series_id").agg(F.count("*").cast("double").alias("n"), F.avg(F.abs(v - F.col("q"))).alias("b"), *[x for p in (0, 1) for x in (F.count(side(v, p)).cast("double").alias(f"n{p}"), F.avg(side(F.abs(v - own), p)).alias(f"b{p}"))])
    fit = lambda k: -F.col(f"n{k}") * (F.log(2 * F.greatest(F.col(f"b{k}"), F.lit(1e-12))) + 1)
    gain = (2 * F.log("n") - 2 * fit("")) - (4 * F.log("n") - 2 * (fit("0") + fit("1")))
    return d.select("series_id", gain.alias("bic_gain"), sigmoid(clipped(gain / 2, -10, 10)).alias("probability"))


def quantile_shift(series: DataFrame) -> DataFrame:
    """Shifts of five quantiles in units of the first period's interquartile range, and the tails' share."""
    v = F.col("value")
    q = series.groupBy("series_id").agg(*[F.percentile(side(v, p), F.lit(x)).alias(f"q{p}_{round(x * 100)}") for p in (0, 1) for x in QUANTILES])
    scale = F.col("q0_75") - F.col("q0_25")
    shift = {round(x * 100): over(F.col(f"q1_{round(x * 100)}") - F.col(f"q0_{round(x * 100)}"), scale) for x in QUANTILES}
    return q.select("series_id", *[c.alias(f"shift_{k}") for k, c in shift.items()], over(F.abs(shift[10]) + F.abs(shift[90]), F.abs(shift[25]) + F.abs(shift[75])).alias("tail_to_centre"))


def extreme_rates(series: DataFrame) -> DataFrame:
    """Shares of values beyond 2, 2.5 and 3 median absolute deviations of the first period, by period."""
    v, half = F.col("value"), F.lit(0.5)
    m = series.groupBy("series_id").agg(F.percentile(side(v, 0), half).alias("m"))
    d = series.join(m, "series_id").withColumn("d", F.abs(v - F.col("m")))
    mad = d.groupBy("series_id").agg(F.percentile(side(F.col("d"), 0), half).alias("mad"))
    rate = lambda k, p: F.avg(side((F.col("d") > k * F.col("mad")).cast("double"), p))
    return d.join(mad, "series_id").groupBy("series_id").agg(*[rate(k, p).alias(f"beyond_{str(k).replace('.', '_')}_{p}") for k in (2.0, 2.5, 3.0) for p in (0, 1)])


def moment_change(series: DataFrame) -> DataFrame:
    """Changes of population skewness and kurtosis."""
    v = F.col("value")
    g = series.groupBy("series_id").agg(*[f(side(v, p)).alias(f"{k}{p}") for k, f in (("s", F.skewness), ("k", F.kurtosis)) for p in (0, 1)])
    return g.select("series_id", (F.col("s1") - F.col("s0")).alias("skew_change"), (F.col("k1") - F.col("k0")).alias("kurt_change"))


def location_scale(series: DataFrame) -> DataFrame:
    """Shift of the median in units of the first period's MAD, and ratio of the MADs."""
    v, half = F.col("value"), F.lit(0.5)
    m = series.groupBy("series_id", "period").agg(F.percentile(v, half).alias("m"))
    d = series.join(m, ["series_id", "period"]).groupBy("series_id", "period").agg(F.first("m").alias("m"), F.percentile(F.abs(v - F.col("m")), half).alias("mad"))
    g = d.groupBy("series_id").agg(*[F.max(side(F.col(x), p)).alias(f"{x}{p}") for x in ("m", "mad") for p in (0, 1)])
    return g.select("series_id", over(F.col("m1") - F.col("m0"), F.col("mad0")).alias("location_shift"), over(F.col("mad1"), F.col("mad0")).alias("scale_ratio"))
