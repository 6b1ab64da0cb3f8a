"""Probabilities of a break at the boundary: segment models compared by AIC, ladders of evidence, and their combinations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.moments import clipped, over, side
from riftline.operators.embedding import approximate_entropy
from riftline.operators.shape import ordered, permutation_entropy, within

# Floors of spreads, scale of the MAD, shortest segments, share of a series a segment must have.
FLOOR, MAD_SCALE = 1e-6, 1.4826
LEAST, LEAST_MOMENTS, LEAST_AR, LEAST_SHARE = 10, 15, 20, 0.15
NARROW = 1e-8
MODELS = ("mean", "variance", "mean_variance", "trend", "ar", "scale")
# Bounds, strictly exceeded, and the evidence they give, highest first; then the evidence of none.
QUANTILE_LADDER = ((3.0, 0.9), (1.5, 0.7), (1.2, 0.4)), 0.1
EXTREME_LADDER = ((0.5, 0.8), (0.3, 0.6), (0.1, 0.3)), 0.1
SKEW_LADDER = ((1.5, 0.5), (0.5, 0.3)), 0.0
KURT_LADDER = ((2.0, 0.5), (1.0, 0.3)), 0.0
SPREAD_LADDER = ((0.5, 0.7), (0.3, 0.5), (0.1, 0.2)), 0.05
LOCATION_LADDER = ((2.0, 0.6), (1.0, 0.4), (0.5, 0.2)), 0.0
SCALE_LADDER = ((0.5, 0.4), (0.3, 0.2)), 0.0
PERMUTATION_LADDER = ((0.3, 0.5), (0.1, 0.3)), 0.0
REGULARITY_LADDER = ((0.5, 0.5), (0.2, 0.3)), 0.0
MOST = 0.95
WEIGHTS = {"quantiles": 0.25, "entropy": 0.20, "extremes": 0.20, "moments": 0.15, "timescales": 0.15, "location_scale": 0.05}


def around_medians(series: DataFrame) -> DataFrame:
    """Adds q, the series' median, q0 and q1, the periods', and d and own, the distances from the series' and the period's."""
    v, half = F.col("value"), F.lit(0.5)
    q = series.groupBy("series_id").agg(F.percentile(v, half).alias("q"), *[F.percentile(side(v, p), half).alias(f"q{p}") for p in (0, 1)])
    return series.join(q, "series_id").withColumn("d", F.abs(v - F.col("q"))).withColumn("own", F.abs(v - F.when(F.col("period") == 0, F.col("q0")).otherwise(F.col("q1"))))


def _unexplained(y: Column, x: Column) -> Column:
    """Sum of squares around the line of y on x, around the mean where x has no spread."""
    return F.regr_syy(y, x) - F.coalesce(over(F.regr_sxy(y, x) ** 2, F.regr_sxx(y, x)), F.lit(0.0))


def _gauss(n: Column, squares: Column, variance: Column) -> Column:
    s2 = F.greatest(variance, F.lit(FLOOR**2))
    return -n / 2 * F.log(2 * F.pi() * s2) - squares / (2 * s2)


def _laplace(n: Column, distances: Column, mad: Column) -> Column:
    b = F.greatest(mad * MAD_SCALE, F.lit(FLOOR))
    return -n * F.log(2 * b) - distances / b


def _aic(likelihood: Column, parameters: int, n: Column) -> Column:
    """Akaike's criterion, corrected where there are fewer than forty observations a parameter."""
    small = over(F.lit(2.0 * parameters * (parameters + 1)), n - parameters - 1)
    return 2 * parameters - 2 * likelihood + F.when(n / parameters < 40, small).otherwise(0.0)


def _probability(none: Column, broken: Column) -> Column:
    gap = broken - none
    return F.when(gap < -10, 0.99).when(gap > 10, 0.01).otherwise(clipped(1 / (1 + F.exp(gap / 2)), 0.01, 0.99))


def segment_models(series: DataFrame) -> DataFrame:
    """Probability of a break by six models, and by their maximum, mean and average with Akaike weights.

    A model with too few values in a period gives 0.  Weights are relative to the best model, so that they can't overflow.
    """
    lag = F.lag("value").over(ordered())
    rows = around_medians(series.withColumn("x", lag))
    y, x, t = F.col("value"), F.col("x"), F.col("t").cast("double")
    cut = {"": lambda c: c, "0": lambda c: side(c, 0), "1": lambda c: side(c, 1)}
    sums = []
    for k, part in cut.items():
        sums += [F.count(part(y)).cast("double").alias(f"n{k}"), F.avg(part(y)).alias(f"m{k}"), F.var_pop(part(y)).alias(f"v{k}"), _unexplained(part(y), t).alias(f"trend{k}"), _unexplained(part(y), x).alias(f"ar{k}")]
        distance = F.col("own") if k else F.col("d")
        sums += [F.sum(part(distance)).alias(f"l{k}"), F.percentile(part(distance), F.lit(0.5)).alias(f"mad{k}")]
    g = rows.groupBy("series_id").agg(*sums)
    c = F.col
    n, pairs, rest = c("n"), c("n") - 1, c("n0") * c("v0") + c("n1") * c("v1")
    around = lambda k: c(f"n{k}") * (c(f"v{k}") + (c(f"m{k}") - c("m")) ** 2)
    whole = _gauss(n, n * c("v"), c("v"))
    both = {k: F.coalesce(c(f"{k}0"), F.lit(0.0)) + F.coalesce(c(f"{k}1"), F.lit(0.0)) for k in ("trend", "ar")}
    fits = {  # likelihoods and numbers of parameters without and with a break, observations
        "mean": (whole, 2, _gauss(n, rest, c("v")), 3, n),
        "variance": (whole, 2, _gauss(c("n0"), around("0"), c("v0")) + _gauss(c("n1"), around("1"), c("v1")), 3, n),
        "mean_variance": (whole, 2, _gauss(c("n0"), c("n0") * c("v0"), c("v0")) + _gauss(c("n1"), c("n1") * c("v1"), c("v1")), 4, n),
        "trend": (_gauss(n, c("trend"), c("trend") / n), 3, _gauss(n, both["trend"], both["trend"] / n), 5, n),
        "ar": (_gauss(pairs, c("ar"), c("ar") / pairs), 3, _gauss(pairs, both["ar"], both["ar"] / pairs), 5, pairs),
        "scale": (_laplace(n, c("l"), c("mad")), 2, _laplace(c("n0"), c("l0"), c("mad0")) + _laplace(c("n1"), c("l1"), c("mad1")), 4, n),
    }
    enough = (c("n0") >= LEAST) & (c("n1") >= LEAST)
    usable = {m: enough for m in MODELS} | {"ar": enough & (n >= LEAST_AR) & (c("n0") > LEAST)}
    a = g.where("n >= 2").select("series_id", *[x for m, (l0, k0, l1, k1, obs) in fits.items() for x in (usable[m].alias(f"ok_{m}"), _aic(l0, k0, obs).alias(f"none_{m}"), _aic(l1, k1, obs).alias(f"break_{m}"))])
    p = {m: F.when(c(f"ok_{m}"), _probability(c(f"none_{m}"), c(f"break_{m}"))).otherwise(0.0) for m in MODELS}
    lowest = {m: F.when(c(f"ok_{m}"), F.least(f"none_{m}", f"break_{m}")) for m in MODELS}
    a = a.select("series_id", *[p[m].alias(m) for m in MODELS], *[lowest[m].alias(f"aic_{m}") for m in MODELS], F.least(*lowest.values()).alias("best"))
    weight = {m: F.coalesce(F.exp((c("best") - c(f"aic_{m}")) / 2), F.lit(0.0)) for m in MODELS}
    total = sum(weight.values(), F.lit(0.0))
    mean = sum((c(m) for m in MODELS), F.lit(0.0)) / len(MODELS)
    weighted = F.coalesce(over(sum((weight[m] * c(m) for m in MODELS), F.lit(0.0)), total), F.lit(0.0))
    return a.select("series_id", *MODELS, F.greatest(*MODELS).alias("max"), mean.alias("average"), weighted.alias("weighted"))


def ladder(x: Column, steps: tuple[tuple[tuple[float, float], ...], float]) -> Column:
    """The evidence of the highest bound that x exceeds."""
    bounds, none = steps
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for bound, evidence in bounds:
        out = out.when(x > bound, evidence)
    return out.otherwise(none)


def _relative(a: Column, b: Column) -> Column:
    """|b - a| / (a + b), null where the sum is next to nothing."""
    return F.when(a + b > NARROW, F.abs(b - a) / (a + b + NARROW))


def _average(parts: list[Column]) -> Column:
    """Mean of the parts that are not null, 0 without any."""
    have = sum((F.when(p.isNotNull(), 1.0).otherwise(0.0) for p in parts), F.lit(0.0))
    return F.coalesce(over(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), have), F.lit(0.0))


def rolling_spreads(series: DataFrame, widths: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Adds s, the spread of the last min(5, n // 3) values of the period, where it has more than ten, and r, the difference."""
    v = F.col("value")
    n = F.count("*").over(within().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = series.withColumn("size", n).withColumn("r", v - F.lag(v).over(within()))
    s = F.lit(None).cast("double")
    for k in widths:
        run = within().rowsBetween(1 - k, 0)
        s = F.when((F.least(F.floor(F.col("size") / 3), F.lit(5)) == k) & (F.count(v).over(run) == k), F.stddev_pop(v).over(run)).otherwise(s)
    return rows.withColumn("s", F.when(F.col("size") > 10, s))


def evidence(series: DataFrame) -> DataFrame:
    """Ladders of evidence from quantiles, entropy, extremes, moments, time scales, and location and scale; their largest, mean and weighted sum.

    A period shorter than 15 % of the series or 10 values (15 for moments and entropy) gives no evidence, 0.  Entropy is that of ordinal
    patterns, as a share of the highest one, and approximate entropy, 0 where a period has none.
    """
    v, half = F.col("value"), F.lit(0.5)
    c = F.col
    rows = around_medians(rolling_spreads(series))
    mad = rows.groupBy("series_id").agg(F.percentile("d", half).alias("mad"))
    g = rows.join(mad, "series_id").groupBy("series_id").agg(
        F.count(v).cast("double").alias("n"), F.first("mad").alias("mad"),
        *[F.percentile(v, F.lit(q)).alias(f"all{k}") for k, q in ((10, 0.1), (50, 0.5), (90, 0.9))],
        *[x for p in (0, 1) for x in (
            F.count(side(v, p)).cast("double").alias(f"n{p}"), F.percentile(side(c("own"), p), half).alias(f"mad{p}"),
            *[F.percentile(side(v, p), F.lit(q)).alias(f"q{p}_{k}") for k, q in ((10, 0.1), (50, 0.5), (90, 0.9))],
            *[F.avg(side((c("d") > k / 2 * c("mad")).cast("double"), p)).alias(f"x{p}_{k}") for k in (4, 5, 6)],
            F.skewness(side(v, p)).alias(f"skew{p}"), F.kurtosis(side(v, p)).alias(f"kurt{p}"),
            F.stddev_pop(side(c("r"), p)).alias(f"r{p}"), F.stddev_pop(side(v, p)).alias(f"v{p}"), F.coalesce(F.stddev_pop(side(c("s"), p)), F.lit(0.0)).alias(f"s{p}"),
        )],
    )
    enough = lambda least: (c("n0") >= F.greatest(F.floor(c("n") * LEAST_SHARE), F.lit(least))) & (c("n1") >= F.greatest(F.floor(c("n") * LEAST_SHARE), F.lit(least)))
    moved = {k: F.when(F.abs(f"all{k}") > NARROW, F.abs(c(f"q1_{k}") - c(f"q0_{k}")) / F.abs(f"all{k}")) for k in (10, 50, 90)}
    kinds = {
        "quantiles": F.coalesce(ladder((moved[10] + moved[90]) / 2 / (moved[50] + NARROW), QUANTILE_LADDER), F.lit(0.0)),
        "extremes": F.when(c("mad") < NARROW, 0.0).otherwise(_average([ladder(_relative(c(f"x0_{k}"), c(f"x1_{k}")), EXTREME_LADDER) for k in (4, 5, 6)])),
        "moments": F.least(*[F.lit(MOST), sum((F.coalesce(ladder(F.abs(F.coalesce(c(f"{m}1"), F.lit(0.0)) - F.coalesce(c(f"{m}0"), F.lit(0.0))), steps), F.lit(0.0)) for m, steps in (("skew", SKEW_LADDER), ("kurt", KURT_LADDER))), F.lit(0.0))]),
        "timescales": _average([ladder(_relative(c(f"{k}0"), c(f"{k}1")), SPREAD_LADDER) for k in "rvs"]),
        "location_scale": F.when(c("mad") < NARROW, 0.0).otherwise(F.least(F.lit(MOST), ladder(F.abs(c("q1_50") - c("q0_50")) / c("mad"), LOCATION_LADDER) + F.coalesce(ladder(F.when(c("mad0") + c("mad1") > NARROW, F.abs(c("mad1") - c("mad0")) / (c("mad0") + c("mad1"))), SCALE_LADDER), F.lit(0.0)))),
    }
    # Entropies are compared as their own queries give them, rounded: a change on a bound then doesn't depend on the order of sums.
    patterns = permutation_entropy(series).select("series_id", (F.abs(F.round("entropy_diff", 6)) / math.log2(6)).alias("pattern_change"))
    none = F.lit(0.0)
    regular = approximate_entropy(series).select("series_id", F.abs(F.coalesce(F.round("apen_1", 5), none) - F.coalesce(F.round("apen_0", 5), none)).alias("regularity_change"))
    g = g.join(patterns, "series_id", "left").join(regular, "series_id", "left")
    kinds["entropy"] = F.least(F.lit(MOST), F.coalesce(ladder(c("pattern_change"), PERMUTATION_LADDER), none) + F.coalesce(ladder(c("regularity_change"), REGULARITY_LADDER), none))
    e = g.select("series_id", "n", *[F.when(enough(LEAST_MOMENTS if k in ("moments", "entropy") else LEAST), x).otherwise(0.0).alias(k) for k, x in kinds.items()])
    total = F.least(F.lit(MOST), sum((F.lit(w) * c(k) for k, w in WEIGHTS.items()), F.lit(0.0)))
    mean = sum((c(k) for k in kinds), none) / len(kinds)
    return e.select("series_id", *kinds, *[F.when(c("n") < 20, 0.05).otherwise(x).alias(k) for k, x in (("largest", F.greatest(*kinds)), ("average", mean), ("evidence", total))])
