"""Profiles over many series by lag, tests of whole tables, and further measures around the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.moments import over, side
from riftline.functions.special import student_p
from riftline.operators import datasets, regression, shape
from riftline.operators.ranges import with_quantiles

# 95 % points of chi-squared with 1 to 10 degrees of freedom.
CHI2_95 = (3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.067140, 15.507313, 16.918978, 18.307038)


def lag_profile(series: DataFrame, lags: int = 10) -> DataFrame:
    """Mean, deviation and range over series of the autocorrelation at each lag, and the share beyond the white-noise band."""
    a = shape.autocorrelation(series, lags)
    return a.groupBy(F.col("period").cast("long").alias("period"), "lag").agg(F.count("acf").alias("series"), F.avg("acf").alias("mean"), F.stddev_pop("acf").alias("std"), F.min("acf").alias("low"), F.max("acf").alias("high"), F.avg((F.abs("acf") > 1.96 / F.sqrt("n")).cast("double")).alias("significant"))


def ljung_box_profile(series: DataFrame) -> DataFrame:
    """Mean Ljung-Box statistic over series up to each of ten lags, and the share of series where it passes its 95 % point."""
    a = shape.autocorrelation(series, len(CHI2_95))
    term = F.col("n") * (F.col("n") + 2) * over(F.col("acf") ** 2, F.col("n") - F.col("lag"))
    upto = Window.partitionBy("series_id", "period").orderBy("lag")
    q = a.select("series_id", "period", "lag", F.sum(term).over(upto).alias("q"))
    limit = F.element_at(F.array(*map(F.lit, CHI2_95)), F.col("lag").cast("int"))
    return q.groupBy(F.col("period").cast("long").alias("period"), "lag").agg(F.count("q").alias("series"), F.avg("q").alias("mean"), F.avg((F.col("q") > limit).cast("double")).alias("significant"))


def lag_columns(series: DataFrame, lags: int = 20) -> DataFrame:
    """Autocorrelations of the whole series at lags 1, 2, 5 and 10, sums over ten lags, and the lag before their sign first changes."""
    whole = series.withColumn("period", F.lit(0))
    a = shape.autocorrelation(whole, lags).where(F.col("n") >= 2 * lags)
    turn = F.lead("acf").over(Window.partitionBy("series_id").orderBy("lag"))
    a = a.withColumn("turns", F.signum(turn) != F.signum("acf"))
    ten = F.when(F.col("lag") <= 10, F.col("acf"))
    return a.groupBy("series_id").agg(*[F.max(F.when(F.col("lag") == k, F.col("acf"))).alias(f"acf_{k}") for k in (1, 2, 5, 10)], F.sum(F.abs(ten)).alias("abs_sum"), F.avg(ten).alias("mean"), F.stddev_pop(ten).alias("std"), F.coalesce(F.min(F.when(F.col("turns"), F.col("lag"))), F.lit(lags).cast("long")).alias("first_zero"))


def partial_lag_relation(series: DataFrame) -> DataFrame:
    """Across series, by period: line and correlation of the second partial autocorrelation on the first (adjusted by length)."""
    a = shape.autocorrelation(series, 2).withColumn("r", F.col("acf") * over(F.col("n"), F.col("n") - F.col("lag")))
    p = a.groupBy("series_id", "period").agg(*[F.max(F.when(F.col("lag") == k, F.col("r"))).alias(f"r{k}") for k in (1, 2)])
    p = p.select("period", F.col("r1").alias("p1"), over(F.col("r2") - F.col("r1") ** 2, 1 - F.col("r1") ** 2).alias("p2")).where("abs(p1) < 1 AND p2 IS NOT NULL")
    return p.groupBy(F.col("period").cast("long").alias("period")).agg(F.count("*").alias("series"), F.avg("p1").alias("mean_1"), F.avg("p2").alias("mean_2"), F.regr_slope("p2", "p1").alias("slope"), F.regr_intercept("p2", "p1").alias("intercept"), F.corr("p1", "p2").alias("correlation"))


def decay_comparison(series: DataFrame) -> DataFrame:
    """Mann-Whitney U of the decay lag, series with a break against the others; the window has a row for each distinct lag."""
    decay = shape.autocorrelation_summary(series.withColumn("period", F.lit(0))).select("series_id", "decay_lag")
    by = decay.join(datasets.labels_of(series), "series_id").groupBy("decay_lag").agg(F.count(F.when(F.col("has_break"), 1)).alias("p"), F.count(F.when(~F.col("has_break"), 1)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("decay_lag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = by.select("p", "q", (F.col("p") * (below + F.col("q") / 2)).alias("u"))
    return u.agg(F.sum("p").alias("breaks"), F.sum("q").alias("others"), F.sum("u").alias("u"))


def described(series: DataFrame) -> DataFrame:
    """Count, mean, spread, range, quartiles and 5 % tails of each period."""
    v = F.col("value")
    quantile = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    rows = series.select(F.col("period").cast("long").alias("period"), "value")
    out = rows.groupBy("period").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    return with_quantiles(out, rows, {k: ("value", q) for k, q in quantile.items()}, "period")


def length_counts(series: DataFrame) -> DataFrame:
    """How many series have each length, and whether it is the most frequent one (the smallest of those)."""
    counts = series.groupBy("series_id").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n"))
    mode = counts.agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("mode"))
    return counts.join(F.broadcast(mode)).select("length", "n", (F.col("length") == F.col("mode")).alias("mode"))


def normality(series: DataFrame) -> DataFrame:
    """D'Agostino and Pearson's K squared of all values by period, from twenty values on; its p with two degrees of freedom is closed."""
    v = F.col("value")
    g = series.groupBy(F.col("period").cast("long").alias("period")).agg(F.count(v).cast("double").alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    y = y / F.sqrt(2 / (w2 - 1))
    skew = F.log(y + F.sqrt(y * y + 1)) / F.sqrt(F.log(w2) / 2)
    x = (F.col("g2") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / root**2))
    ratio = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    kurt = (1 - 2 / (9 * a) - F.signum(ratio) * F.pow(F.abs(ratio), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = skew**2 + kurt**2
    return g.where("n >= 20").select("period", n.cast("long").alias("n"), skew.alias("skew_z"), kurt.alias("kurt_z"), k2.alias("k2"), F.exp(-k2 / 2).alias("p"))


def residual_normality(series: DataFrame) -> DataFrame:
    """By class: series with more than twenty residuals, the share whose Jarque-Bera p passes 0.05, and the mean p."""
    jb = regression.jarque_bera(series).where("n > 20 AND jb IS NOT NULL").select("series_id", F.exp(-F.col("jb") / 2).alias("p"))
    return jb.join(datasets.labels_of(series), "series_id").groupBy(F.col("has_break").cast("long").alias("has_break")).agg(F.count("*").alias("series"), F.avg((F.col("p") > 0.05).cast("double")).alias("normal"), F.avg("p").alias("mean_p"))


def cusum_path_at_boundary(series: DataFrame) -> DataFrame:
    """Value of the standardised residuals' running sum, and of their squares' share, at the first residual after the boundary."""
    first = F.min(F.when(F.col("period") == 1, F.col("t"))).over(Window.partitionBy("series_id"))
    r = regression.residuals(series).withColumn("first", first).where("t <= first")
    return r.groupBy("series_id").agg(over(F.sum("e"), F.sqrt(over(F.first("rss"), F.first("n") - 1))).alias("path"), over(F.sum(F.col("e") ** 2), F.first("rss")).alias("squares"))


def accepted_split(series: DataFrame, share: float = 0.3) -> DataFrame:
    """The best single split where it lies in the first ``share`` of the second period, else null."""
    b = series.groupBy("series_id").agg(F.min(F.when(F.col("period") == 1, F.col("t"))).alias("b"), F.count(F.when(F.col("period") == 1, 1)).alias("n1"))
    k = F.col("k")
    return shape.binary_segmentation(series).join(b, "series_id").select("series_id", F.when((k >= F.col("b")) & (k < F.col("b") + F.floor(F.col("n1") * share)), k).alias("k"))


def gradualness(series: DataFrame) -> DataFrame:
    """Absolute slope of the values within min(10, n0 / 4, n1 / 4) of the boundary, where that is at least three."""
    g = series.groupBy("series_id").agg(F.count(F.when(F.col("period") == 0, 1)).alias("n0"), F.count(F.when(F.col("period") == 1, 1)).alias("n1"))
    g = g.select("series_id", "n0", F.least(F.lit(10).cast("long"), F.floor(F.col("n0") / 4), F.floor(F.col("n1") / 4)).alias("w")).where("w >= 3")
    near = series.join(g, "series_id").where("t >= n0 - w AND t < n0 + w")
    return near.groupBy("series_id").agg(F.abs(F.regr_slope("value", F.col("t").cast("double"))).alias("slope"))


def block_effects(series: DataFrame, sizes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Student's t and effect size of the spreads of tumbling blocks before and after the boundary, for each block size.

    Blocks run over the whole series; the one that holds the boundary counts as after it.  Sizes that leave fewer than
    three blocks on a side, or that exceed a quarter of the series, have no row.
    """
    whole = Window.partitionBy("series_id")
    rows = series.select("series_id", "t", "value", F.count("*").over(whole).alias("n"), F.count(F.when(F.col("period") == 0, 1)).over(whole).alias("n0"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where("n >= size * 4")  # in a step of its own: a window would count the copies
    block = F.floor(F.col("t") / F.col("size"))
    b = rows.groupBy("series_id", F.col("size").cast("long").alias("size"), block.alias("block")).agg(F.stddev_pop("value").alias("s"), F.count("*").alias("k"), F.first("n0").alias("n0")).where("k = size")
    part = {p: F.when((F.col("block") >= F.floor(F.col("n0") / F.col("size"))) == bool(p), F.col("s")) for p in (0, 1)}
    g = b.groupBy("series_id", "size").agg(*[x for p in (0, 1) for x in (F.count(part[p]).alias(f"k{p}"), F.avg(part[p]).alias(f"m{p}"), F.var_pop(part[p]).alias(f"v{p}"))])
    k0, k1, df = F.col("k0"), F.col("k1"), F.col("k0") + F.col("k1") - 2
    pooled = over(k0 * F.col("v0") + k1 * F.col("v1"), df)
    t = over(F.col("m0") - F.col("m1"), F.sqrt(pooled * (1 / k0 + 1 / k1)))
    return g.where("k0 > 2 AND k1 > 2").select("series_id", "size", df.alias("df"), t.alias("t"), over(F.abs(F.col("m1") - F.col("m0")), F.sqrt((F.col("v0") + F.col("v1")) / 2)).alias("effect"))


def dominant_block(effects: DataFrame, limit: float = 2.0) -> DataFrame:
    """Share of block sizes whose |t| passes ``limit``, and the size among those with the largest effect (ties: smallest)."""
    hit = F.abs("t") > limit
    return effects.groupBy("series_id").agg(F.avg(F.coalesce(hit.cast("double"), F.lit(0.0))).alias("consistency"), F.max_by(F.when(hit, F.col("size")), F.when(hit, F.struct("effect", -F.col("size")))).alias("dominant_size"))


def rolling_spread_boundary(series: DataFrame) -> DataFrame:
    """Means of the centred rolling spread over a quarter of the series on both sides of the boundary.

    As for the rolling mean, frames are differences of running sums (of centred values and their squares) joined by position.
    """
    whole, upto = Window.partitionBy("series_id"), shape.ordered().rowsBetween(Window.unboundedPreceding, 0)
    c = series.select("series_id", "t", (F.col("value") - F.avg("value").over(whole)).alias("x"), F.count("*").over(whole).alias("n"), F.coalesce(F.min(F.when(F.col("period") == 1, F.col("t"))).over(whole), F.count("*").over(whole)).alias("b"))
    c = c.withColumn("w", F.floor(F.col("n") / 4)).where("w >= 3").withColumn("s", F.sum("x").over(upto)).withColumn("q", F.sum(F.col("x") ** 2).over(upto))
    run = c.select("series_id", "t", "s", "q")
    near = c.where("t >= b - w AND t < b + w").select("series_id", F.col("t").alias("at"), "b", "w")
    high = near.withColumn("t", F.col("at") + F.floor((F.col("w") - 1) / 2)).join(run, ["series_id", "t"]).select("series_id", "at", "b", "w", F.col("s").alias("s1"), F.col("q").alias("q1"))
    both = high.withColumn("t", F.col("at") - F.floor(F.col("w") / 2) - 1).join(run, ["series_id", "t"], "left").where("s IS NOT NULL OR t = -1")
    s, q = F.col("s1") - F.coalesce("s", F.lit(0.0)), F.col("q1") - F.coalesce("q", F.lit(0.0))
    spread = F.sqrt(F.greatest(q - s * s / F.col("w"), F.lit(0.0)) / (F.col("w") - 1))
    g = both.select("series_id", (F.col("at") >= F.col("b")).cast("int").alias("period"), spread.alias("d")).groupBy("series_id").agg(F.avg(side(F.col("d"), 0)).alias("std_before"), F.avg(side(F.col("d"), 1)).alias("std_after"))
    return g.select("*", (F.col("std_after") - F.col("std_before")).alias("std_change"), (F.col("std_after") / (F.col("std_before") + 1e-8)).alias("std_ratio"))


def summary(series: DataFrame) -> DataFrame:
    """One row of 26 figures that describe a data set: sizes, lengths, values, and the changes at the boundary with and without a break."""
    v, p = F.col("value"), lambda k: side(F.col("value"), k)
    per = series.groupBy("series_id").agg(
        F.coalesce(F.max("has_break"), F.lit(False)).alias("b"), F.count(v).cast("double").alias("length"), F.count(p(0)).cast("double").alias("before"), F.count(p(1)).cast("double").alias("after"),
        F.avg(v).alias("series_mean"), F.stddev_samp(v).alias("series_std"), (F.avg(p(1)) - F.avg(p(0))).alias("dm"), (F.stddev_samp(p(1)) - F.stddev_samp(p(0))).alias("ds"),
    ).withColumn("ratio", over(F.col("before"), F.col("after")))
    both = lambda name, x: (F.avg(x).alias(f"{name}_mean"), F.stddev_samp(x).alias(f"{name}_std"))
    own = lambda c, hit: F.when(F.col("b") == hit, F.col(c))
    out = per.agg(
        F.count("*").alias("series"), F.avg(F.col("b").cast("double")).alias("break_ratio"), *both("length", F.col("length")), F.min("length").alias("length_min"), F.max("length").alias("length_max"),
        *[x for c in ("before", "after", "ratio", "series_mean", "series_std") for x in both(c, F.col(c))],
        *[x for c in ("dm", "ds") for n, hit in (("break", True), ("other", False)) for x in both(f"{n}_{c}", own(c, hit))],
    )
    return out.join(F.broadcast(series.agg(*both("value", v))))  # one row each


def class_t_tests(series: DataFrame) -> DataFrame:
    """Welch's t, degrees of freedom and p of the change of mean and of spread, series with a break against the others."""
    v = F.col("value")
    per = series.groupBy("series_id").agg(F.coalesce(F.max("has_break"), F.lit(False)).cast("int").alias("b"), (F.avg(side(v, 1)) - F.avg(side(v, 0))).alias("dm"), (F.stddev_samp(side(v, 1)) - F.stddev_samp(side(v, 0))).alias("ds"))
    rows = per.select("b", F.explode(F.array(*[F.struct(F.lit(c).alias("change"), F.col(c).alias("x")) for c in ("dm", "ds")])).alias("r")).select("b", "r.*")
    of = lambda k: F.when(F.col("b") == k, F.col("x"))
    g = rows.groupBy("change").agg(*[x for k in (0, 1) for x in (F.count(of(k)).cast("double").alias(f"n{k}"), F.avg(of(k)).alias(f"m{k}"), F.var_samp(of(k)).alias(f"v{k}"))])
    a, b = over(F.col("v0"), F.col("n0")), over(F.col("v1"), F.col("n1"))
    df = over((a + b) ** 2, over(a**2, F.col("n0") - 1) + over(b**2, F.col("n1") - 1))
    return g.select("change", over(F.col("m1") - F.col("m0"), F.sqrt(a + b)).alias("t"), df.alias("df")).withColumn("p", student_p("t", "df"))
