"""Autoregressions of order one in each series, and the tests that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riftline.functions.moments import over

PARAMETERS = 2


def ordered() -> WindowSpec:
    """A series in order of time."""
    return Window.partitionBy("series_id").orderBy("t")


def lagged(series: DataFrame, within: bool) -> DataFrame:
    """Rows (x, y) of value on the one before; within: only where both are in one period."""
    w = Window.partitionBy("series_id", "period").orderBy("t") if within else ordered()
    return series.withColumn("x", F.lag("value").over(w)).where("x IS NOT NULL").withColumnRenamed("value", "y")


def _line(y: Column, x: Column, suffix: str) -> list[Column]:
    slope, syy = F.regr_slope(y, x), F.regr_syy(y, x)
    rss = F.when(F.regr_sxx(y, x) > 0, syy - slope * F.regr_sxy(y, x)).otherwise(syy)
    return [F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"n{suffix}"), slope.alias(f"slope{suffix}"), F.regr_intercept(y, x).alias(f"intercept{suffix}"), rss.alias(f"rss{suffix}")]


def fits(series: DataFrame) -> DataFrame:
    """n, slope, intercept and residual sum of squares of the fits before, after and over the whole series."""
    at = lambda p, c: F.when(F.col("period") == p, F.col(c))
    sides = lagged(series, True).groupBy("series_id").agg(*_line(at(0, "y"), at(0, "x"), "_0"), *_line(at(1, "y"), at(1, "x"), "_1"))
    return sides.join(lagged(series, False).groupBy("series_id").agg(*_line(F.col("y"), F.col("x"), "_full")), "series_id")


def chow(series: DataFrame) -> DataFrame:
    """Chow's F with its degrees of freedom, and the distance between the coefficients before and after."""
    f = fits(series)
    d2 = F.col("n_0") + F.col("n_1") - 2 * PARAMETERS
    split = F.col("rss_0") + F.col("rss_1")
    gain = F.col("rss_full") - split
    value = F.when((d2 > 0) & (gain > 0), over(gain / PARAMETERS, over(split, d2)))
    apart = F.sqrt((F.col("slope_0") - F.col("slope_1")) ** 2 + (F.col("intercept_0") - F.col("intercept_1")) ** 2)
    return f.select("*", value.alias("chow_f"), d2.cast("double").alias("df2"), apart.alias("coef_distance"))


def residuals(series: DataFrame) -> DataFrame:
    """e, its number i from 1, and the series' n, before (rows before the boundary among them), rss and sigma."""
    rows = lagged(series, False)
    g = rows.groupBy("series_id").agg(*_line(F.col("y"), F.col("x"), ""), F.count(F.when(F.col("period") == 0, 1)).alias("before"))
    e = F.col("y") - F.coalesce(F.col("intercept") + F.col("slope") * F.col("x"), F.lit(None).cast("double"))
    number = F.row_number().over(ordered())
    return rows.join(g, "series_id").select("series_id", "t", "period", e.alias("e"), number.alias("i"), "n", "before", "rss", F.sqrt(over(F.col("rss"), F.col("n") - PARAMETERS)).alias("sigma"))


def period_residuals(series: DataFrame) -> DataFrame:
    """Residuals of each period's own fit, in the form of a series, for the tests on distributions."""
    f = fits(series).select("series_id", *[f"{c}_{p}" for c in ("slope", "intercept") for p in (0, 1)])
    own = lambda c: F.when(F.col("period") == 0, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1"))
    return lagged(series, True).join(f, "series_id").select("series_id", "t", (F.col("y") - own("intercept") - own("slope") * F.col("x")).alias("value"), "period").where("value IS NOT NULL")


def cusum(series: DataFrame) -> DataFrame:
    """Sum and sum of squares of the residuals before the boundary, standardised."""
    r = residuals(series)
    g = r.groupBy("series_id").agg(F.first("n").alias("n"), F.first("before").alias("k"), F.first("rss").alias("rss"), F.first("sigma").alias("sigma"), F.sum(F.when(F.col("period") == 0, F.col("e"))).alias("s"), F.sum(F.when(F.col("period") == 0, F.col("e") ** 2)).alias("q"))
    u = over(F.col("k"), F.col("n"))
    inside = (F.col("k") >= 1) & (F.col("k") <= F.col("n") - 1)
    t = over(F.col("s"), F.col("sigma") * F.sqrt(F.col("n") * u * (1 - u)))
    z = over(over(F.col("q"), F.col("rss")) - u, F.sqrt(2 * u * (1 - u) / (F.col("n") + 2)))
    return g.select("series_id", "n", "k", F.when(inside, t).alias("cusum_t"), F.when(inside, z).alias("cusumsq_z"))


def cusum_scan(series: DataFrame) -> DataFrame:
    """The candidate in the first half after the boundary with the largest absolute CUSUM; ties to the earliest."""
    upto = ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = F.col("i") / F.col("n")
    r = residuals(series).withColumn("s", F.sum("e").over(upto)).where("i < n AND i >= before AND i <= before + floor((n - before) / 2)")
    scored = r.withColumn("t_k", over(F.col("s"), F.col("sigma") * F.sqrt(F.col("n") * u * (1 - u))))
    return scored.groupBy("series_id").agg(F.max_by(F.struct(F.col("i").cast("long").alias("k"), "t_k"), F.struct(F.abs("t_k"), -F.col("i"))).alias("b")).select("series_id", "b.k", F.col("b.t_k").alias("cusum_t"))


def jarque_bera(series: DataFrame) -> DataFrame:
    """Jarque-Bera statistic of the residuals, with population skewness and kurtosis; null up to ten residuals."""
    g = residuals(series).groupBy("series_id").agg(F.count("e").alias("n"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("excess"))
    return g.select("series_id", "n", *[F.when(F.col("n") > 10, x).alias(y) for x, y in ((F.col("skew"), "skew"), (F.col("excess"), "excess"), (F.col("n") / 6 * (F.col("skew") ** 2 + F.col("excess") ** 2 / 4), "jb"))])


def half_variance_ratio(series: DataFrame) -> DataFrame:
    """Variance of the second half of the residuals over that of the first; null up to twenty residuals."""
    half = F.floor(F.col("n") / 2)
    g = residuals(series).groupBy("series_id").agg(F.first("n").alias("n"), F.var_pop(F.when(F.col("i") <= half, F.col("e"))).alias("v0"), F.var_pop(F.when(F.col("i") > half, F.col("e"))).alias("v1"))
    return g.select("series_id", F.when(F.col("n") > 20, over(F.col("v1"), F.col("v0"))).alias("variance_ratio"))


def sup_f(series: DataFrame, trim: float = 0.15) -> DataFrame:
    """Largest Chow F over splits within the second period, ``trim`` of it left out at both ends."""
    rows = lagged(series, False)
    mean = rows.groupBy("series_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    r = rows.join(mean, "series_id").select("series_id", "t", "period", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    upto, whole = ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("series_id")
    products = {"c": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") ** 2, "xy": F.col("x") * F.col("y"), "yy": F.col("y") ** 2}
    r = r.select("series_id", "t", "period", *[F.sum(v).over(upto).alias(f"l_{k}") for k, v in products.items()], *[F.sum(v).over(whole).alias(f"a_{k}") for k, v in products.items()])
    r = r.withColumn("i", F.row_number().over(ordered())).withColumn("n1", F.sum("period").over(whole)).withColumn("before", F.col("a_c") - F.col("n1"))

    def rss(get) -> Column:
        n, x, y = get("c"), get("x"), get("y")
        sxx, sxy, syy = get("xx") - over(x * x, n), get("xy") - over(x * y, n), get("yy") - over(y * y, n)
        return syy - F.coalesce(F.when(sxx > 1e-12, over(sxy * sxy, sxx)), F.lit(0.0))

    left, all_ = rss(lambda k: F.col(f"l_{k}")), rss(lambda k: F.col(f"a_{k}"))
    right = rss(lambda k: F.col(f"a_{k}") - F.col(f"l_{k}"))
    d2 = F.col("a_c") - 2 * PARAMETERS
    scored = r.where((F.col("i") >= F.col("before") + F.floor(F.col("n1") * trim)) & (F.col("i") <= F.col("a_c") - F.floor(F.col("n1") * trim)) & (F.col("i") > 2) & (F.col("i") < F.col("a_c") - 2))
    scored = scored.select("series_id", "i", over((all_ - left - right) / PARAMETERS, over(left + right, d2)).alias("f"))
    return scored.groupBy("series_id").agg(F.max_by(F.struct(F.col("i").cast("long").alias("k"), "f"), F.struct("f", -F.col("i"))).alias("b")).select("series_id", "b.k", F.col("b.f").alias("sup_f"))
