"""Autoregressions on several lags and autocorrelations at many lags, as aggregated sums of products.

A regression on k lags needs the sums of the lag columns and of their products (its Gram matrix).  They are aggregated
once, for the whole series and for both periods together, and the normal equations are solved in column expressions,
one row a series; no series is gathered.  Values are centred on their series' mean first, which keeps the sums small, and
the regression is on the differences of successive lags and the last lag: neighbouring lags of a series that seldom moves
are almost the same column, and normal equations of them lose as many digits as they agree in.
A row's lags may reach over the boundary in the fit of the whole series, never in that of a period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.moments import over, side
from riftline.functions.special import chi2_p, f_p, normal_p
from riftline.operators.shape import autocorrelation, dot, ordered, within
from riftline.sources.checkpoints import cut

#: A pivot below this share of its diagonal entry counts as 0, and so does its coefficient.
SINGULAR = 1e-12
FITS = ("full", "0", "1")


def solved(rows: Column, k: int) -> Column:
    """Coefficients of k normal equations, rows of k numbers and the right side, by elimination along the diagonal."""

    def step(a: Column, p: Column) -> Column:
        row = F.get(a, p)
        inverse = F.when(F.get(row, p) > SINGULAR * F.get(F.get(rows, p), p), 1 / F.get(row, p)).otherwise(0.0)
        scaled = F.transform(F.array(inverse), lambda s: F.transform(row, lambda x: x * s))[0]
        return F.transform(F.array(scaled), lambda s: F.transform(a, lambda r, i: F.when(i == p, s).otherwise(F.zip_with(r, s, lambda x, y: x - F.get(r, p) * y))))[0]

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), rows, step), lambda r: F.get(r, k))


def with_lags(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Rows with mean, own (all lags lie in the row's period), and z0 .. zk: of the centred value and its values at the
    lags, each less the next, and the last as it is."""
    whole, most = Window.partitionBy("series_id"), max(lags)
    c = series.select("series_id", "t", "period", F.avg("value").over(whole).alias("mean"), (F.row_number().over(within()) > most).alias("own"), (F.col("value") - F.avg("value").over(whole)).alias("z0"))
    k, x = len(lags), lambda n: F.col(f"x{n}")
    c = c.withColumnRenamed("z0", "x0").select("*", *[F.lag("x0", j).over(ordered()).alias(f"x{n}") for n, j in enumerate(lags, 1)], F.lag("x0", most).over(ordered()).alias("last"))
    return c.where("last IS NOT NULL").select("series_id", "t", "period", "mean", "own", *[(x(n) - x(n + 1) if n < k else x(n)).alias(f"z{n}") for n in range(k + 1)])


def gram(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """One row a series: n, sums and sums of products of z0 .. zk for each fit."""
    k, z = len(lags), lambda j: F.col(f"z{j}")
    cut = {"full": F.lit(True), "0": F.col("own") & (F.col("period") == 0), "1": F.col("own") & (F.col("period") == 1)}
    sums = [F.first("mean").alias("mean")]
    for name, rows in cut.items():
        sums.append(F.count(F.when(rows, 1)).cast("double").alias(f"n_{name}"))
        sums += [F.sum(F.when(rows, z(j))).alias(f"s{j}_{name}") for j in range(k + 1)]
        sums += [F.sum(F.when(rows, z(i) * z(j))).alias(f"p{i}_{j}_{name}") for i in range(k + 1) for j in range(i, k + 1)]
    return with_lags(series, lags).groupBy("series_id").agg(*sums)


def fits(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """The sums of ``gram`` and, for each fit, slopes (of z1 .. zk), beta (of the lags), centre, intercept and rss; null where a fit has no rows.

    Where lags have no spread, beta is 0 and the intercept the mean.
    """
    k = len(lags)
    g = gram(series, lags)
    co = lambda i, j, f: F.col(f"p{min(i, j)}_{max(i, j)}_{f}") - over(F.col(f"s{i}_{f}") * F.col(f"s{j}_{f}"), F.col(f"n_{f}"))
    rows = lambda f: F.array(*[F.array(*[co(i, j, f) for j in (*range(1, k + 1), 0)]) for i in range(1, k + 1)])
    g = g.select("*", *[rows(f).alias(f"rows_{f}") for f in FITS])
    g = g.select("*", *[solved(F.col(f"rows_{f}"), k).alias(f"slopes_{f}") for f in FITS])
    sums = lambda f: F.array(*[F.col(f"s{j}_{f}") for j in range(1, k + 1)])
    centre = lambda f: over(F.col(f"s0_{f}") - dot(F.col(f"slopes_{f}"), sums(f)), F.col(f"n_{f}"))
    flat = lambda f: co(k, k, f) <= SINGULAR * F.col(f"p{k}_{k}_{f}")
    in_lags = lambda f: F.transform(f"slopes_{f}", lambda b, i: F.when(flat(f), 0.0).otherwise(b - F.when(i > 0, F.get(f"slopes_{f}", i - 1)).otherwise(-1.0)))
    right = lambda f: F.transform(f"rows_{f}", lambda r: F.get(r, k))
    out = g.select("*", *[x for f in FITS for x in (centre(f).alias(f"centre_{f}"), F.when(F.col(f"n_{f}") > 0, F.greatest(co(0, 0, f) - dot(F.col(f"slopes_{f}"), right(f)), F.lit(0.0))).alias(f"rss_{f}"))])
    at_rest = lambda f: F.col("mean") + over(F.col(f"s0_{f}") + F.col(f"s{k}_{f}") + sum((F.col(f"s{j}_{f}") for j in range(1, k)), F.lit(0.0)), F.col(f"n_{f}"))
    return out.select("*", *[x for f in FITS for x in (in_lags(f).alias(f"beta_{f}"), F.when(flat(f), at_rest(f)).otherwise(F.col(f"centre_{f}") - F.col("mean") * F.get(f"slopes_{f}", k - 1)).alias(f"intercept_{f}"))])


def first_lags(k: int) -> tuple[int, ...]:
    return tuple(range(1, k + 1))


def chow(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Chow's F with its p-value, sums of squares and the distance between the coefficients of the two periods.

    F is infinite where both periods are fitted without a rest, and null where a period has no rows.
    """
    f, m = fits(series, lags), len(lags) + 1
    d2, split = F.col("n_0") + F.col("n_1") - 2 * m, F.col("rss_0") + F.col("rss_1")
    gain = F.col("rss_full") - split
    value = F.when((d2 > 0) & (gain > 0), F.when(split == 0, F.lit(float("inf"))).otherwise(over(gain / m, over(split, d2))))
    apart = F.sqrt(F.aggregate(F.zip_with("beta_0", "beta_1", lambda a, b: (a - b) ** 2), (F.col("intercept_0") - F.col("intercept_1")) ** 2, lambda s, x: s + x))
    f = f.select("series_id", *[F.col(f"n_{x}").cast("long").alias(f"n_{x}") for x in FITS], *[f"rss_{x}" for x in FITS], value.alias("chow_f"), d2.alias("df2"), apart.alias("coef_distance"))
    return f.withColumn("chow_p", F.when(F.col("chow_f") == float("inf"), 0.0).otherwise(f_p("chow_f", F.lit(float(m)), "df2")))


def cusum(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """CUSUM and CUSUM of squares before the boundary with p-values, their -log10, and flags at 5 %.

    Residuals before the boundary are those of the whole fit in the rows of the first period's own fit, so their sum and sum of squares
    follow from that period's sums.
    """
    k, m = len(lags), len(lags) + 1
    f = fits(series, lags)
    beta = lambda j: F.get("slopes_full", j - 1)
    p = lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}_0")
    c, n0 = F.col("centre_full"), F.col("n_0")
    total = F.col("s0_0") - n0 * c - sum((beta(j) * F.col(f"s{j}_0") for j in range(1, k + 1)), F.lit(0.0))
    squares = p(0, 0) + n0 * c * c - 2 * c * F.col("s0_0")
    for i in range(1, k + 1):
        squares = squares - 2 * beta(i) * (p(0, i) - c * F.col(f"s{i}_0"))
        for j in range(1, k + 1):
            squares = squares + beta(i) * beta(j) * p(i, j)
    n = F.col("n_full")
    f = f.select("series_id", n.alias("n"), n0.alias("k"), F.col("rss_full").alias("rss"), total.alias("s"), squares.alias("q"), F.sqrt(F.when(n > m, over(F.col("rss_full"), n - m))).alias("sigma"))
    u = over(F.col("k"), F.col("n"))
    inside = (F.col("k") >= 1) & (F.col("k") <= F.col("n") - 1) & (F.col("n") > m)
    t = over(F.col("s"), F.col("sigma") * F.sqrt(F.col("n") * u * (1 - u)))
    z = over(over(F.col("q"), F.col("rss")) - u, F.sqrt(2 * u * (1 - u) / (F.col("n") + 2)))
    f = f.select("series_id", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "sigma", F.when(inside, t).alias("cusum_t"), F.when(inside, z).alias("cusumsq_z"))
    f = f.select("*", normal_p("cusum_t").alias("cusum_p"), normal_p("cusumsq_z").alias("cusumsq_p"))
    return f.select("*", *[x for s in ("cusum", "cusumsq") for x in (F.when(F.col(f"{s}_p") > 0, -F.log10(f"{s}_p")).alias(f"{s}_log_p"), (F.col(f"{s}_p") < 0.05).cast("long").alias(f"{s}_significant"))])


def by_lags(series: DataFrame, operator, sizes: tuple[int, ...]) -> DataFrame:
    """The operator with 1 .. k lags for each k of ``sizes``, with a column lags."""
    out = None
    for k in sizes:
        one = operator(series, first_lags(k)).withColumn("lags", F.lit(k).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def residuals(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """e of the whole fit, its number i from 1, and n."""
    f = fits(series, lags).select("series_id", F.col("n_full").alias("n"), "centre_full", "slopes_full")
    z = F.array(*[F.col(f"z{j}") for j in range(1, len(lags) + 1)])
    return with_lags(series, lags).join(f, "series_id").select("series_id", "t", "period", (F.col("z0") - F.col("centre_full") - dot(F.col("slopes_full"), z)).alias("e"), F.row_number().over(ordered()).alias("i"), "n")


def period_residuals(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Residuals of each period's own fit, in the form of a series, for the tests on distributions.

    What the normal equations leave is fitted once more and taken off: their rounding would otherwise give the residuals of a period with as
    many rows as coefficients, which are all 0, an order.
    """
    k = len(lags)
    f = fits(series, lags).select("series_id", *[f"{c}_{p}" for c in ("centre", "slopes", "rows") for p in (0, 1)])
    z = F.array(*[F.col(f"z{j}") for j in range(1, k + 1)])
    own = lambda c: F.when(F.col("period") == 0, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1"))
    rows = with_lags(series, lags).where("own").join(f, "series_id")
    e = rows.select("series_id", "t", "period", z.alias("z"), own("rows").alias("rows"), (F.col("z0") - own("centre") - dot(own("slopes"), z)).alias("e")).where("e IS NOT NULL")
    x = lambda j: F.get("z", j)
    g = e.groupBy("series_id", "period").agg(F.first("rows").alias("rows"), F.avg("e").alias("e"), F.array(*[F.avg(x(j)) for j in range(k)]).alias("z"), F.array(*[F.sum(F.col("e") * x(j)) for j in range(k)]).alias("p"), F.sum("e").alias("s"))
    right = F.zip_with("p", "z", lambda p, m: p - m * F.col("s"))
    g = g.select("series_id", "period", F.col("e").alias("mean"), F.col("z").alias("means"), solved(F.zip_with("rows", right, lambda r, b: F.concat(F.slice(r, 1, k), F.array(b))), k).alias("slopes"))
    g = g.select("series_id", "period", "slopes", (F.col("mean") - dot(F.col("slopes"), F.col("means"))).alias("centre"))
    return e.join(g, ["series_id", "period"]).select("series_id", "t", (F.col("e") - F.col("centre") - dot(F.col("slopes"), F.col("z"))).alias("value"), "period")


def diagnostics(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Of the residuals: Jarque-Bera, skewness and kurtosis with flags, Ljung-Box of up to five lags, variance of the second half over the first.

    Null up to ten residuals, the variance ratio up to twenty.
    """
    e = residuals(series, lags)
    half = F.floor(F.col("n") / 2)
    g = e.groupBy("series_id").agg(
        F.count("e").cast("double").alias("n"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("excess"), F.var_pop(F.when(F.col("i") <= half, F.col("e"))).alias("v0"), F.var_pop(F.when(F.col("i") > half, F.col("e"))).alias("v1")
    )
    a = autocorrelation(e.select("series_id", "t", F.col("e").alias("value"), F.lit(0).alias("period")), 5)
    n = F.col("n")
    lb = a.where(F.col("lag") <= F.floor(n / 4)).groupBy("series_id").agg(F.sum(n * (n + 2) * over(F.col("acf") ** 2, n - F.col("lag"))).alias("ljung_box"), F.max("lag").cast("double").alias("tested"))
    g = g.join(lb, "series_id", "left").where("n > 10")
    ratio = F.when((n > 20) & (F.col("v0") > 0) & (F.col("v1") > 0), over(F.col("v1"), F.col("v0")))
    g = g.select("series_id", F.col("n").cast("long").alias("n"), "skew", "excess", (n / 6 * (F.col("skew") ** 2 + F.col("excess") ** 2 / 4)).alias("jb"), "ljung_box", "tested", ratio.alias("variance_ratio"), F.floor(n / 2).cast("double").alias("half"))
    upper = f_p("variance_ratio", n - F.col("half") - 1, F.col("half") - 1)
    g = g.select("*", chi2_p("jb", F.lit(2.0)).alias("jb_p"), chi2_p("ljung_box", "tested").alias("ljung_box_p"), upper.alias("upper"))
    g = g.withColumn("variance_ratio_p", 2 * F.least("upper", 1 - F.col("upper")))
    flags = {"normal": F.col("jb_p") > 0.05, "heavy_tails": F.col("excess") > 3, "skewed": F.abs("skew") > 1, "serial": F.col("ljung_box_p") < 0.05, "uneven": F.col("variance_ratio_p") < 0.05}
    return g.drop("tested", "half", "upper").select("*", *[x.cast("long").alias(c) for c, x in flags.items()])


# --- autocorrelation ----------------------------------------------------------------------------------------------
def partial(series: DataFrame, lags: int, adjusted: bool = True) -> DataFrame:
    """Partial autocorrelations of each period by the Durbin-Levinson recursion, a fold over its autocorrelations.

    adjusted: products are divided by their number instead of n.  One row per series, period and lag below half the
    period's length, beyond which the estimates are mostly noise; null from where the recursion breaks down.
    """
    a = autocorrelation(series, lags).where(F.col("lag") < F.floor(F.col("n") / 2)).withColumn("r", F.col("acf") * F.col("n") / (F.col("n") - F.col("lag")) if adjusted else F.col("acf"))
    g = a.groupBy("series_id", "period").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("lag", "r"))).getField("r").alias("r"))
    r = F.col("r")

    def step(s: Column, k: Column) -> Column:
        past = F.slice(r, F.lit(1), k - 1)
        new = over(F.get(r, k - 1) - dot(s["phi"], F.reverse(past)), 1 - dot(s["phi"], past))
        return F.transform(F.array(new), lambda x: F.struct(F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - x * b), F.array(x)).alias("phi"), F.concat(s["out"], F.array(x)).alias("out")))[0]

    none = F.array().cast("array<double>")
    folded = F.aggregate(F.sequence(F.lit(1), F.size(r)), F.struct(none.alias("phi"), none.alias("out")), step)
    return g.select("series_id", "period", "n", F.posexplode(folded["out"]).alias("lag", "pacf")).select("series_id", "period", (F.col("lag") + 1).cast("long").alias("lag"), "n", "pacf")


def lag_profile(lagged: DataFrame, column: str) -> DataFrame:
    """Over series, by period and lag: mean, deviation and range of a coefficient, and the share beyond the white-noise band."""
    x = F.col(column)
    return lagged.groupBy(F.col("period").cast("long").alias("period"), "lag").agg(F.count(x).alias("series"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg((F.abs(x) > 1.96 / F.sqrt("n")).cast("double")).alias("significant"))


def whole_series(series: DataFrame) -> DataFrame:
    """The series as one period."""
    return series.withColumn("period", F.lit(0))


def partial_summary(series: DataFrame, lags: int) -> DataFrame:
    """By period: partial autocorrelations beyond the white-noise band, their absolute sum, and the distance between the periods."""
    p = partial(series, lags)
    g = p.groupBy("series_id", "lag").agg(*[F.sum(side(F.col("pacf"), k)).alias(f"p{k}") for k in (0, 1)], *[F.max(side(F.col("n"), k)).alias(f"n{k}") for k in (0, 1)])
    d = F.coalesce("p1", F.lit(0.0)) - F.coalesce("p0", F.lit(0.0))
    beyond = lambda k: F.count(F.when(F.abs(f"p{k}") > 1.96 / F.sqrt(f"n{k}"), 1))
    return g.groupBy("series_id").agg(*[x for k in (0, 1) for x in (beyond(k).alias(f"significant_{k}"), F.sum(F.abs(f"p{k}")).alias(f"abs_sum_{k}"))], F.sqrt(F.sum(d**2)).alias("l2"), F.sum(F.abs(d)).alias("l1"))


def adaptive_lags(series: DataFrame, most: int = 15) -> DataFrame:
    """How many lags a series' own regressions should have: its partial autocorrelations beyond the band, from 1 to ``most``.

    Only up to half its length counts; a series shorter than 2 * most has up to three lags, a quarter of its length.
    """
    n = F.col("n")
    p = partial(whole_series(series), most, adjusted=False)
    g = p.where(F.col("lag") <= F.floor(n / 2) - 1).groupBy("series_id").agg(F.first("n").alias("n"), F.count(F.when(F.abs("pacf") > 1.959964 / F.sqrt(n), 1)).alias("k"))
    return g.select("series_id", F.when(n >= 2 * most, F.greatest(F.least("k", F.lit(most)), F.lit(1))).otherwise(F.greatest(F.least(F.floor(n / 4), F.lit(3)), F.lit(1))).cast("long").alias("lags"))


def adaptive(series: DataFrame, operator, most: int = 15) -> DataFrame:
    """The operator with as many lags as each series calls for; series are dealt by that number, of which there are ``most``."""
    dealt = cut(series.join(adaptive_lags(series, most), "series_id"))
    out = None
    for k in sorted(r["lags"] for r in dealt.select("lags").distinct().collect()):
        one = operator(dealt.where(F.col("lags") == k).drop("lags"), first_lags(k)).withColumn("lags", F.lit(k).cast("long"))
        out = one if out is None else out.unionByName(one)
    return operator(dealt.drop("lags"), (1,)).withColumn("lags", F.lit(1).cast("long")) if out is None else out
