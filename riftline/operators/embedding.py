"""Measures on embedded series: approximate entropy, principal factors, scans over candidate breaks, band energies.

Embeddings aren't built.  Products of their columns are sums over lags less a few terms at a period's ends; counts of
near templates come from a join on a grid; spectra are averages over segments of fixed length.  So a series may be of any
length, and what reaches Python (eigenvectors) is a few numbers of a series or of a window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.moments import over, side
from riftline.operators.lagged import dot, first_lags, fits, solved, with_lags
from riftline.operators.shape import lag_sums, ordered, within


# --- approximate entropy --------------------------------------------------------------------------------------------
def approximate_entropy(series: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Mean log share of near templates of two values less that of three, by period.

    Templates are near if no value differs by more than ``tolerance`` deviations.  A cell of a grid of that width has only
    templates of its own and the neighbouring cells near, so only those meet.  Null without spread and up to four values.
    """
    each = Window.partitionBy("series_id", "period")
    x = series.select("series_id", "period", F.row_number().over(within()).alias("i"), F.col("value").alias("a"), F.lead("value").over(within()).alias("b"), F.lead("value", 2).over(within()).alias("c"), (F.stddev_pop("value").over(each) * tolerance).alias("r"), F.count("*").over(each).alias("n"))
    x = x.where("b IS NOT NULL AND r > 0 AND n > 4").withColumn("p", F.floor(F.col("a") / F.col("r"))).withColumn("q", F.floor(F.col("b") / F.col("r")))
    near = lambda c: F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)]))
    left = x.withColumn("p", near("p")).withColumn("q", near("q"))
    right = x.select("series_id", "period", "p", "q", *[F.col(c).alias(f"{c}_") for c in "abc"])
    pairs = left.join(right, ["series_id", "period", "p", "q"]).where((F.abs(F.col("a") - F.col("a_")) <= F.col("r")) & (F.abs(F.col("b") - F.col("b_")) <= F.col("r")))
    third = F.abs(F.col("c") - F.col("c_")) <= F.col("r")
    counted = pairs.groupBy("series_id", "period", "i", "n").agg(F.count("*").alias("k2"), F.count(F.when(third, 1)).alias("k3"))
    share = lambda k, n: F.avg(F.when(F.col(k) > 0, F.log(F.col(k) / n)))
    e = counted.groupBy("series_id", "period").agg((share("k2", F.col("n") - 1) - share("k3", F.col("n") - 2)).alias("e"))
    both = e.groupBy("series_id").agg(*[F.max(side(F.col("e"), p)).alias(f"apen_{p}") for p in (0, 1)])
    return series.select("series_id").distinct().join(both, "series_id", "left").select("*", (F.col("apen_1") - F.col("apen_0")).alias("apen_diff"))


# --- factors ----------------------------------------------------------------------------------------------------------
FACTORS, SIZES, LEAST_WINDOWS = 3, (10, 15, 20), 20
_SHARES = [f"share{k + 1}_{p}" for p in (0, 1) for k in range(FACTORS)]
_NEEDED = [f"needed{share}_{p}_{m}" for m in SIZES for share in (90, 95) for p in (0, 1)]
FACTOR_COLUMNS = [*_SHARES, "share_l1", "procrustes", "angle_max", "angle_mean", *_NEEDED]


def correlation_matrix(n: int | np.ndarray, products: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Correlations of the columns of an embedding of centred values, of one period or (with a leading dimension) of many at once.

    products: sums over the whole period of values times values 0, 1, ... later; first, last: values at its ends, ``size`` or more.
    """
    w = np.asarray(n - size + 1)[..., None, None]
    head, tail = first[..., : size - 1], last[..., : -size : -1]  # the values before the last column, and from the end those after the first
    zero = np.zeros((*head.shape[:-1], 1))

    def run(x: np.ndarray) -> np.ndarray:
        """By distance d and k: the sum of the first k products of values d apart."""
        later = np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros((*x.shape[:-1], size))], -1), size - 1, axis=-1)[..., :size, :]
        return np.concatenate([np.zeros((*x.shape[:-1], size, 1)), np.cumsum(x[..., None, :] * later, -1)], -1)

    i, j = np.indices((size, size))
    d, low, high = np.abs(i - j), np.minimum(i, j), np.maximum(i, j)
    out = products[..., d] - run(head)[..., d, low] - run(tail)[..., d, size - 1 - high]
    sums = -np.concatenate([zero, np.cumsum(head, -1)], -1) - np.concatenate([np.cumsum(tail, -1)[..., ::-1], zero], -1)
    out = out / w - sums[..., :, None] * sums[..., None, :] / w**2
    s = np.sqrt(np.maximum(np.diagonal(out, axis1=-2, axis2=-1), 0)) + 1e-8
    return out / (s[..., :, None] * s[..., None, :])


def principal(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (rows, from the largest; their largest entry positive) and shares of variance of symmetric matrices."""
    values, vectors = np.linalg.eigh(matrices)
    values, v = np.maximum(values[..., ::-1], 0), np.swapaxes(vectors[..., ::-1], -1, -2)
    top = np.take_along_axis(v, np.abs(v).argmax(-1)[..., None], -1)
    return v * np.where(top < 0, -1, 1), values / np.maximum(values.sum(-1, keepdims=True), 1e-300)


def _factor_numbers(rows: pd.DataFrame) -> pd.DataFrame:
    """FACTOR_COLUMNS of a batch of series; eigenvectors of all of them are found together."""
    out, spectra, most = pd.DataFrame(np.nan, index=range(len(rows)), columns=FACTOR_COLUMNS), {}, max(SIZES)
    for p in (0, 1):
        n = rows[f"n{p}"].fillna(0).to_numpy(np.int64)
        for m in SIZES:
            at = np.flatnonzero(n - m + 1 >= (LEAST_WINDOWS if m == most else 10))
            if not len(at):
                continue
            ends = {"products": slice(m), "first": slice(m - 1), "last": slice(-m, None)}
            values = [np.stack([np.asarray(x, dtype=float)[cut] for x in rows[f"{c}{p}"].iloc[at]]) for c, cut in ends.items()]
            vectors, shares = principal(correlation_matrix(n[at], *values, m))
            for share in (90, 95):
                out.loc[at, f"needed{share}_{p}_{m}"] = 1.0 + (np.cumsum(shares, -1) < share / 100).sum(-1)
            if m == most:
                spectra[p] = dict(zip(at.tolist(), zip(vectors[:, :FACTORS], shares[:, :FACTORS], strict=True), strict=True))
    both = [k for k in spectra.get(0, {}) if k in spectra.get(1, {})]
    found = []
    for k in both:
        (v0, s0), (v1, s1) = (spectra[p][k] for p in (0, 1))
        u, cosines, w = np.linalg.svd(v1 @ v0.T)
        angles = np.arccos(np.clip(cosines, -1, 1))
        found.append([*s0, *s1, np.abs(s1 - s0).sum(), np.linalg.norm((u @ w).T @ v1 - v0), angles.max(), angles.mean()])
    if both:
        out.loc[both, [*_SHARES, "share_l1", "procrustes", "angle_max", "angle_mean"]] = np.array(found)
    return out


def factors(series: DataFrame) -> DataFrame:
    """Shares of variance, distance and angles of the principal directions of the two periods' embeddings, and how many explain 90 and 95 %.

    Spark gives each period's products over lags and its first and last values; a row a series goes through NumPy.
    """
    most = max(SIZES)
    each = Window.partitionBy("series_id", "period")
    sums = lag_sums(series, most - 1).groupBy("series_id", "period").agg(F.array_sort(F.collect_list(F.struct("lag", "p"))).getField("p").alias("products"), F.max("n").alias("n"))
    c = series.select("series_id", "period", F.row_number().over(within()).alias("i"), F.count("*").over(each).alias("n"), (F.col("value") - F.avg("value").over(each)).alias("x"))
    listed = lambda rows: F.array_sort(F.collect_list(F.when(rows, F.struct("i", "x")))).getField("x")
    ends = c.where((F.col("i") <= 2 * most) | (F.col("i") > F.col("n") - most)).groupBy("series_id", "period").agg(listed(F.col("i") <= 2 * most).alias("first"), listed(F.col("i") > F.col("n") - most).alias("last"))
    periods = sums.join(ends, ["series_id", "period"])
    names = ("n", "products", "first", "last")
    rows = periods.groupBy("series_id").agg(*[F.max(side(F.col(k), p)).alias(f"{k}{p}") if k == "n" else F.first(side(F.col(k), p), ignorenulls=True).alias(f"{k}{p}") for p in (0, 1) for k in names])

    @F.pandas_udf(", ".join(f"{c} double" for c in FACTOR_COLUMNS))
    def numbers(n0: pd.Series, products0: pd.Series, first0: pd.Series, last0: pd.Series, n1: pd.Series, products1: pd.Series, first1: pd.Series, last1: pd.Series) -> pd.DataFrame:
        return _factor_numbers(pd.DataFrame({"n0": n0, "products0": products0, "first0": first0, "last0": last0, "n1": n1, "products1": products1, "first1": first1, "last1": last1}))

    return rows.select("series_id", numbers(*[f"{k}{p}" for p in (0, 1) for k in names]).alias("f")).select("series_id", "f.*")


def factor_scan(series: DataFrame, window: int = 20, step: int = 5, size: int = 10, kept: int = 2) -> DataFrame:
    """How far the two leading directions of successive windows differ: mean, spread, and how near the largest change is to the boundary."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    b = F.sum((F.col("period") == 0).cast("long")).over(Window.partitionBy("series_id"))
    last = F.floor(F.col("t") / step)
    first = F.greatest(F.floor((F.col("t") - window) / step) + 1, F.lit(0))
    counted = series.select("series_id", "t", "value", n.alias("n"), b.alias("b"))  # before the rows are multiplied
    rows = counted.select("*", F.explode(F.sequence(first, last)).alias("k")).where((F.col("n") >= 2 * window) & (F.col("k") * step + window < F.col("n")))
    w = rows.groupBy("series_id", "k").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).getField("value").alias("x"), F.first("n").alias("n"), F.first("b").alias("b"))

    @F.pandas_udf("array<double>")
    def directions(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        m = np.lib.stride_tricks.sliding_window_view(np.stack(x.to_list()).astype(float), size, axis=1)
        m = m - m.mean(1, keepdims=True)
        return pd.Series(list(principal(np.swapaxes(m, 1, 2) @ m)[0][:, :kept].reshape(len(x), -1)))

    order = Window.partitionBy("series_id").orderBy("k")
    d = w.select("series_id", "k", "n", "b", directions("x").alias("v")).withColumn("p", F.lag("v").over(order)).where("p IS NOT NULL")
    d = d.select("series_id", "k", "n", "b", F.sqrt(F.aggregate(F.zip_with("v", "p", lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, x: s + x)).alias("d"))
    g = d.groupBy("series_id").agg(F.avg("d").alias("stability"), F.stddev_pop("d").alias("evolution"), F.max_by("k", F.struct(F.round("d", 9), -F.col("k"))).alias("k"), F.first("n").alias("n"), F.first("b").alias("b"))
    return g.select("series_id", "stability", "evolution", (1 - F.abs(F.col("k") * step + window // 2 - F.col("b")) / (F.col("n") / 2)).alias("location_score"))


def factor_regression(series: DataFrame, lags: int = 3) -> DataFrame:
    """R squared of each period's regression on its lags with the difference and Chow's F, and how far the lags' correlations change."""
    k, m = lags, lags + 1
    f = fits(series, first_lags(k))
    part = lambda i, j, p: F.col(f"p{min(i, j)}_{max(i, j)}_{p}") - over(F.col(f"s{i}_{p}") * F.col(f"s{j}_{p}"), F.col(f"n_{p}"))
    co = lambda i, j, p: sum((part(a, b, p) for a in range(i, m) for b in range(j, m)), F.lit(0.0))  # a lag is the sum of the differences from it on
    r2 = lambda p: 1 - over(F.col(f"rss_{p}"), co(0, 0, p))
    corr = lambda i, j, p: over(co(i, j, p), F.sqrt(co(i, i, p) * co(j, j, p)))
    changes = F.array(*[F.abs(corr(i, j, "1") - corr(i, j, "0")) for i in range(m) for j in range(i + 1, m)])
    split, d2 = F.col("rss_0") + F.col("rss_1"), F.col("n_0") + F.col("n_1") - 2 * m
    chow = F.when(d2 > 0, over((F.col("rss_full") - split) / m, over(split, d2)))
    f = f.select("series_id", r2("0").alias("r2_0"), r2("1").alias("r2_1"), chow.alias("chow"), changes.alias("c"))
    mean = F.aggregate("c", F.lit(0.0), lambda s, x: s + x) / F.size("c")
    return f.select("series_id", "r2_0", "r2_1", (F.col("r2_1") - F.col("r2_0")).alias("r2_diff"), "chow", mean.alias("correlation_change"), F.array_max("c").alias("correlation_change_max"))


def sup_f_lags(series: DataFrame, lags: int = 2, trim: float = 0.15, step: int = 1) -> DataFrame:
    """Largest Chow F of a regression on ``lags`` lags over splits within the second period, ``trim`` of it left out at both ends.

    Sums of products run along the series, so a candidate's Gram matrices before and after it are the running sums and what is
    left of the whole ones; nothing is fitted again.
    """
    k, m = lags, lags + 1
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    z = lambda i: F.lit(1.0) if i < 0 else F.col(f"z{i}")
    terms = [(-1, -1), *[(-1, j) for j in range(k + 1)], *pairs]
    upto, whole = ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("series_id")
    rows = with_lags(series, first_lags(k))
    r = rows.select("series_id", "t", F.sum((F.col("period") == 1).cast("double")).over(whole).alias("n1"), *[x for n, (i, j) in enumerate(terms) for x in (F.sum(z(i) * z(j)).over(upto).alias(f"l{n}"), F.sum(z(i) * z(j)).over(whole).alias(f"a{n}"))])
    n_, i_ = F.col("a0"), F.col("l0")
    low, high = n_ - F.col("n1") + F.floor(F.col("n1") * trim), n_ - F.floor(F.col("n1") * trim)
    r = r.where((i_ >= low) & (i_ <= high) & (i_ > m) & (i_ < n_ - m) & ((i_ - low) % step == 0))
    sums = {"l": lambda n: F.col(f"l{n}"), "r": lambda n: F.col(f"a{n}") - F.col(f"l{n}"), "a": lambda n: F.col(f"a{n}")}

    def co(get, i: int, j: int) -> Column:
        return get(1 + k + 1 + pairs.index((min(i, j), max(i, j)))) - over(get(1 + i) * get(1 + j), get(0))

    r = r.select("series_id", "l0", "a0", *[F.array(*[F.array(*[co(get, i, j) for j in (*range(1, k + 1), 0)]) for i in range(1, k + 1)]).alias(f"rows_{s}") for s, get in sums.items()], *[co(get, 0, 0).alias(f"yy_{s}") for s, get in sums.items()])
    r = r.select("*", *[solved(F.col(f"rows_{s}"), k).alias(f"beta_{s}") for s in sums])
    rss = lambda s: F.col(f"yy_{s}") - dot(F.col(f"beta_{s}"), F.transform(f"rows_{s}", lambda x: F.get(x, k)))
    r = r.select("series_id", "l0", "a0", *[rss(s).alias(f"rss_{s}") for s in sums])
    split = F.col("rss_l") + F.col("rss_r")
    scored = r.select("series_id", F.col("l0").cast("long").alias("k"), over((F.col("rss_a") - split) / m, over(split, F.col("a0") - 2 * m)).alias("f"))
    return scored.groupBy("series_id").agg(F.max_by(F.struct("k", "f"), F.struct(F.round("f", 9), -F.col("k"))).alias("b")).select("series_id", "b.k", F.col("b.f").alias("sup_f"))


# --- spectra ------------------------------------------------------------------------------------------------------------
BANDS = ("low", "mid", "high")


def segment_spectrum(series: DataFrame, size: int = 64) -> DataFrame:
    """series_id, period, k, power: mean power of a period's whole segments of ``size`` values at frequencies k / size, k from 1 to half."""
    each = Window.partitionBy("series_id", "period")
    c = series.select("series_id", "period", (F.row_number().over(within()) - 1).alias("i"), (F.col("value") - F.avg("value").over(each)).alias("x"))
    s = c.groupBy("series_id", "period", F.floor(F.col("i") / size).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).getField("x").alias("x")).where(F.size("x") == size)
    wave = {f: F.array(*[F.lit(f(2 * math.pi * j / size)) for j in range(size)]) for f in (math.cos, math.sin)}
    turned = lambda f, k: F.aggregate(F.transform("x", lambda x, i: x * F.get(wave[f], F.pmod(i * k, F.lit(size)))), F.lit(0.0), lambda a, b: a + b)
    power = F.transform(F.sequence(F.lit(1), F.lit(size // 2)), lambda k: (turned(math.cos, k) ** 2 + turned(math.sin, k) ** 2) / size)
    return s.select("series_id", "period", F.posexplode(power).alias("k", "p")).groupBy("series_id", "period", (F.col("k") + 1).cast("long").alias("k")).agg(F.avg("p").alias("power"))


def band_energies(series: DataFrame, size: int = 64) -> DataFrame:
    """By period: energy below a quarter, up to a half and above a half of the frequencies, centroid, bandwidth, roll-off of 85 % and dominant frequency; differences and ratio."""
    p = segment_spectrum(series, size)
    half, f = size // 2, F.col("k") / size
    each = Window.partitionBy("series_id", "period")
    p = p.withColumn("total", F.sum("power").over(each)).withColumn("run", F.sum("power").over(each.orderBy("k"))).withColumn("centre", over(F.sum(f * F.col("power")).over(each), F.sum("power").over(each)))
    band = F.when(F.col("k") <= half // 4, BANDS[0]).when(F.col("k") <= half // 2, BANDS[1]).otherwise(BANDS[2])
    p = p.withColumn("band", band)
    at = lambda x, k: F.sum(F.when(F.col("period") == k, x))
    one = lambda k, x: F.when(F.col("period") == k, x)
    g = p.groupBy("series_id").agg(*[x for k in (0, 1) for x in (
        *[at(F.when(F.col("band") == b, F.col("power")), k).alias(f"{b}_{k}") for b in BANDS], F.max(one(k, F.col("total"))).alias(f"energy_{k}"), F.max(one(k, F.col("centre"))).alias(f"centroid_{k}"),
        F.sqrt(over(at((f - F.col("centre")) ** 2 * F.col("power"), k), at(F.col("power"), k))).alias(f"bandwidth_{k}"),
        F.min(one(k, F.when(F.round(F.col("run") - 0.85 * F.col("total"), 9) >= 0, f))).alias(f"rolloff_{k}"),
        F.max_by(one(k, f), one(k, F.struct(F.round("power", 9), -F.col("k")))).alias(f"dominant_{k}"),
    )])
    return g.select("*", over(F.col("energy_1"), F.col("energy_0")).alias("energy_ratio"), *[(F.col(f"{c}_1") - F.col(f"{c}_0")).alias(f"{c}_diff") for c in ("centroid", "bandwidth", "rolloff", "dominant")])
