"""Data sets of windows, samples, splits and folds, and profiles of whole tables.

Samples are ordered by a hash that other engines can compute too, so a sample is a function of ids and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.moments import kurt, over, side, skew
from riftline.operators.ranges import ranked, with_quantiles
from riftline.operators.shape import CHUNK
from riftline.sources.series import from_arrays

MULTIPLIER, MODULUS = 2_654_435_761, 4_294_967_296


def order_of(seed: int) -> list[Column]:
    """Order by a multiplicative hash of whole-number ids, in decimals, which no id can overflow."""
    return [(F.col("series_id").cast("decimal(20,0)") * MULTIPLIER + seed) % MODULUS, F.col("series_id")]


def _numbered(labels: DataFrame, seed: int) -> DataFrame:
    """Labels with the number r of a series within its class, in the order of the hash, and the class's size; no label is no break."""
    h, id_ = order_of(seed)
    known = labels.withColumn("has_break", F.coalesce("has_break", F.lit(False)))
    return ranked(known, "has_break", F.floor(h / 65_536).cast("int"), [h, id_])


def _long(series: DataFrame) -> DataFrame:
    """The long form, whether the series come in it or as arrays."""
    return series if "t" in series.columns else from_arrays(series)


def _boundaries(series: DataFrame) -> DataFrame:
    """Where each series' second period begins (its length where there is none), and its length."""
    return series.groupBy("series_id").agg(F.coalesce(F.min(F.when(F.col("period") == 1, F.col("t"))), F.count("*")).alias("boundary"), F.count("*").alias("length"))


def _chunks(series: DataFrame, size: int, stride: int) -> DataFrame:
    """Each series in stretches from ``first`` on, about CHUNK values long, which hold all windows that begin in them whole.

    A stretch also gets the values after it that its last windows need, so no row grows with a series.
    """
    step = -(-max(CHUNK, size) // stride) * stride
    own, i = F.floor(F.col("t") / step), F.col("t") % step
    before = F.when((i < size - stride) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = series.select("series_id", "t", "value", F.explode(before).alias("chunk"))
    g = dealt.groupBy("series_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).getField("value").alias("v"))
    return g.select("series_id", (F.col("chunk") * step).cast("long").alias("first"), "v")


def _windows(chunks: DataFrame, size: int, stride: int, *also: str) -> DataFrame:
    starts = F.sequence(F.lit(0), F.size("v") - size, F.lit(stride))
    each = F.transform(starts, lambda k: F.struct((F.col("first") + k).alias("window_start"), F.slice("v", k + 1, size).alias("window")))
    return chunks.where(F.size("v") >= size).select("series_id", *also, F.explode(each).alias("w")).select("series_id", *also, "w.window_start", "w.window")


def sliding_windows(series: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows of each series' values, given in the long form or as arrays; none for a series shorter than a window."""
    return _windows(_chunks(_long(series), size, stride), size, stride)


def break_windows(series: DataFrame, size: int, stride: int, margin: int = 10, most: int | None = None) -> DataFrame:
    """Windows that hold the boundary at least ``margin`` from both ends; all, or the ``most`` earliest of a series."""
    held = marked_windows(series, size, stride, margin).where("break_position IS NOT NULL")
    if most is not None:
        held = held.withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy("window_start"))).where(F.col("r") <= most)
    return held.select("series_id", "window_start", "break_position", "window")


def boundary_windows(series: DataFrame, size: int) -> DataFrame:
    """The last half window before the boundary and the first half after it, where there are so many values."""
    half, at, rows = size // 2, F.col("t") - F.col("boundary"), _long(series)
    near = rows.join(_boundaries(rows).where((F.col("boundary") >= half) & (F.col("length") - F.col("boundary") >= half)), "series_id").where((at >= -half) & (at < half))
    return near.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).getField("value").alias("window"))


def labels_of(series: DataFrame) -> DataFrame:
    """One label a series; a series without one counts as without a break."""
    return series.groupBy("series_id").agg(F.coalesce(F.max("has_break"), F.lit(False)).alias("has_break"))


def random_sample(labels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return labels.orderBy(*order_of(seed)).limit(n)


def balanced_sample(labels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n series, half of each class; a class that has too few is made up for by the other."""
    numbered = _numbered(labels, seed)
    hit = F.coalesce("has_break", F.lit(False))
    sizes = labels.agg(F.count(F.when(hit, 1)).alias("p"), F.count(F.when(~hit, 1)).alias("q"))
    want = F.when(F.col("has_break"), F.greatest(F.lit(n // 2), n - F.col("q"))).otherwise(F.greatest(F.lit(n - n // 2), n - F.col("p")))
    return numbered.join(F.broadcast(sizes)).where(F.col("r") <= want).select("series_id", "has_break")


def stratified_split(labels: DataFrame, data_ratio: float, validation_ratio: float, seed: int = 42) -> DataFrame:
    """Of each class a share data_ratio is used, and a share validation_ratio of that validates."""
    x = _numbered(labels, seed).withColumn("used", F.floor(F.col("size") * data_ratio))
    part = F.when(F.col("r") <= F.floor(F.col("used") * validation_ratio), "validation").otherwise("train")
    return x.where(F.col("r") <= F.col("used")).select("series_id", "has_break", part.alias("part"))


def stratified_folds(labels: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return _numbered(labels, seed).select("series_id", "has_break", ((F.col("r") - 1) % k).cast("long").alias("fold"))


def dataset_statistics(series: DataFrame) -> DataFrame:
    """One row: numbers of series by class (no label is no break), and lengths."""
    lengths = series.groupBy("series_id").agg(F.count("*").cast("double").alias("n"), F.coalesce(F.max("has_break"), F.lit(False)).alias("b"))
    return lengths.agg(F.count("*").alias("series"), F.count(F.when(F.col("b"), 1)).alias("positive"), F.count(F.when(~F.col("b"), 1)).alias("negative"), F.avg(F.col("b").cast("double")).alias("ratio"), F.min("n").alias("length_min"), F.max("n").alias("length_max"), F.avg("n").alias("length_mean"), F.stddev_pop("n").alias("length_std"))


def length_profile(series: DataFrame) -> DataFrame:
    lengths = series.groupBy("series_id").agg(F.count("*").cast("double").alias("n"), *[F.count(side(F.col("value"), p)).cast("double").alias(f"n{p}") for p in (0, 1)]).withColumn("ratio", over(F.col("n0"), F.col("n1")))
    names = ("n", "n0", "n1", "ratio")
    out = lengths.agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))])
    return with_quantiles(out, lengths, {f"{c}_median": (c, 0.5) for c in names})


def value_profile(series: DataFrame) -> DataFrame:
    """One row per period and one (-1) for all values."""
    both = series.select("value", F.explode(F.array(F.lit(-1), F.col("period"))).alias("period"))
    v = F.col("value")
    both = both.withColumn("period", F.col("period").cast("long"))
    out = both.groupBy("period").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), skew(v).alias("skew"), kurt(v).alias("kurt"))
    return with_quantiles(out, both, {"median": ("value", 0.5)}, "period")


def class_comparison(series: DataFrame) -> DataFrame:
    """Mean, deviation and median, by class (no label is no break), of the change of mean and of spread at the boundary."""
    v = F.col("value")
    per = series.groupBy("series_id").agg(F.coalesce(F.max("has_break"), F.lit(False)).cast("long").alias("has_break"), (F.avg(side(v, 1)) - F.avg(side(v, 0))).alias("dm"), (F.stddev_samp(side(v, 1)) - F.stddev_samp(side(v, 0))).alias("ds"))
    out = per.groupBy("has_break").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in ("dm", "ds") for k, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return with_quantiles(out, per, {f"{c}_median": (c, 0.5) for c in ("dm", "ds")}, "has_break")


def histogram(series: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of values in equal bins from the least to the greatest value, which is in the last bin."""
    ends = series.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    b = F.least(F.floor(over((F.col("value") - F.col("low")) * bins, F.col("high") - F.col("low"))), F.lit(bins - 1))
    return series.join(F.broadcast(ends)).groupBy(F.coalesce(b, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def correlations(features: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of each pair of feature columns, in one pass."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    one = features.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")


def inference_windows(series: DataFrame, size: int, stride: int) -> DataFrame:
    """Sliding windows of every series; one that is shorter than a window is padded by its last value."""
    missing = F.when(F.col("first") == 0, F.greatest(size - F.size("v"), F.lit(0))).otherwise(0)
    padded = F.concat("v", F.array_repeat(F.element_at("v", -1), missing))
    return _windows(_chunks(_long(series), size, stride).withColumn("v", padded), size, stride)


def standardised(windows: DataFrame) -> DataFrame:
    """Long rows of windows with each position's values less their mean over all windows, by their spread.

    The table of positions has as many rows as a window is long, so it is broadcast.
    """
    cells = windows.select("series_id", "window_start", F.posexplode("window").alias("position", "value"))
    by = cells.groupBy("position").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return cells.join(F.broadcast(by), "position").select("series_id", "window_start", F.col("position").cast("long").alias("position"), over(F.col("value") - F.col("m"), F.col("s")).alias("z"))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that is a function of the key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)


def augmented(series: DataFrame, kind: str, copy: int = 0, around: int = 10) -> DataFrame:
    """A changed copy of each series, renumbered, with ``_aug`` and the copy's number after its id.

    shift keeps a stretch of 80 to 100 % with the boundary inside; subsample keeps 70 to 95 % of the rows and all
    within ``around`` of the boundary; noise adds a hundredth of the series' spread.  The choices are functions of
    id, position and copy, so a lost task gives the same rows again.  A series without a second period
    has its boundary at its end.
    """
    id_, seed = F.col("series_id"), F.lit(copy)
    per = series.groupBy("series_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("period") == 0, 1)).alias("b"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("s"))
    rows = series.join(per, "series_id")
    if kind == "shift":
        length = F.ceil(F.col("n") * (0.8 + 0.2 * uniform(id_, seed, F.lit("length"))))
        low, high = F.greatest(F.col("b") - length + 1, F.lit(0)), F.least(F.greatest(F.col("b") - 1, F.lit(0)), F.col("n") - length)
        start = F.least(low, high) + F.floor(uniform(id_, seed, F.lit("start")) * (F.greatest(high - low, F.lit(0)) + 1))
        rows = rows.where((F.col("t") >= start) & (F.col("t") < start + length))
    elif kind == "subsample":
        share = 0.7 + 0.25 * uniform(id_, seed, F.lit("share"))
        rows = rows.where((F.abs(F.col("t") - F.col("b")) <= around) | (uniform(id_, F.col("t"), seed) < share))
    elif kind == "noise":
        normal = F.sqrt(-2 * F.log(1 - uniform(id_, F.col("t"), seed, F.lit("r")))) * F.cos(2 * F.pi() * uniform(id_, F.col("t"), seed, F.lit("a")))
        rows = rows.withColumn("value", F.col("value") + 0.01 * F.col("s") * normal)
    else:
        raise ValueError(f"no such change: {kind}")
    number = (F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1).cast("long")
    return rows.withColumn("t", number).select(F.concat(id_.cast("string"), F.lit(f"_aug{copy}")).alias("series_id"), "t", "value", "period")


def one_series(series: DataFrame, series_id: object) -> DataFrame:
    """The rows of one series; the predicate reaches the scan of a stored table."""
    return series.where(F.col("series_id") == F.lit(series_id))


def class_sample(labels: DataFrame, has_break: bool, n: int, seed: int = 42) -> DataFrame:
    """n series of one class; a series without a label is one without a break."""
    return random_sample(labels.where(F.coalesce("has_break", F.lit(False)) == F.lit(has_break)), n, seed)


def marked_windows(series: DataFrame, size: int, stride: int, margin: int = 10) -> DataFrame:
    """Sliding windows with the break's position in them, null where the boundary isn't ``margin`` from both ends."""
    rows = _long(series)
    w = _windows(_chunks(rows, size, stride).join(_boundaries(rows).drop("length"), "series_id"), size, stride, "boundary")
    at = F.col("boundary") - F.col("window_start")
    return w.select("series_id", "window_start", F.when((at >= margin) & (at <= size - margin), at).alias("break_position"), "window")


def break_encodings(windows: DataFrame, size: int) -> DataFrame:
    """The break's position as a share of the window, -1 without one."""
    return windows.select("series_id", "window_start", F.coalesce(F.col("break_position") / size, F.lit(-1.0)).alias("break_code"))


def position_encodings(windows: DataFrame) -> DataFrame:
    """Long rows of windows: each value with its place as a share of the window's length."""
    cells = windows.select("series_id", "window_start", F.size("window").alias("n"), F.posexplode("window").alias("i", "value"))
    return cells.select("series_id", "window_start", F.col("i").cast("long").alias("i"), (F.col("i") / F.col("n")).alias("place"), "value")


def balanced_windows(windows: DataFrame, seed: int = 42) -> DataFrame:
    """All windows with a break and 7 without for each 3 of them, the first in the order of a hash of series, place and seed."""
    digest = F.md5(F.concat_ws(":", F.col("series_id").cast("string"), F.col("window_start").cast("string"), F.lit(str(seed))).cast("binary"))
    held = F.col("break_position").isNotNull()
    bucket = F.conv(F.substring("digest", 1, 4), 16, 10).cast("int")
    numbered = ranked(windows.withColumn("digest", digest).withColumn("held", held), "held", bucket, [F.col("digest"), F.col("series_id"), F.col("window_start")])
    want = windows.agg(F.floor(F.count("break_position") * 7 / 3).alias("want"))  # one row
    return numbered.join(F.broadcast(want)).where(F.col("held") | (F.col("r") <= F.col("want"))).select(windows.columns)


def window_distribution(windows: DataFrame) -> DataFrame:
    """One row: windows of a series, places of breaks, and balance of the classes."""
    p = F.col("break_position")
    by = windows.groupBy("series_id").agg(F.count("*").alias("k"), F.count(p).alias("b"), F.sum(p).cast("double").alias("s"), F.sum(p * p).cast("double").alias("q"), F.min(p).alias("low"), F.max(p).alias("high"))
    k, b = F.sum("k"), F.sum("b")
    mean = over(F.sum("s"), b)
    return by.agg(F.count("*").alias("series"), F.avg("k").alias("per_series_mean"), F.stddev_pop("k").alias("per_series_std"), F.min("k").alias("per_series_min"), F.max("k").alias("per_series_max"), mean.alias("position_mean"), F.sqrt(F.greatest(over(F.sum("q"), b) - mean * mean, F.lit(0.0))).alias("position_std"), F.min("low").alias("position_min"), F.max("high").alias("position_max"), b.alias("with_break"), (k - b).alias("without_break"), over(b, k).alias("break_ratio"))


def complete_rows(features: DataFrame, how: str, columns: list[str]) -> DataFrame:
    """Rows without a null (``any``), or with at least one value (``all``), among the columns."""
    return features.na.drop(how, subset=columns)


def without_copies(features: DataFrame, copies: dict[str, str]) -> DataFrame:
    """Fills each column from its copy where it is null, and drops the copies."""
    for copy, column in copies.items():
        features = features.withColumn(column, F.coalesce(F.col(column), F.col(copy))).drop(copy)
    return features


def aligned(features: DataFrame, columns: list[str]) -> DataFrame:
    """The features in a saved order; missing columns and nulls are 0."""
    return features.select("series_id", *[(F.coalesce(F.col(c), F.lit(0.0)) if c in features.columns else F.lit(0.0)).alias(c) for c in columns])


def stacked_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both tables with the columns that both have."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(common).unionByName(b.select(common))
