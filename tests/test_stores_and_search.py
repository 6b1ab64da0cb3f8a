"""Stores, whole-table order statistics, samples by hash, search, selection and generated series."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.operators import datasets, distribution, profiles, ranges, regression, synthetic
from riftline.plans import features, selection
from riftline.sources.feature_store import cached, place, save_summary

SERIES = "series_id long, t long, value double, period int"


def some_series(spark, n=6, size=30, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(k, t, float(rng.normal()), int(t >= size // 2)) for k in range(n) for t in range(size)], SERIES)


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "two"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, size=3000).astype(float), "heavy": np.exp(30 * rng.normal(size=3000)) * rng.choice([-1, 1], size=3000), "two": np.array([1.0, np.nextafter(1.0, 2)] * 50)}[kind]
    rows = [(("a", "b", None)[k % 3], float(v)) for k, v in enumerate(x)] + [("a", None), ("c", 5.0), ("d", None)]
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = {(r["g"], r["share"]): r["value"] for r in ranges.quantiles(spark.createDataFrame(rows, "g string, v double"), ["v"], shares, "g").collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in ("a", "b", None, "c")}
    assert set(got) == {(g, s) for g in groups for s in shares}
    for (g, s), v in got.items():
        assert v == pytest.approx(np.quantile(groups[g], s), rel=1e-12)
    assert ranges.quantiles(spark.createDataFrame([], "v double"), ["v"], [0.5]).count() == 0


def test_running_sums_and_ranks(spark):
    rng = random.Random(2)
    values = rng.sample(range(10_000), 900)
    each = spark.createDataFrame([(v / 7, v % 5) for v in values], "v double, k long")
    for down in (False, True):
        want, total = {}, 0
        for v in sorted(values, reverse=down):
            total += v % 5
            want[v / 7] = total
        assert {r["v"]: r["run_k"] for r in ranges.running(each, "v", ["k"], down).collect()} == want
    rows = spark.createDataFrame([(v % 3, v) for v in values], "g long, v long")
    got = ranges.ranked(rows, "g", F.floor(F.col("v") / 100).cast("int"), [F.col("v")]).collect()
    for g in range(3):
        own = sorted(v for v in values if v % 3 == g)
        assert sorted((r["r"], r["v"], r["size"]) for r in got if r["g"] == g) == [(k + 1, v, len(own)) for k, v in enumerate(own)]


def test_no_window_start_is_preferred(spark):
    """1,000 series with ids of equal length, 20 windows each, 60 with a break: the 140 chosen come from all starts."""
    rows = [(f"s{k:04d}", 5 * w, 50 if w == 0 and k < 60 else None) for k in range(1000) for w in range(20)]
    chosen = datasets.balanced_windows(spark.createDataFrame(rows, "series_id string, window_start long, break_position int")).collect()
    without = [r for r in chosen if r["break_position"] is None]
    starts = Counter(r["window_start"] for r in without)
    assert len(chosen) == 200 and len(without) == 140 and len({r["series_id"] for r in without}) > 110
    assert len(starts) >= 18 and max(starts.values()) < 20


def test_series_without_a_label_have_no_break(spark):
    labels = {0: True, 1: None, 2: False}
    rows = [(k, t, float(t * (k + 1)), int(t > 3), labels[k]) for k in labels for t in range(8)]
    df = spark.createDataFrame(rows, SERIES + ", has_break boolean")
    one = datasets.dataset_statistics(df).first()
    assert (one["series"], one["positive"], one["negative"]) == (3, 1, 2)
    assert {r["has_break"]: r["n"] for r in datasets.class_comparison(df).collect()} == {0: 2, 1: 1}
    assert {r["fold"] for r in datasets.stratified_folds(df.groupBy("series_id").agg(F.max("has_break").alias("has_break")), 2).where("NOT has_break").collect()} == {0, 1}


def test_only_changed_series_are_computed(spark, tmp_path):
    asked = []

    def counted(series, power=1):
        asked.append(sorted(r["series_id"] for r in series.select("series_id").distinct().collect()))
        return series.groupBy("series_id").agg(F.sum(F.col("value") ** power).alias("s"))

    path, series = str(tmp_path / "store"), some_series(spark)
    first = {r["series_id"]: r["s"] for r in cached(series, path, "sums", counted, power=2).collect()}
    assert asked == [list(range(6))] and len(first) == 6
    assert {r["series_id"]: r["s"] for r in cached(series.orderBy(F.rand(1)), path, "sums", counted, power=2).collect()} == first
    assert asked[1] == []
    changed = series.withColumn("value", F.when((F.col("series_id") == 4) & (F.col("t") == 3), 0.5).otherwise(F.col("value")))
    again = {r["series_id"]: r["s"] for r in cached(changed, path, "sums", counted, power=2).collect()}
    assert asked[2] == [4] and {k for k in again if again[k] != first[k]} == {4}
    cached(series, path, "sums", counted, power=1)
    assert asked[3] == list(range(6)) and place(path, "a", {"x": 1, "y": 2}) == place(path, "a", {"y": 2, "x": 1}) != place(path, "a", {"x": 2, "y": 1})
    swapped = series.withColumn("t", F.when(F.col("series_id") == 0, 29 - F.col("t")).otherwise(F.col("t")))
    cached(swapped, path, "sums", counted, power=2)
    assert asked[4] == [0]


def test_summary_as_json(spark, tmp_path):
    series = some_series(spark).withColumn("has_break", F.col("series_id") == 1)
    row = profiles.summary(series)
    save_summary(row, str(tmp_path / "summary"))
    back = spark.read.json(str(tmp_path / "summary")).first().asDict()
    assert len(row.columns) == 26 and back == pytest.approx({k: v for k, v in row.first().asDict().items() if v is not None})


def test_stored_nulls_equal_those_of_one_run(spark, tmp_path):
    rng = np.random.default_rng(5)
    gains = [(k, float(np.round(rng.normal(), 1)), float(rng.normal()) if k % 9 else None, 0) for k in range(400)] + [(k, float(np.round(rng.normal() + 1, 1)), float(rng.normal() * 3), 1) for k in range(400, 600)]
    df = spark.createDataFrame(gains, "series_id long, a double, b double, label int")
    want = {r["series_id"]: r.asDict() for r in features.null_tests(df, ["a", "b"]).drop("fisher_p", "bonferroni_p").collect()}
    features.save_nulls(df, ["a", "b"], str(tmp_path / "nulls"))
    got = {r["series_id"]: r.asDict() for r in features.stored_null_tests(df.drop("label"), ["a", "b"], str(tmp_path / "nulls")).collect()}
    for k, row in want.items():
        assert got[k] == pytest.approx(row), k
    other = spark.createDataFrame([(1, 99.0, -99.0), (2, None, 0.123)], "series_id long, a double, b double")
    far = {r["series_id"]: r for r in features.stored_null_tests(other, ["a", "b"], str(tmp_path / "nulls")).collect()}
    null_b = [b for _, _, b, y in gains if y == 0 and b is not None]
    assert far[1]["a_p"] == pytest.approx(1 / 401) and far[1]["b_p"] == 1 and far[2]["a_p"] is None
    assert far[2]["b_p"] == pytest.approx(sum(b >= 0.123 for b in null_b) / len(null_b))


def test_information_finds_the_informative_feature(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(k % 2), float(rng.normal()), float((k % 2) * 2 + rng.normal()), float(abs(rng.normal()) if k % 2 else abs(rng.normal()) + 1.5) * rng.choice([-1, 1])) for k in range(600)]
    df = spark.createDataFrame([(a, b, c, d, float(e)) for a, b, c, d, e in rows], "series_id long, label double, noise double, shifted double, spread double")
    assert selection.best_by_information(df, 2) in (["shifted", "spread"], ["spread", "shifted"])
    got = {r["feature"]: r["information"] for r in selection.mutual_information(df, ["noise", "shifted", "spread"]).collect()}
    for n, c in enumerate(("noise", "shifted", "spread")):
        x, y = np.array([r[2 + n] for r in rows]), np.array([r[1] for r in rows])
        bins = (x[:, None] > np.quantile(x, np.arange(1, 10) / 10)).sum(1)
        joint = np.array([[((bins == b) & (y == v)).mean() for v in (0, 1)] for b in range(10)])
        want = sum(p * math.log(p / (joint[b].sum() * joint[:, v].sum())) for (b, v), p in np.ndenumerate(joint) if p > 0)
        assert got[c] == pytest.approx(want)


def test_search_beats_random_draws():
    """On a planted optimum of nine parameters, at equal tries, over ten seeds; and the same seed gives the same draws."""
    space = {c: (0.0, 1.0, False, False) for c in "abcdefghi"}
    score = lambda p: -sum((x - 0.1 * (k + 1)) ** 2 for k, x in enumerate(p.values()))
    best = lambda tried: max(s for _, s in tried)
    dense = [best(selection.searched(score, 60, seed, space)) for seed in range(10)]
    even = [best(selection.searched(score, 60, seed, space, first=60)) for seed in range(10)]
    assert sum(a > b for a, b in zip(dense, even, strict=True)) >= 8 and np.mean(dense) > np.mean(even) + 0.05
    assert selection.searched(score, 20, 3, space) == selection.searched(score, 20, 3, space)
    draws = selection.Draws(selection.SPACE, 1)
    named = draws.named(draws.next())
    assert len(named) == 9 and all(low <= named[c] <= high and (not whole or named[c] == int(named[c])) for c, (low, high, whole, _) in selection.SPACE.items())


def test_generated_series_have_the_model_and_come_again(spark):
    models = spark.createDataFrame([(k, 3000, 5.0, phi, 2.0) for k, phi in enumerate((0.0, 0.5, 0.9, -0.7))], "series_id long, n long, mean double, slope double, sigma double")
    paths = synthetic.ar1_paths(models, 7).withColumn("period", (F.col("t") >= 1500).cast("int"))
    fitted = {r["series_id"]: r for r in regression.fits(paths).collect()}
    for k, phi in enumerate((0.0, 0.5, 0.9, -0.7)):
        assert fitted[k]["slope_full"] == pytest.approx(phi, abs=0.05)
        assert math.sqrt(fitted[k]["rss_full"] / 2997) == pytest.approx(2.0, abs=0.1)
    key = lambda df: df.agg(F.sum("value"), F.count("*")).first()
    assert key(synthetic.ar1_paths(models.repartition(3), 7)) == pytest.approx(key(synthetic.ar1_paths(models, 7)))
    series = some_series(spark, 3, 40)
    like = synthetic.like_first_period(series)
    assert like.count() == 120 and like.where("period = 1").count() == 60
    assert distribution.descriptive(like).count() == 3
