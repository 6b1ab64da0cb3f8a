"""Profiles, evidence and windows on small series whose results are known."""

import numpy as np
from pyspark.sql import functions as F

from riftline.operators import datasets, evidence, profiles
from riftline.sources.series import to_arrays

SCHEMA = "series_id long, t long, value double, period int, has_break boolean"


def made(spark, series):
    rows = [(i, t, float(x), int(t >= b), flag) for i, (values, b, flag) in series.items() for t, x in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_a_jump_is_evident_and_noise_is_not(spark):
    g = np.random.default_rng(1)
    noise = g.normal(size=120)
    out = {r["series_id"]: r for r in evidence.segment_models(made(spark, {1: (noise + 8 * (np.arange(120) >= 60), 60, True), 2: (noise, 60, False), 3: (noise[:12], 6, False), 4: ([1.0] * 40, 20, False)})).collect()}
    assert out[1]["max"] == 0.99 and out[2]["mean"] < 0.5 and out[3]["max"] == 0.0
    assert all(0 <= out[k][c] <= 0.99 for k in out for c in ("max", "average", "weighted"))


def test_evidence_of_short_constant_and_one_sided_series(spark):
    rows = {r["series_id"]: r for r in evidence.evidence(made(spark, {1: ([1.0] * 60, 30, False), 2: ([1.0, 2.0] * 5, 5, False), 3: (list(range(40)), 40, False)})).collect()}
    assert rows[2]["evidence"] == 0.05
    assert rows[3]["evidence"] == 0.0
    assert rows[1]["location_scale"] == rows[1]["extremes"] == 0.0


def test_block_effects_against_a_loop(spark):
    v = np.random.default_rng(2).normal(size=100) * (1 + (np.arange(100) >= 47))
    got = {r["size"]: r for r in profiles.block_effects(made(spark, {7: (v, 47, True)})).collect()}
    for size in (5, 10):
        spread = np.array([v[k * size : (k + 1) * size].std() for k in range(100 // size)])
        a, b = spread[: 47 // size], spread[47 // size :]
        pooled = (len(a) * a.var() + len(b) * b.var()) / (len(a) + len(b) - 2)
        assert np.isclose(got[size]["t"], (a.mean() - b.mean()) / np.sqrt(pooled * (1 / len(a) + 1 / len(b))))
        assert np.isclose(got[size]["effect"], abs(b.mean() - a.mean()) / np.sqrt((a.var() + b.var()) / 2))


def test_balanced_windows_without_breaks_and_with_too_few_others(spark):
    schema = "series_id string, window_start long, break_position long"
    rows = [("a", k, None) for k in range(20)]
    assert datasets.balanced_windows(spark.createDataFrame(rows, schema)).count() == 0
    assert datasets.balanced_windows(spark.createDataFrame([*rows, *[("b", k, 5) for k in range(3)]], schema)).count() == 3 + 7
    assert datasets.balanced_windows(spark.createDataFrame([*rows, *[("b", k, 5) for k in range(30)]], schema)).count() == 30 + 20


def test_position_encodings_and_copies(spark):
    w = datasets.sliding_windows(to_arrays(made(spark, {1: ([3.0, 4.0, 5.0, 6.0], 2, False)})), 4, 1)
    assert [(r["i"], r["place"], r["value"]) for r in datasets.position_encodings(w).orderBy("i").collect()] == [(0, 0.0, 3.0), (1, 0.25, 4.0), (2, 0.5, 5.0), (3, 0.75, 6.0)]
    f = spark.createDataFrame([(1, None, 2.0), (2, 3.0, 4.0)], "series_id int, a double, b double")
    assert [r["a"] for r in datasets.without_copies(f, {"b": "a"}).orderBy("series_id").collect()] == [2.0, 3.0]


def test_empty_table(spark):
    none = made(spark, {1: ([1.0], 1, False)}).where("t < 0")
    for operator in (evidence.segment_models, evidence.evidence, profiles.lag_profile, profiles.normality, profiles.block_effects, profiles.accepted_split):
        assert operator(none).count() == 0
    assert profiles.decay_comparison(none).where(F.col("breaks").isNotNull()).count() == 0
