"""Closed forms and properties of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.functions import special
from riftline.operators import datasets, distribution, evaluation, grouped, regression, shape
from riftline.plans import features
from riftline.plans.model_queries import model_free_scores
from riftline.sources.series import from_arrays, planted_break, to_arrays, with_labels
from riftline.streaming.scorer import OUTPUT, online_cusum, score_stream

SCHEMA = "series_id long, t long, value double, period int"


def frame(spark, *series):
    """series: (values, boundary)."""
    rows = [(k, t, float(v) if v is not None else None, int(t >= b)) for k, (values, b) in enumerate(series) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    return df.collect()[0].asDict()


def test_constant_series_has_no_tests_but_distances(spark):
    s = frame(spark, ([5.0] * 40, 20))
    assert one(distribution.descriptive(s))["std_0"] == 0
    assert one(distribution.student_t(s))["t"] is None
    assert one(distribution.ecdf_distances(s))["wasserstein"] == 0
    assert one(shape.changepoint_cost(s))["gauss_improvement"] is None


def test_step(spark):
    s = frame(spark, ([0.0] * 20 + [1.0] * 20, 20))
    d = one(distribution.ecdf_distances(s))
    assert (d["ks"], d["wasserstein"]) == (1.0, 1.0)
    assert one(distribution.descriptive(s))["mean_diff"] == 1
    assert one(shape.binary_segmentation(s))["k"] == 20


def test_ramp_and_alternation(spark):
    s = frame(spark, (range(40), 20), ([(-1) ** k for k in range(40)], 20))
    vol = {r["series_id"]: r for r in shape.volatility(s).collect()}
    assert vol[0]["realized_0"] == 0
    entropy = {r["series_id"]: r for r in shape.permutation_entropy(s).collect()}
    assert entropy[0]["entropy_0"] == 0
    acf = shape.autocorrelation(s, 1).where("series_id = 1 AND period = 0").first()["acf"]
    assert acf == pytest.approx(-19 / 20)
    assert grouped.spectral(np.array([(-1.0) ** k for k in range(20)]), np.array([(-1.0) ** k for k in range(20)]))["dominant_0"] == 0.5


def test_shifted_copy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=30)
    s = frame(spark, ([*x, *(x + 3)], 30))
    assert one(distribution.ecdf_distances(s))["wasserstein"] == pytest.approx(3)
    assert one(distribution.levene(s))["w"] == pytest.approx(0, abs=1e-9)


def test_tiny_and_one_sided_series(spark):
    s = frame(spark, ([1, 2, 3, 4, 5, 7], 3), ([1.0, 2.0, 4.0], 3))
    for operator in (distribution.student_t, distribution.mann_whitney, distribution.ecdf_distances, regression.chow, regression.cusum, shape.volatility, shape.rolling_boundary, shape.permutation_entropy):
        operator(s).collect()
    assert {r["series_id"]: r["boundary"] for r in to_arrays(s).collect()} == {0: 3, 1: 3}


def test_arrays_round_trip_and_labels(spark):
    s = frame(spark, ([3.0, 1.0, 2.0], 2), ([5.0], 1))
    assert sorted(map(tuple, from_arrays(to_arrays(s)).collect())) == sorted(map(tuple, s.collect()))
    labelled = with_labels(s, spark.createDataFrame([(0, True)], "series_id long, has_break boolean"))
    assert {r["series_id"]: r["has_break"] for r in labelled.collect()} == {0: True, 1: None}


def test_autoregression_recovers_its_slope(spark):
    rng = np.random.default_rng(7)
    x = [0.0]
    for e in rng.normal(size=1999):
        x.append(0.7 * x[-1] + e)
    s = frame(spark, (x, 1000))
    assert one(regression.fits(s))["slope_full"] == pytest.approx(0.7, abs=0.05)
    assert abs(one(regression.cusum(s))["cusum_t"]) < 3
    beta, _ = grouped.least_squares(np.array(x), [1])
    assert one(regression.fits(s))["slope_full"] == pytest.approx(beta[1], abs=1e-9)
    assert grouped.pacf(np.array(x), 3)[1] == pytest.approx(0.7, abs=0.05)


def test_tails():
    assert special.student_two_sided(np.array([12.7062]), np.array([1.0]))[0] == pytest.approx(0.05, abs=1e-6)
    assert special.f_tail(np.array([4.0]), np.array([2.0]), np.array([30.0]))[0] == pytest.approx((1 + 8 / 30) ** -15, rel=1e-9)
    assert special.gamma_tail(np.array([1.0, 1.0]), np.array([0.5, 9.0])) == pytest.approx(np.exp([-0.5, -9.0]), rel=1e-9)
    assert 2 * special.normal_tail(np.array([1.959963984540054]))[0] == pytest.approx(0.05, abs=1e-12)


def test_grouped_operators_find_a_break():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=120), rng.normal(size=120) * 3 + 4
    assert grouped.epps_singleton(a, b)["es"] > 30
    assert grouped.synthetic_null(a, b)["mean_percentile"] > 0.99
    assert grouped.linear_autoencoder(a, b)["error_ratio"] > 2
    assert grouped.garch_break(a, b)["stability_lr"] > 5
    step = np.concatenate([np.zeros(30), np.ones(30)]) + rng.normal(size=60) * 0.05
    assert grouped.pelt_first(a, step)["break_at"] == 120 + 30
    assert grouped.mutual_information(np.sin(np.arange(200) / 5), 1) > 1 > grouped.mutual_information(a, 1)
    assert grouped.approximate_entropy(np.tile([0.0, 1.0], 50)) < grouped.approximate_entropy(a)
    assert 0 <= grouped.factor_break(a, b)["angle_max"] <= np.pi / 2 + 1e-9
    assert grouped.singular_spectrum(np.sin(np.arange(100) / 3), np.sin(np.arange(100, 200) / 3))["components"] <= 2


def test_windows(spark):
    arrays = to_arrays(frame(spark, (range(12), 6), (range(3), 2)))
    w = datasets.sliding_windows(arrays, 5, 3).collect()
    assert sorted((r["series_id"], r["window_start"], r["window"]) for r in w) == [(0, k, [float(x) for x in range(k, k + 5)]) for k in (0, 3, 6)]
    assert one(datasets.boundary_windows(arrays, 4))["window"] == [4.0, 5.0, 6.0, 7.0]


def test_perfect_scores(spark):
    s = spark.createDataFrame([(k, int(k >= 5), float(k)) for k in range(10)], "series_id long, label long, score double")
    assert one(evaluation.auc(s))["auc"] == 1
    assert {(r["label"], r["predicted"]): r["n"] for r in evaluation.confusion(s, 5.0).collect()} == {(0, 0): 5, (1, 1): 5}


def planted(spark, n=24):
    rng = np.random.default_rng(5)
    return planted_break(frame(spark, *[(rng.normal(50, 5, 40), 20) for _ in range(n)]), 25.0)


def test_model_separates_planted_breaks(spark):
    m = features.labelled(planted(spark), ("descriptive", "distances"))
    assert m.where(F.col("descriptive_mean_diff").isNull()).count() == 0
    scores = features.out_of_fold(m, 2, "forest", trees=10)
    assert all(r["auc"] > 0.9 for r in features.fold_auc(scores, 2).collect())


def test_stream_scores_each_series_once(spark, tmp_path):
    s = planted(spark, 6).drop("has_break")
    s.repartition(2, "series_id").write.parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "state"), model_free_scores).awaitTermination()
    got = {r["series_id"]: r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({r["series_id"]: r["score"] for r in model_free_scores(s).collect()})


def test_online_cusum_alarms_after_the_shift(spark, tmp_path):
    rng = np.random.default_rng(2)
    frame(spark, ([*rng.normal(size=60), *(rng.normal(size=20) + 6)], 60)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = online_cusum(stream).writeStream.outputMode("append").format("memory").queryName("alarms").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("alarms").orderBy("t").collect()
    assert OUTPUT.count(",") == 4 and not any(r["alarm"] for r in rows[:35]) and rows[-1]["alarm"]


def test_augmented_copies_keep_their_boundary_and_repeat(spark):
    s = frame(spark, (np.arange(60.0), 40), (np.arange(30.0), 30))
    for kind in ("shift", "subsample", "noise"):
        a = {k: [tuple(r) for r in datasets.augmented(s, kind, 1).where(F.col("series_id") == k).orderBy("t").collect()] for k in ("0_aug1", "1_aug1")}
        assert a["0_aug1"] == [tuple(r) for r in datasets.augmented(s, kind, 1).where("series_id = '0_aug1'").orderBy("t").collect()]
        periods = [r[3] for r in a["0_aug1"]]
        assert set(periods) == {0, 1} and periods == sorted(periods)
        assert [r[1] for r in a["0_aug1"]] == list(range(len(periods)))
        assert 0.6 * 60 <= len(periods) <= 60 and len(a["1_aug1"]) >= 18
    with pytest.raises(ValueError):
        datasets.augmented(s, "other")


def test_short_series_are_padded(spark):
    w = datasets.inference_windows(to_arrays(frame(spark, ([1.0, 2.0, 3.0], 2), ([], 0))), 5, 2).collect()
    assert [r["window"] for r in w] == [[1.0, 2.0, 3.0, 3.0, 3.0]]


def test_null_tests_bound_and_combine(spark):
    gains = spark.createDataFrame([(k, float(k), 0) for k in range(30)] + [(99, 1000.0, 1), (98, None, 1)], "series_id long, g double, label int")
    out = {r["series_id"]: r for r in features.null_tests(gains, ["g"]).collect()}
    assert out[99]["g_p"] == pytest.approx(1 / 31) and out[0]["g_p"] == 1
    assert out[99]["g_rank"] == 1 and out[98]["g_p"] is None
    assert out[99]["fisher_p"] == pytest.approx(1 / 31, rel=1e-3)
    few = features.null_tests(gains.where("series_id < 5"), ["g"]).collect()
    assert all(r["g_p"] is None for r in few)


def test_lag_regressions():
    rng = np.random.default_rng(3)
    x = np.zeros(400)
    for k in range(1, 400):
        x[k] = 0.8 * x[k - 1] + rng.normal()
    assert grouped.predictability(x[:200], x[200:])["r2"] > 0.4
    assert abs(grouped.huber_cusum(x[:200], x[200:])["huber_cusum"]) < 3
    assert abs(grouped.huber_cusum(x[:200], x[200:] + 8)["huber_cusum"]) > abs(grouped.huber_cusum(x[:200], x[200:])["huber_cusum"])
    wave = np.sin(2 * np.pi * np.arange(256) / 16)
    got = grouped.optimal_window(wave[:128], wave[128:])
    assert got["dominant"] == pytest.approx(1 / 16) and got["window"] == 32
    assert grouped.transforms(np.exp(rng.normal(size=200)), np.exp(rng.normal(size=200)))["jb_power"] < 20
    assert grouped.optimal_window(np.zeros(2), np.zeros(2)) == {} and grouped.transforms(np.ones(10), np.ones(10)) == {}
