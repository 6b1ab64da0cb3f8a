"""Embedded series against embeddings that are built, refits and direct transforms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riftline.operators import embedding, grouped, lagged


def made(spark, sizes=((70, 60), (45, 50), (12, 30), (3, 2)), seed=1):
    rng = np.random.default_rng(seed)
    rows, values = [], {}
    for k, (a, b) in enumerate(sizes):
        x = np.cumsum(rng.normal(size=a + b)) * 0.3 + rng.normal(size=a + b) + np.sin(np.arange(a + b)) * k
        values[k] = (x[:a], x[a:])
        rows += [(k, t, float(v), int(t >= a)) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id long, t long, value double, period int"), values


def test_factors_equal_those_of_built_embeddings(spark):
    series, values = made(spark, ((70, 60), (45, 50), (12, 30), (3, 2), (26, 39), (24, 31)))
    got = {r["series_id"]: r for r in embedding.factors(series).collect()}
    assert set(got) == set(values)
    for k, (a, b) in values.items():
        want = grouped.factor_break(a, b)
        for c in ("share_l1", "procrustes", "angle_max", "angle_mean", "share1_0", "share1_1"):
            if min(len(a), len(b)) >= 40:  # as many as the other one asks for
                assert got[k][c] == pytest.approx(want[c], abs=1e-6)
            assert (got[k][c] is None) == (min(len(a), len(b)) < 39)
        for m in embedding.SIZES:
            for p, x in enumerate((a, b)):
                assert (got[k][f"needed90_{p}_{m}"] is None) == (len(x) - m + 1 < (20 if m == 20 else 10))
                if len(x) - m + 1 >= 20:
                    s = np.cumsum(grouped.loadings(x, m)[1])
                    assert [got[k][f"needed{q}_{p}_{m}"] for q in (90, 95)] == [1 + np.searchsorted(s, q / 100) for q in (90, 95)]


def test_scan_of_windows(spark):
    series, values = made(spark)
    got = {r["series_id"]: r for r in embedding.factor_scan(series).collect()}
    for k, (a, b) in values.items():
        x = np.concatenate([a, b])
        found = []
        for s in range(0, len(x) - 20, 5):
            m = grouped.embedded(x[s : s + 20], 10)
            found.append(embedding.principal(np.cov(m.T))[0][:2])
        d = [np.linalg.norm(p - q) for p, q in zip(found[1:], found, strict=False)]
        if len(x) < 40:
            assert k not in got
            continue
        assert got[k]["stability"] == pytest.approx(np.mean(d)) and got[k]["evolution"] == pytest.approx(np.std(d))
        assert got[k]["location_score"] == pytest.approx(1 - abs(5 * (1 + int(np.argmax(d))) + 10 - len(a)) / (len(x) / 2))


@pytest.mark.parametrize("lags", [1, 3])
def test_scan_equals_a_fit_for_each_candidate(spark, lags):
    series, values = made(spark, ((40, 60), (30, 45)))
    got = {r["series_id"]: r for r in embedding.sup_f_lags(series, lags).collect()}
    for k, (a, b) in values.items():
        x = np.concatenate([a, b])
        d, y = grouped.design(x, list(range(1, lags + 1)))
        rss = lambda d, y: float(((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2).sum())
        n, n1, m = len(y), len(b), lags + 1
        best = (-1, 0)
        for i in range(n - n1 + int(n1 * 0.15), n - int(n1 * 0.15) + 1):
            if m < i < n - m:
                split = rss(d[:i], y[:i]) + rss(d[i:], y[i:])
                best = max(best, ((rss(d, y) - split) / m / (split / (n - 2 * m)), -i))
        assert got[k]["sup_f"] == pytest.approx(best[0]) and got[k]["k"] == -best[1]


def test_regressions_on_several_lags(spark):
    series, values = made(spark)
    got = {r["series_id"]: r for r in lagged.fits(series, (1, 2, 4)).collect()}
    for k, (a, b) in values.items():
        for name, x in (("0", a), ("1", b), ("full", np.concatenate([a, b]))):
            if len(x) > 12:
                beta, e = grouped.least_squares(x, [1, 2, 4])
                assert got[k][f"beta_{name}"] == pytest.approx(beta[1:].tolist()) and got[k][f"intercept_{name}"] == pytest.approx(beta[0]) and got[k][f"rss_{name}"] == pytest.approx(float(e @ e))
    flat = series.withColumn("value", F.lit(2.0))
    assert all(r["rss_full"] == 0 and r["beta_full"] == [0.0, 0.0] for r in lagged.fits(flat, (1, 2)).collect() if r["n_full"] > 0)


def test_adaptive_lags_and_tests(spark):
    series, values = made(spark, ((120, 90), (60, 70), (20, 6)))
    lags = {r["series_id"]: r["lags"] for r in lagged.adaptive_lags(series).collect()}
    tested = {r["series_id"]: r for r in lagged.adaptive(series, lagged.cusum).collect()}
    for k, (a, b) in values.items():
        want = grouped.adaptive_tests(a, b)
        assert lags[k] == tested[k]["lags"]
        if len(a) + len(b) >= 30:
            assert lags[k] == want["lags"]
        if "cusum_t" in want:
            assert tested[k]["cusum_t"] == pytest.approx(want["cusum_t"]) and tested[k]["cusumsq_z"] == pytest.approx(want["cusumsq_z"])


def test_partial_autocorrelations_of_a_long_series(spark):
    x = np.random.default_rng(3).normal(size=5000).cumsum() * 0.01 + np.random.default_rng(4).normal(size=5000)
    series = spark.createDataFrame([(1, t, float(v), 0) for t, v in enumerate(x)], "series_id long, t long, value double, period int")
    got = {r["lag"]: r["pacf"] for r in lagged.partial(series, 40, adjusted=False).collect()}
    assert [got[k] for k in range(1, 41)] == pytest.approx(grouped.pacf(x, 40)[1:].tolist())


def test_spectrum_of_segments(spark):
    series, values = made(spark, ((150, 70), (64, 63)))
    rows = {(r["series_id"], r["period"], r["k"]): r["power"] for r in embedding.segment_spectrum(series).collect()}
    for k, periods in values.items():
        for p, x in enumerate(periods):
            x = x - x.mean()
            parts = [x[s : s + 64] for s in range(0, len(x) - 63, 64)]
            if not parts:
                assert (k, p, 1) not in rows
                continue
            want = np.mean([np.abs(np.fft.rfft(q)) ** 2 / 64 for q in parts], axis=0)[1:]
            assert [rows[k, p, j] for j in range(1, 33)] == pytest.approx(want.tolist())


def test_factors_of_a_batch_share_their_eigenvector_calls(monkeypatch):
    """One call for each size and period of a batch (one for each series before), with the numbers of embeddings that are built."""
    calls, principal = [], embedding.principal
    monkeypatch.setattr(embedding, "principal", lambda m: calls.append(m.shape) or principal(m))
    rng = np.random.default_rng(6)
    rows, series = [], []
    for n0, n1 in ((60, 45), (39, 40), (25, 70), (19, 12), (41, 0), (50, 50)):
        row, both = {}, []
        for p, n in ((0, n0), (1, n1)):
            x = rng.normal(size=n).cumsum()
            x = x - x.mean() if n else x
            both.append(x)
            row |= {f"n{p}": float(n) if n else np.nan, f"products{p}": np.array([(x[: n - d] * x[d:]).sum() for d in range(min(20, n))]) if n else None, f"first{p}": x[:40] if n else None, f"last{p}": x[-20:] if n else None}
        rows.append(row)
        series.append(both)
    got = embedding._factor_numbers(pd.DataFrame(rows))
    assert len(calls) <= 2 * len(embedding.SIZES) and list(got.columns) == embedding.FACTOR_COLUMNS
    for k, both in enumerate(series):
        for p, x in enumerate(both):
            for m in embedding.SIZES:
                if len(x) - m + 1 < (20 if m == 20 else 10):
                    assert np.isnan(got.loc[k, f"needed90_{p}_{m}"])
                    continue
                e = np.lib.stride_tricks.sliding_window_view(x, m)
                values = np.linalg.eigvalsh(np.corrcoef(e.T))[::-1]
                shares = values / values.sum()
                assert got.loc[k, f"needed90_{p}_{m}"] == 1 + np.searchsorted(np.cumsum(shares), 0.9)
                if m == 20 and min(map(len, both)) >= 39:
                    assert np.allclose([got.loc[k, f"share{i}_{p}"] for i in (1, 2, 3)], shares[:3], atol=1e-6)
        assert np.isnan(got.loc[k, "procrustes"]) == (min(map(len, both)) < 39)
    assert embedding._factor_numbers(pd.DataFrame(rows).iloc[:0]).empty
