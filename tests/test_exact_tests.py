"""Exact p-values against enumeration, and tests of normality against naive computations and published figures."""

import itertools
import math
import tracemalloc
from statistics import NormalDist

import numpy as np
import pytest

from riftline.functions import special
from riftline.operators import grouped, lagged, normality


def mixed(n, m):
    for chosen in itertools.combinations(range(n + m), n):
        yield [k for k in range(n + m) if k in chosen], [k for k in range(n + m) if k not in chosen]


def ks(x, y):
    return max(abs(sum(v <= z for v in x) / len(x) - sum(v <= z for v in y) / len(y)) for z in x + y)


def cvm(x, y):
    n, m, z = len(x), len(y), sorted(x + y)
    u = sum(f * sum((z.index(v) - i) ** 2 for i, v in enumerate(s)) for f, s in ((n, x), (m, y)))
    return u / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m))


@pytest.mark.parametrize(("n", "m"), [(2, 2), (3, 5), (4, 4), (6, 3), (1, 7)])
def test_equal_to_enumeration(n, m):
    each = list(mixed(n, m))
    for of, p in ((ks, special.kolmogorov_exact), (cvm, special.cramer_von_mises_exact)):
        values = [of(x, y) for x, y in each]
        for t in sorted(set(values)):
            assert p(t, n, m) == pytest.approx(sum(v >= t - 1e-9 for v in values) / len(values), abs=1e-9)


def test_exact_and_limiting_forms_agree():
    assert special.kolmogorov_exact(0.1, 400, 300) == pytest.approx(float(special.kolmogorov_tail(np.array([0.1]), np.array([400.0]), np.array([300.0]))[0]), abs=0.01)
    for t in (0.05, 0.2, 0.461, 0.743):
        assert special.cramer_von_mises_exact(t, 14, 15) == pytest.approx(special.cramer_von_mises_tail(t, 14, 15), abs=0.02)
    # published 5 % and 1 % points of the limiting distribution
    assert special.cramer_von_mises_tail(0.46136, 10**6, 10**6) == pytest.approx(0.05, abs=2e-4)
    assert special.cramer_von_mises_tail(0.74346, 10**6, 10**6) == pytest.approx(0.01, abs=1e-4)


WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # published example: W 0.79, p below 0.01


def anderson(x):
    x = sorted(x)
    n, z = len(x), (np.array(x) - np.mean(x)) / np.std(x, ddof=1)
    f = [NormalDist().cdf(v) for v in z]
    return -n - sum((2 * i + 1) * (math.log(f[i]) + math.log(1 - f[n - 1 - i])) for i in range(n)) / n


def test_normality(spark):
    rng = np.random.default_rng(2)
    samples = {0: WEIGHTS, 1: rng.normal(size=200).tolist(), 2: rng.exponential(size=200).tolist(), 3: [1.0, 2.0, 4.0], 4: [5.0] * 30, 5: [1.0, 2.0], 6: [1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 9.0], 7: rng.normal(size=5).tolist()}
    rows = [(k, t, float(v), 0) for k, x in samples.items() for t, v in enumerate(x)]
    got = {r["series_id"]: r for r in normality.tests(spark.createDataFrame(rows, "series_id long, t long, value double, period int")).collect()}
    assert set(got) == {0, 1, 2, 3, 6, 7}
    assert got[0]["shapiro_w"] == pytest.approx(0.7888, abs=2e-4) and got[0]["shapiro_p"] == pytest.approx(0.0067, abs=2e-4)
    assert got[1]["shapiro_p"] > 0.05 > 1e-6 > got[2]["shapiro_p"] and got[1]["ad_p"] > 0.05 > 1e-6 > got[2]["ad_p"]
    assert got[3]["shapiro_w"] == pytest.approx((4 - 1) ** 2 / 2 / sum((v - 7 / 3) ** 2 for v in (1, 2, 4))) and got[3]["ad_p"] is None
    for k, r in got.items():
        assert r["ad"] == pytest.approx(anderson(samples[k])) and 0 < r["shapiro_w"] <= 1 and 0 <= r["shapiro_p"] <= 1


def test_size_of_the_tests(spark):
    """Of 400 normal samples about one in twenty is rejected at 5 %."""
    x = np.random.default_rng(7).normal(size=(400, 25))
    df = spark.createDataFrame([(k, t, float(v), 0) for k, row in enumerate(x) for t, v in enumerate(row)], "series_id long, t long, value double, period int")
    got = normality.tests(df).toPandas()
    assert 0.02 < (got["shapiro_p"] < 0.05).mean() < 0.09 and 0.02 < (got["ad_p"] < 0.05).mean() < 0.09


def test_lags_that_are_almost_equal_keep_their_digits(spark):
    """A series of values repeated 60 times: residuals are right to the last digits, as a direct fit on exact differences has them."""
    v = np.repeat(np.round(np.random.default_rng(5).gamma(2, 40, size=60), 2), 60)
    s = spark.createDataFrame([(1, t, float(x), int(t >= 2400)) for t, x in enumerate(v)], "series_id long, t long, value double, period int")
    e = {r["t"]: r["value"] for r in lagged.period_residuals(s, (1, 2, 3, 4, 5)).collect()}
    for a, b in ((0, 2400), (2400, 3600)):
        w = v[a:b]
        x = np.column_stack([w[5 - j : len(w) - j] for j in range(6)]) * 100
        d = np.column_stack([x[:, :-1] - x[:, 1:], x[:, -1]]) / 100  # whole hundredths, so differences are right to the last digit
        d = d - d.mean(0)
        exact = d[:, 0] - d[:, 1:] @ np.linalg.lstsq(d[:, 1:], d[:, 0], rcond=None)[0]
        got = np.array([e[t] for t in range(a + 5, b)])
        assert np.abs(got - exact).max() < 2e-13


def peak_mb(function, *series):
    tracemalloc.start()
    got = function(*series)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return got, peak


def test_autoencoder_in_blocks():
    """The same numbers as with all windows at once, in memory that grows with the values, not with the windows."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(50, 3, size=400_000).cumsum() % 97, rng.normal(size=150_000)
    got, peak = peak_mb(grouped.linear_autoencoder, a, b)
    assert peak < 60
    train = np.lib.stride_tricks.sliding_window_view(a[:280_000], 16)
    m, s = train.mean(), train.std() + 1e-8
    centre = ((train - m) / s).mean(0)
    v = np.linalg.eigh(np.cov((train - m).T / s))[1][:, -4:]
    for k, x in ((0, a[280_000:]), (1, b)):
        z = (np.lib.stride_tricks.sliding_window_view(x, 16) - m) / s - centre
        back = z @ v @ v.T
        assert np.isclose(got[f"error_{k}"], ((z - back) ** 2).mean()) and np.isclose(got[f"correlation_{k}"], np.corrcoef(z.ravel(), back.ravel())[0, 1])


def test_autoregression_in_blocks():
    rng = np.random.default_rng(6)
    x = np.convolve(rng.normal(size=700_005), [1, 0.6, 0.3, 0.2, 0.1, 0.05], "valid")
    got, peak = peak_mb(grouped.predictability, x[:500_000], x[500_000:])
    assert peak < 45
    a = np.column_stack([np.ones(len(x) - 6), *(x[6 - k : len(x) - k] for k in range(1, 7))])
    ends, y, scores = np.linspace(0, len(x) - 6, 7).astype(int), x[6:], []
    for low, high in zip(ends[1:-1], ends[2:], strict=True):
        e = y[low:high] - a[low:high] @ np.linalg.lstsq(a[:low], y[:low], rcond=None)[0]
        scores.append(1 - e @ e / ((y[low:high] - y[low:high].mean()) ** 2).sum())
    assert np.isclose(got["r2"], np.mean(scores))


def test_tail_evaluates_only_terms_that_count(monkeypatch):
    """The limiting Cramer-von Mises tail with three or so of its 60 terms, to the last digit of the sum of all; lattice paths are counted once for each pair of sizes."""
    asked, bessel = [], special._bessel_quarter
    monkeypatch.setattr(special, "_bessel_quarter", lambda z: asked.append(np.size(z)) or bessel(z))
    u = np.linspace(0, 12, 6001)
    weight = np.where((u == 0) | (u == u[-1]), 0.5, 1.0) * u[1] * np.cosh(u / 4)
    for t, n, m in ((0.05, 45, 22), (0.2, 30, 50), (1.3, 45, 22), (9.0, 21, 400)):
        total, k = n + m, n * m
        variance = (total + 1) * (4 * k * total - 3 * (n**2 + m**2) - 2 * k) / (45 * total**2 * 4 * k)
        x = 1 / 6 + (t - (1 + 1 / total) / 6) / math.sqrt(45 * variance)
        want = 0.0
        for j in range(60):
            y = (4 * j + 1) ** 2 / (16 * x)
            want += math.exp(math.lgamma(j + 0.5) - math.lgamma(j + 1)) / math.sqrt(math.pi) * math.sqrt(4 * j + 1) * math.exp(-2 * y) * float((np.exp(-y * (np.cosh(u) - 1)) * weight).sum())
        want = min(1.0, max(0.0, 1 - want / (math.pi * math.sqrt(x))))
        assert special.cramer_von_mises_tail(t, n, m) == pytest.approx(want, abs=1e-14)
    assert max(asked[:2]) <= 4 and max(asked) <= 30
    special.cramer_von_mises_exact(0.3, 9, 8)
    before = special._squared_gaps.cache_info().misses
    special.cramer_von_mises_exact(0.4, 9, 8)
    assert special._squared_gaps.cache_info().misses == before
