"""Operators that need transforms or linear algebra: a grouped map over series, NumPy within a series.

Each function takes a series' values before and after the boundary, in order, and gives named numbers; a number
that can't be had is null.  A series is one task's group; its length, not the number of series, bounds memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Numbers = dict[str, float]
#: Windows or rows of lags that are made at a time where sums of them are enough.
BLOCK = 65_536
#: Variances of a grid of models that are held at a time.
GRID_VALUES = 1_000_000


def per_series(series: DataFrame, function: Callable[[np.ndarray, np.ndarray], Numbers], names: list[str]) -> DataFrame:
    """One row per series with the numbers that ``function`` gives under ``names``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        value, after = rows["value"].to_numpy(float), rows["period"].to_numpy() == 1
        with np.errstate(all="ignore"):
            got = function(value[~after], value[after])
        numbers = [float(got.get(n, np.nan)) for n in names]
        return pd.DataFrame([[key[0], *[x if np.isfinite(x) else None for x in numbers]]], columns=["series_id", *names])

    kind = series.schema["series_id"].dataType.simpleString()
    return series.groupBy("series_id").applyInPandas(run, f"series_id {kind}, " + ", ".join(f"{n} double" for n in names))


# --- spectra ------------------------------------------------------------------------------------------------------
def periodogram(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of the centred series at frequencies from 0 to a half."""
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)
    p[1 : (len(x) + 1) // 2] *= 2
    return np.fft.rfftfreq(len(x)), p


SPECTRAL = [f"{n}_{k}" for k in (0, 1) for n in ("centroid", "rolloff", "bandwidth", "dominant")] + ["centroid_diff", "bandwidth_diff", "dominant_diff", "spectral_l2", "spectral_kl"]


def spectral(before: np.ndarray, after: np.ndarray, rolloff: float = 0.85) -> Numbers:
    out: Numbers = {}
    spectra = []
    for k, x in ((0, before), (1, after)):
        if len(x) < 4:
            return {n: 0.0 for n in SPECTRAL}
        f, p = periodogram(x)
        total = p.sum() + 1e-8
        centre = (f * p).sum() / total
        out |= {f"centroid_{k}": centre, f"bandwidth_{k}": np.sqrt(((f - centre) ** 2 * p).sum() / total), f"dominant_{k}": f[p.argmax()]}
        out[f"rolloff_{k}"] = f[min(np.searchsorted(np.cumsum(p), rolloff * p.sum()), len(f) - 1)]
        spectra.append((f, p))
    grid = np.linspace(0, min(f[-1] for f, _ in spectra), min(len(f) for f, _ in spectra))
    a, b = (np.interp(grid, f, p) for f, p in spectra)
    out |= {f"{n}_diff": out[f"{n}_1"] - out[f"{n}_0"] for n in ("centroid", "bandwidth", "dominant")}
    return out | {"spectral_l2": np.sqrt(((b - a) ** 2).sum()), "spectral_kl": (b * np.log((b + 1e-8) / (a + 1e-8))).sum()}


# --- partial autocorrelation and general autoregressions -------------------------------------------------------------
def acf(x: np.ndarray, lags: int) -> np.ndarray:
    d = x - x.mean()
    return np.array([(d[: len(d) - k] * d[k:]).sum() for k in range(lags + 1)]) / (d @ d)


def pacf(x: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations at lags 0..lags by the Durbin-Levinson recursion."""
    r = acf(x, lags)
    out, phi = [1.0], np.zeros(0)
    for k in range(1, lags + 1):
        a = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.append(phi - a * phi[::-1], a)
        out.append(a)
    return np.array(out)


PACF_LAGS = 10
PACF = [f"pacf{k}_{p}" for p in (0, 1) for k in range(1, PACF_LAGS + 1)] + ["pacf_l2", "pacf_l1"]


def pacf_profile(before: np.ndarray, after: np.ndarray) -> Numbers:
    both = [pacf(x, PACF_LAGS) if len(x) > 2 * PACF_LAGS else np.full(PACF_LAGS + 1, np.nan) for x in (before, after)]
    d = both[1] - both[0]
    return {f"pacf{k}_{p}": both[p][k] for p in (0, 1) for k in range(1, PACF_LAGS + 1)} | {"pacf_l2": np.sqrt((d**2).sum()), "pacf_l1": np.abs(d).sum()}


def significant_lags(x: np.ndarray, most: int = 15) -> list[int]:
    """Lags whose partial autocorrelation lies outside the white-noise band, up to ``most``."""
    top = min(most, len(x) // 2 - 1)
    return (1 + np.flatnonzero(np.abs(pacf(x, top)[1:]) > 1.959964 / np.sqrt(len(x)))).tolist() if top >= 1 else []


def design(x: np.ndarray, lags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    top = max(lags)
    return np.column_stack([np.ones(len(x) - top), *(x[top - k : len(x) - k] for k in lags)]), x[top:]


def least_squares(x: np.ndarray, lags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residuals of the regression on these lags."""
    a, y = design(x, lags)
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    return beta, y - a @ beta


ADAPTIVE = ["lags", "cusum_t", "cusumsq_z", "chow_f"]


def adaptive_tests(before: np.ndarray, after: np.ndarray, most: int = 15) -> Numbers:
    """CUSUM and Chow statistics with as many lags as are significant before and after together."""
    x = np.concatenate([before, after])
    n_lags = max(1, min(len(significant_lags(x, most)), most)) if len(x) >= 2 * most else max(1, min(3, len(x) // 4))
    lags = list(range(1, n_lags + 1))
    if min(len(before), len(after)) < 2 * n_lags + 2:
        return {"lags": n_lags}
    _, e = least_squares(x, lags)
    n, k, m = len(e), len(before) - n_lags, n_lags + 1
    rss, u = e @ e, k / n
    split = sum((lambda r: r @ r)(least_squares(s, lags)[1]) for s in (before, after))
    d2 = len(before) + len(after) - 2 * n_lags - 2 * m
    return {
        "lags": n_lags,
        "cusum_t": e[:k].sum() / (np.sqrt(rss / (n - m)) * np.sqrt(n * u * (1 - u))),
        "cusumsq_z": ((e[:k] ** 2).sum() / rss - u) / np.sqrt(2 * u * (1 - u) / (n + 2)),
        "chow_f": ((rss - split) / m) / (split / d2) if d2 > 0 and rss > split else np.nan,
    }


# --- factors --------------------------------------------------------------------------------------------------------
def embedded(x: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)


def loadings(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal directions (rows, largest entry positive) of the standardised embedding and their shares of variance."""
    m = embedded(x, size)
    z = (m - m.mean(0)) / (m.std(0) + 1e-8)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return v, s**2 / (s**2).sum()


FACTOR = ["share1_0", "share1_1", "share_l1", "procrustes", "angle_max", "angle_mean", "needed95_0", "needed95_1"]


def factor_break(before: np.ndarray, after: np.ndarray, size: int = 20, factors: int = 3) -> Numbers:
    if min(len(before), len(after)) < 2 * size:
        return {}
    (v0, s0), (v1, s1) = loadings(before, size), loadings(after, size)
    a, b = v0[:factors], v1[:factors]
    u, _, w = np.linalg.svd(b @ a.T)
    angles = np.arccos(np.clip(np.linalg.svd(a @ b.T)[1], -1, 1))
    return {"share1_0": s0[0], "share1_1": s1[0], "share_l1": np.abs(s0[:factors] - s1[:factors]).sum(), "procrustes": np.linalg.norm((u @ w).T @ b - a), "angle_max": angles.max(), "angle_mean": angles.mean(), "needed95_0": 1 + np.searchsorted(np.cumsum(s0), 0.95), "needed95_1": 1 + np.searchsorted(np.cumsum(s1), 0.95)}


SSA = ["window", "components", "explained"]


def singular_spectrum(before: np.ndarray, after: np.ndarray, share: float = 0.9) -> Numbers:
    """Trajectory matrix of a quarter's length: components that explain ``share`` of it."""
    x = np.concatenate([before, after])
    size = max(2, min(50, len(x) // 4))
    s = np.linalg.svd(embedded(x - x.mean(), size), compute_uv=False) ** 2
    c = np.cumsum(s) / s.sum()
    k = int(np.searchsorted(c, share))
    return {"window": size, "components": k + 1, "explained": c[min(k, len(c) - 1)]}


# --- information ----------------------------------------------------------------------------------------------------
def approximate_entropy(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> float:
    """Mean log share of matching templates of length m less that of m + 1, within tolerance deviations."""

    def phi(k: int) -> float:
        w = embedded(x, k)
        near = np.array([(np.abs(w - row).max(axis=1) <= tolerance * x.std()).mean() for row in w])
        return np.log(near).mean()

    return phi(m) - phi(m + 1) if len(x) > m + 2 and x.std() > 0 else np.nan


def entropy_change(before: np.ndarray, after: np.ndarray) -> Numbers:
    a, b = approximate_entropy(before), approximate_entropy(after)
    return {"apen_0": a, "apen_1": b, "apen_diff": b - a}


def _digamma(n: np.ndarray) -> np.ndarray:
    table = np.concatenate([[-0.5772156649015329], -0.5772156649015329 + np.cumsum(1 / np.arange(1, int(n.max()) + 1))])
    return table[n.astype(int) - 1]


def mutual_information(x: np.ndarray, lag: int, k: int = 3) -> float:
    """Nearest-neighbour estimate of the information between values and their lags, at least 0."""
    if len(x) < lag + k + 2:
        return np.nan
    a, b = x[:-lag], x[lag:]
    da, db = np.abs(a[:, None] - a[None]), np.abs(b[:, None] - b[None])
    joint = np.maximum(da, db)
    np.fill_diagonal(joint, np.inf)
    radius = np.sort(joint, axis=1)[:, k - 1]
    na, nb = (np.maximum((d < radius[:, None]).sum(1), 1) for d in (da, db))
    n = np.array([len(a), k])
    return max(0.0, float(_digamma(n).sum() - (_digamma(na) + _digamma(nb)).mean()))


MI = [f"mi{lag}_{p}" for p in (0, 1) for lag in (1, 2, 5)]


def information(before: np.ndarray, after: np.ndarray) -> Numbers:
    return {f"mi{lag}_{p}": mutual_information(x, lag) for p, x in ((0, before), (1, after)) for lag in (1, 2, 5)}


# --- search for breaks ------------------------------------------------------------------------------------------------
def pelt_first(before: np.ndarray, after: np.ndarray, penalty: float = 3.0, least: int = 2) -> Numbers:
    """First of the least-squares breakpoints of the standardised second period, by pruned dynamic programming."""
    x = (after - after.mean()) / (after.std() or 1)
    n = len(x)
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x**2)])
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i)
    best, last, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for j in range(least, n + 1):
        starts = np.array([i for i in open_ if j - i >= least])
        totals = best[starts] + cost(starts, j) + penalty
        best[j], last[j] = totals.min(), starts[totals.argmin()]
        open_ = [i for i in open_ if j - i < least or best[i] + cost(i, j) <= best[j]] + [j]
    first, at = n, n
    while last[at] > 0:
        first = at = last[at]
    return {"break_at": len(before) + first, "segments_cost": best[n]}


# --- characteristic functions and volatility models -------------------------------------------------------------------
def epps_singleton(before: np.ndarray, after: np.ndarray, points: tuple[float, ...] = (0.4, 0.8)) -> Numbers:
    """Statistic of the distance between empirical characteristic functions, chi-square with four degrees of freedom."""
    if min(len(before), len(after)) < 8:
        return {}
    scale = np.subtract(*np.percentile(np.concatenate([before, after]), [75, 25])) / 2
    if scale <= 0:
        return {}
    g = [np.column_stack([f(np.outer(x, np.array(points) / scale)) for f in (np.cos, np.sin)]) for x in (before, after)]
    n0, n1 = len(before), len(after)
    n = n0 + n1
    cov = n * (np.cov(g[0].T, bias=True) / n0 + np.cov(g[1].T, bias=True) / n1)
    d = g[0].mean(0) - g[1].mean(0)
    w = n * d @ np.linalg.pinv(cov) @ d
    if max(n0, n1) < 25:
        w *= 1 / (1 + (n0 + n1) ** -0.45 + 10.1 * (n0**-1.7 + n1**-1.7))
    return {"es": w}


def garch_likelihoods(e: np.ndarray, v: float, grid: list[tuple[float, float]]) -> np.ndarray:
    """Log likelihoods of GARCH(1, 1) on deviations e of variance v, for all (alpha, beta) of the grid at once.

    One step in time serves the whole grid; variances are kept for about GRID_VALUES numbers at a time.
    """
    alpha, beta = np.array(grid).T
    squares, omega = e**2, (1 - alpha - beta) * v
    h, total, block = np.full(len(alpha), v), np.zeros(len(alpha)), max(1, GRID_VALUES // len(alpha))
    for at in range(0, len(squares), block):
        part = squares[at : at + block]
        variances = np.empty((len(part), len(alpha)))
        shocks = omega + np.multiply.outer(part, alpha)
        for k in range(len(part)):
            variances[k] = h
            h = shocks[k] + beta * h
        losses = 0.5 * (np.log(2 * np.pi * variances) + part[:, None] / variances)
        total = np.subtract.reduce(np.concatenate([total[None], losses]), axis=0)
    return total


def garch_fit(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(omega, alpha, beta) of the best GARCH(1, 1) on a refined grid, and its log likelihood."""
    e = x - x.mean()
    v = e.var()
    best, step, centre = (-np.inf, 0.05, 0.8), 0.2, (0.25, 0.5)
    for _ in range(4):
        grid = [(a, b) for a in centre[0] + step * np.arange(-2, 3) / 2 for b in centre[1] + step * np.arange(-2, 3) if 0 <= a and 0 <= b and a + b < 0.999]
        best = max([best, *((l, a, b) for l, (a, b) in zip(garch_likelihoods(e, v, grid), grid, strict=True))])
        centre, step = best[1:], step / 3
    return np.array([(1 - best[1] - best[2]) * v, best[1], best[2]]), best[0]


GARCH = [f"{n}_{p}" for p in (0, 1) for n in ("omega", "alpha", "beta")] + ["stability_lr"]


def garch_break(before: np.ndarray, after: np.ndarray) -> Numbers:
    """GARCH(1, 1) parameters by period and the likelihood ratio of separate against common parameters."""
    if len(before) + len(after) < 50 or min(len(before), len(after)) < 20 or min(before.std(), after.std()) == 0:
        return {}
    (p0, l0), (p1, l1) = garch_fit(before), garch_fit(after)
    _, l_ = garch_fit(np.concatenate([before, after]))
    names = ("omega", "alpha", "beta")
    return {f"{n}_{k}": v for k, p in ((0, p0), (1, p1)) for n, v in zip(names, p, strict=True)} | {"stability_lr": max(0.0, 2 * (l0 + l1 - l_))}


NULLS = ["mean_percentile", "std_percentile", "mean_z", "std_z"]


def synthetic_null(before: np.ndarray, after: np.ndarray, draws: int = 200) -> Numbers:
    """Where the second period's mean and spread lie among continuations simulated from an AR(1) of the first."""
    if len(before) < 10 or len(after) < 5 or before.std() == 0:
        return {}
    beta, e = least_squares(before, [1])
    rng = np.random.default_rng(len(before) * 1_000_003 + len(after))
    shocks = rng.choice(e, size=(draws, len(after)))
    level, path = np.full(draws, before[-1]), np.empty((draws, len(after)))
    for k in range(len(after)):
        level = path[:, k] = beta[0] + np.clip(beta[1], -0.999, 0.999) * level + shocks[:, k]
    means, spreads = path.mean(1), path.std(1)
    return {"mean_percentile": (means <= after.mean()).mean(), "std_percentile": (spreads <= after.std()).mean(), "mean_z": (after.mean() - means.mean()) / means.std(), "std_z": (after.std() - spreads.mean()) / spreads.std()}


AUTOENCODER = ["error_0", "error_1", "error_ratio", "error_diff", "correlation_0", "correlation_1"]


def linear_autoencoder(before: np.ndarray, after: np.ndarray, window: int = 16, width: int = 4, share: float = 0.7) -> Numbers:
    """Reconstruction by the principal components of the first period's windows: errors on the rest of it and after."""
    cut = int(len(before) * share)
    if cut < 2 * window or len(before) - cut < window or len(after) < window:
        return {}
    train = embedded(before[:cut], window)
    mean = train.mean()
    scale = np.sqrt(sum(((train[at : at + BLOCK] - mean) ** 2).sum() for at in range(0, len(train), BLOCK)) / train.size) + 1e-8
    centre = (train.mean(0) - mean) / scale

    def standard(x: np.ndarray):
        w = embedded(x, window)
        return ((w[at : at + BLOCK] - mean) / scale - centre for at in range(0, len(w), BLOCK))

    v = np.linalg.eigh(sum(z.T @ z for z in standard(before[:cut])))[1].T[::-1][:width]

    def measured(x: np.ndarray) -> tuple[float, float]:
        n, error, sums, products = 0, 0.0, np.zeros(2), np.zeros((2, 2))
        for z in standard(x):
            back = z @ v.T @ v
            both = np.stack([z.ravel(), back.ravel()])
            n, error, sums, products = n + z.size, error + ((z - back) ** 2).sum(), sums + both.sum(1), products + both @ both.T
        c = products / n - np.outer(sums, sums) / n**2
        return error / n, c[0, 1] / np.sqrt(c[0, 0] * c[1, 1])

    (e0, c0), (e1, c1) = measured(before[cut:]), measured(after)
    return {"error_0": e0, "error_1": e1, "error_ratio": e1 / (e0 + 1e-8), "error_diff": e1 - e0, "correlation_0": c0, "correlation_1": c1}


# --- regressions on lags ------------------------------------------------------------------------------------------
def _quadratic(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags 1..lags with their squares, standardised, beside a constant; and what follows them."""
    a, y = design(x, list(range(1, lags + 1)))
    z = a[:, 1:]
    z = (z - z.mean(axis=0)) / (z.std(axis=0) + 1e-8)
    return np.column_stack([np.ones(len(z)), z, z**2]), y


def _loss(x: np.ndarray, lags: int, quadratic: bool) -> float:
    """Mean squared residual of a line or a ridge on squares too."""
    if len(x) <= 2 * (2 * lags + 1):
        return float("nan")
    if not quadratic:
        return float(np.mean(least_squares(x, list(range(1, lags + 1)))[1] ** 2))
    a, y = _quadratic(x, lags)
    w = np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ y)
    return float(np.mean((y - a @ w) ** 2))


SEGMENT_GAINS = ["linear_gain", "quadratic_gain"]


def segment_gains(before: np.ndarray, after: np.ndarray, lags: int = 5) -> Numbers:
    """By how much the loss over the whole series exceeds those of models of each period, for two learners."""
    whole = np.concatenate([before, after])
    return {n: _loss(whole, lags, q) - _loss(before, lags, q) - _loss(after, lags, q) for n, q in zip(SEGMENT_GAINS, (False, True), strict=True)}


HUBER = ["huber_scale", "huber_cusum"]


def huber_cusum(before: np.ndarray, after: np.ndarray, bend: float = 1.345, rounds: int = 20) -> Numbers:
    """Standardised sum, up to the boundary, of bounded residuals of an autoregression fitted by Huber's weights."""
    x = np.concatenate([before, after])
    if len(before) < 3 or len(after) < 3:
        return {}
    a, y = design(x, [1])
    w = np.ones(len(y))
    for _ in range(rounds):
        root = np.sqrt(w)
        beta = np.linalg.lstsq(a * root[:, None], y * root, rcond=None)[0]
        e = y - a @ beta
        scale = np.median(np.abs(e - np.median(e))) / 0.6745
        if scale <= 0:
            return {}
        w = np.minimum(1, bend * scale / np.maximum(np.abs(e), 1e-12))
    bounded = np.clip(e / scale, -bend, bend)
    bounded = bounded - bounded.mean()
    u = (len(before) - 1) / len(y)
    return {"huber_scale": scale, "huber_cusum": bounded[: len(before) - 1].sum() / (bounded.std() * np.sqrt(len(y) * u * (1 - u)))}


def predictability(before: np.ndarray, after: np.ndarray, lags: int = 6, folds: int = 5) -> Numbers:
    """Mean R2 of a regression on lags over blocks of time, each predicted from all that comes before it."""
    x = np.concatenate([before, after])
    if len(x) < lags + 1 + 2 * (folds + 1):
        return {}
    x = x - x.mean()
    ends = np.linspace(0, len(x) - lags, folds + 2).astype(int)

    def blocks(low: int, high: int):
        for at in range(low, high, BLOCK):
            yield design(x[at : min(at + BLOCK, high) + lags], list(range(1, lags + 1)))

    def products(low: int, high: int) -> np.ndarray:
        return sum(b.T @ b for b in (np.column_stack(parts) for parts in blocks(low, high)))

    scores, known = [], products(0, ends[1])
    for low, high in zip(ends[1:-1], ends[2:], strict=True):
        beta = np.linalg.lstsq(known[:-1, :-1], known[:-1, -1], rcond=None)[0]
        y = x[low + lags : high + lags]
        total = np.sum((y - y.mean()) ** 2)
        if total > 0:
            scores.append(1 - sum(np.sum((y - a @ beta) ** 2) for a, y in blocks(low, high)) / total)
        known = known + products(low, high)
    return {"r2": float(np.mean(scores))} if scores else {}


WINDOW = ["dominant", "signal_to_noise", "window"]


def optimal_window(before: np.ndarray, after: np.ndarray, segment: int = 64) -> Numbers:
    """Dominant frequency of the averaged spectrum of half-overlapping Hann segments, and the power of two that holds two periods."""
    x = np.concatenate([before, after])
    size = min(segment, len(x))
    if size < 8:
        return {}
    taper = np.hanning(size)
    parts = embedded(x, size)[:: size // 2]
    power = np.mean(np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2, axis=0)[1:]
    k = int(np.argmax(power))
    frequency, rest = (k + 1) / size, np.delete(power, k).mean()
    window = 2 ** int(np.ceil(np.log2(2 / frequency)))
    return {"dominant": frequency, "signal_to_noise": power[k] / rest if rest > 0 else np.nan, "window": min(window, 2 ** int(np.log2(len(x))))}


TRANSFORMS = ["jb_raw", "jb_difference", "jb_power", "power"]


def _jarque_bera(x: np.ndarray) -> float:
    z = (x - x.mean()) / x.std()
    return len(x) / 6 * (np.mean(z**3) ** 2 + (np.mean(z**4) - 3) ** 2 / 4)


def _yeo_johnson(x: np.ndarray, power: float) -> np.ndarray:
    up, down = np.maximum(x, 0), np.maximum(-x, 0)
    high = np.log1p(up) if abs(power) < 1e-9 else ((1 + up) ** power - 1) / power
    low = np.log1p(down) if abs(power - 2) < 1e-9 else ((1 + down) ** (2 - power) - 1) / (2 - power)
    return np.where(x >= 0, high, -low)


def transforms(before: np.ndarray, after: np.ndarray) -> Numbers:
    """Jarque-Bera of the values, their differences and their likeliest Yeo-Johnson power, found on a grid of -2..4."""
    x = np.concatenate([before, after])
    if len(x) < 8 or x.std() == 0:
        return {}
    jacobian = np.sum(np.sign(x) * np.log1p(np.abs(x)))
    grid = np.linspace(-2, 4, 121)
    fits = [-len(x) / 2 * np.log(np.var(_yeo_johnson(x, p))) + (p - 1) * jacobian for p in grid]
    power = float(grid[int(np.nanargmax(fits))])
    return {"jb_raw": _jarque_bera(x), "jb_difference": _jarque_bera(np.diff(x)), "jb_power": _jarque_bera(_yeo_johnson(x, power)), "power": power}
