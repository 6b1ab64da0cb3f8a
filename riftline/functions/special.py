"""Tail probabilities that Spark SQL lacks, as Arrow UDFs over NumPy.

Each takes statistics that are already one row per series, so a batch is one call.  Nulls and values outside
a distribution's domain give null.  Upper tails are computed as such, not as one minus the lower tail.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z)."""
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2))


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    scale = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - _lgamma(a))
    term = total = 1 / a
    below = np.minimum(x, a + 1)  # beyond, the fraction is taken
    for k in range(1, 500):
        term = term * below / (a + k)
        total = total + term
    b = x + 1 - a
    c, d = np.full(x.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for k in range(1, 300):
        an = -k * (k - a)
        b = b + 2
        d = an * d + b
        c = b + an / c
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - scale * total, scale * h))


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction, on the side where it converges fast."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(np.maximum(y, 1e-300)) + q * np.log1p(-np.minimum(y, 1 - 1e-16))) / p
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c = np.ones_like(y)
    d = 1 / safe(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1 / safe(1 + even * d)
        c = safe(1 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 / safe(1 + odd * d)
        c = safe(1 + odd / c)
        h = h * d * c
    part = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - part, part)


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return beta_lower(np.asarray(df, float) / 2, 0.5, np.asarray(df, float) / (df + np.asarray(t, float) ** 2))


def f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return beta_lower(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.asarray(f, float)))


def kolmogorov_tail(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Asymptotic two-sample tail with the usual small-sample term."""
    en = np.sqrt(n * m / (n + m))
    x = np.maximum((en + 0.12 + 0.11 / en) * d, 1e-3)
    k = np.arange(1, 101)[:, None]
    return np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k**2 * x[None] ** 2)).sum(0), 0, 1)


#: Values of the larger sample up to which Kolmogorov-Smirnov p-values are exact, and Cramer-von Mises ones.
EXACT_KS, EXACT_CVM = 10_000, 20


def kolmogorov_exact(d: float, n: int, m: int) -> float:
    """P(D >= d) by counting the lattice paths from (0, 0) to (n, m) that stay nearer to the diagonal than d.

    A row of the lattice is a cumulated sum over the row before, within the band; counts are kept as shares of all paths.
    """
    reach = math.floor(d * n * m - 1e-7)  # |i m - j n| may be as much
    if reach < 0:
        return 1.0
    u = (np.arange(m + 1) * n <= reach).astype(float)
    for i in range(1, n + 1):
        low, high = max(0, -((reach - i * m) // n)), min(m, (i * m + reach) // n)
        new = np.zeros(m + 1)
        if low <= high:
            new[low : high + 1] = np.cumsum(i / (i + m) * u[low : high + 1])
        u = new
    return float(min(1.0, max(0.0, 1 - u[m])))


def kolmogorov_p(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact up to EXACT_KS values in each sample, asymptotic beyond."""
    large = np.maximum(n, m) > EXACT_KS
    return np.where(large, kolmogorov_tail(d, n, m), [1.0 if x else kolmogorov_exact(float(a), int(b), int(c)) for a, b, c, x in zip(d, n, m, large, strict=True)])


@lru_cache(maxsize=32)
def _squared_gaps(n: int, m: int) -> dict[int, int]:
    """How many ways to mix two samples without ties have each sum of (i m - j n) ** 2 along their lattice path."""
    counts: dict[tuple[int, int], dict[int, int]] = {(0, 0): {0: 1}}
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                gap, here = (i * m - j * n) ** 2, {}
                for before in ((i - 1, j), (i, j - 1)):
                    for value, k in counts.get(before, {}).items():
                        here[value + gap] = here.get(value + gap, 0) + k
                counts[i, j] = here
    return counts[n, m]


def cramer_von_mises_exact(t: float, n: int, m: int) -> float:
    """P(T >= t) over all ways to mix two samples without ties, by counting lattice paths by the sum of their squared gaps.

    T is the sum of (i m - j n) ** 2 along the path, over n m (n + m) ** 2.
    """
    bound = t * n * m * (n + m) ** 2 - 1e-6
    return sum(k for value, k in _squared_gaps(n, m).items() if value >= bound) / math.comb(n + m, n)


#: Steps of the integral of the Bessel function, with what does not depend on its argument; arguments beyond which exp(-x) is 0.
_U, _H = np.linspace(0, 12, 6001, retstep=True)
_RISE, _WEIGHT = np.cosh(_U) - 1, np.where((_U == 0) | (_U == _U[-1]), 0.5, 1.0) * _H * np.cosh(_U / 4)
_VANISHED = 746.0


def _bessel_quarter(z: np.ndarray) -> np.ndarray:
    """exp(z) times the modified Bessel function of the second kind of order 1/4, by its integral."""
    z = np.asarray(z, float)
    out, part = np.empty(z.size), np.zeros(len(_U))
    for k, x in enumerate(z.ravel()):
        some = int(np.searchsorted(_RISE, _VANISHED / x))
        part[:some] = np.exp(-x * _RISE[:some]) * _WEIGHT[:some]
        part[some:] = 0.0
        out[k] = part.sum()
    return out.reshape(z.shape)


_J = np.arange(60)
#: (-1) ** j times the binomial of -1/2 over j
_SHARES = np.exp(_lgamma(_J + 0.5) - _lgamma(_J + 1.0)) / math.sqrt(math.pi)


def cramer_von_mises_tail(t: float, n: int, m: int) -> float:
    """P(T >= t) by the limiting distribution, with T shifted and scaled to the mean and variance that it has there."""
    total, k = n + m, n * m
    mean = (1 + 1 / total) / 6
    variance = (total + 1) * (4 * k * total - 3 * (n**2 + m**2) - 2 * k) / (45 * total**2 * 4 * k)
    x = 1 / 6 + (t - mean) / math.sqrt(45 * variance)
    if x < 0.003:
        return 1.0
    y = (4 * _J + 1) ** 2 / (16 * x)
    some = int(np.searchsorted(y, y[0] + 45))  # terms are positive, and the others, below exp(-90) of the first, too small to change a digit
    terms = np.zeros(len(_J))
    terms[:some] = (_SHARES * np.sqrt(4 * _J + 1) * np.exp(-2 * y))[:some] * _bessel_quarter(y[:some])
    return float(min(1.0, max(0.0, 1 - terms.sum() / (math.pi * math.sqrt(x)))))


def _guarded(function):
    def run(*columns: pd.Series) -> pd.Series:
        data = pd.concat(columns, axis=1).astype(float)
        ok = np.isfinite(data.to_numpy()).all(axis=1)
        out = np.full(len(data), np.nan)
        if ok.any():
            out[ok] = function(*(data.to_numpy()[ok, k] for k in range(data.shape[1])))
        return pd.Series(out)

    return run


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return _guarded(lambda v: 2 * normal_tail(np.abs(v)))(z)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return _guarded(student_two_sided)(t, df)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p-value of an F statistic."""
    return _guarded(f_tail)(f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper-tail p-value of a chi-square statistic."""
    return _guarded(lambda v, k: gamma_tail(k / 2, v / 2))(x, df)


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """P-value of a two-sample Kolmogorov-Smirnov distance."""
    return _guarded(kolmogorov_p)(d, n, m)


@F.pandas_udf(DoubleType())
def cvm_p(t: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """P-value of a two-sample Cramer-von Mises statistic, exact up to EXACT_CVM values in each sample."""
    return _guarded(lambda t, n, m: np.array([(cramer_von_mises_exact if max(a, b) <= EXACT_CVM else cramer_von_mises_tail)(x, int(a), int(b)) for x, a, b in zip(t, n, m, strict=True)]))(t, n, m)
