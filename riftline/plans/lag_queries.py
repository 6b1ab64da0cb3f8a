"""Queries on autoregressions of several lags and on (partial) autocorrelations at many lags, with the same in DuckDB's SQL.

The SQL takes another way than the operators: it makes the lag columns orthogonal one after another, in rows, instead of solving
normal equations of sums.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riftline.operators import distribution, lagged
from riftline.plans.series_queries import ACF, ECDF, RANKED, B, U, both, planted, r, register
from riftline.sources.series import user_series

LONG, BY_PERIOD = 100, 30


def ar_sql(k: int, name: str, period: bool) -> str:
    """CTEs ending in ``name``: y, the residual of a regression on k lags, row by row, of each series or each period."""
    keys = "series_id, period" if period else "series_id"
    columns = ["y", *(f"x{j}" for j in range(1, k + 1))]
    lags = ", ".join(f"lag(value, {j}) OVER (PARTITION BY {keys} ORDER BY t) AS x{j}" for j in range(1, k + 1))
    steps = [f"{name}_l AS (SELECT series_id, t, period, value AS y, {lags} FROM s)", f"{name}_0 AS (SELECT series_id, t, period, " + ", ".join(f"{c} - avg({c}) OVER w AS {c}" for c in columns) + f" FROM {name}_l WHERE x{k} IS NOT NULL WINDOW w AS (PARTITION BY {keys}))"]
    for j in range(1, k + 1):
        left = ["y", *(f"x{m}" for m in range(j + 1, k + 1))]
        steps.append(f"{name}_{j} AS (SELECT series_id, t, period, " + ", ".join(f"{c} - x{j} * coalesce(sum({c} * x{j}) OVER w / nullif(sum(x{j} * x{j}) OVER w, 0), 0) AS {c}" for c in left) + f" FROM {name}_{j - 1} WINDOW w AS (PARTITION BY {keys}))")
    return ", " + ", ".join(steps) + f", {name} AS (SELECT series_id, t, period, y FROM {name}_{k})"


def _chow_sql(k: int) -> str:
    m = k + 1
    parts = f"a AS (SELECT series_id, sum(y * y) AS rss_full, count(*) AS n_full FROM w{k} GROUP BY series_id), b AS (SELECT series_id, " + both("sum(y * y) FILTER (WHERE period = @) AS rss_@, count(*) FILTER (WHERE period = @) AS n_@") + f" FROM o{k} GROUP BY series_id)"
    value = f"CASE WHEN n_0 + n_1 > {2 * m} AND rss_full > rss_0 + rss_1 THEN round((rss_full - rss_0 - rss_1) / {m} / ((rss_0 + rss_1) / (n_0 + n_1 - {2 * m})), 5) END AS chow_f"
    sides = ", ".join(f"n_{x}, round(rss_{x}, 2) AS rss_{x}" for x in lagged.FITS)
    return f"SELECT * FROM ({U}{ar_sql(k, f'w{k}', False)}{ar_sql(k, f'o{k}', True)}, {parts} SELECT series_id, CAST({k} AS BIGINT) AS lags, {sides}, {value}, CAST(n_0 + n_1 - {2 * m} AS DOUBLE) AS df2 FROM a JOIN b USING (series_id))"


def _chow(series):
    c = lagged.by_lags(series, lagged.chow, (1, 2, 5)).where("n_0 + n_1 > 0")
    return c.select("series_id", "lags", *[x for f in lagged.FITS for x in (f"n_{f}", F.round(f"rss_{f}", 2).alias(f"rss_{f}"))], "chow_f", "df2")


register("chow_f_lags", user_series, _chow, " UNION ALL ".join(_chow_sql(k) for k in (1, 2, 5)), 5)


def _cusum_sql(k: int) -> str:
    m = k + 1
    g = f"g AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE period = 0) AS k, sum(y * y) AS rss, sum(y) FILTER (WHERE period = 0) AS s, sum(y * y) FILTER (WHERE period = 0) AS q FROM w{k} GROUP BY series_id), u AS (SELECT *, k / n AS u, sqrt(rss / (n - {m})) AS sigma FROM g WHERE n > {m})"
    inside = "CASE WHEN k BETWEEN 1 AND n - 1 THEN round({}, 5) END AS {}"
    return f"SELECT * FROM ({B}{ar_sql(k, f'w{k}', False)}, {g} SELECT series_id, CAST({k} AS BIGINT) AS lags, n, k, {r('sigma', 'sigma', 5)}, {inside.format('s / (sigma * sqrt(n * u * (1 - u)))', 'cusum_t')}, {inside.format('(q / rss - u) / sqrt(2 * u * (1 - u) / (n + 2))', 'cusumsq_z')}, CAST(CASE WHEN k BETWEEN 1 AND n - 1 THEN abs(s / (sigma * sqrt(n * u * (1 - u)))) > 1.959964 END AS BIGINT) AS cusum_significant FROM u)"


def _cusum(series):
    return lagged.by_lags(series, lagged.cusum, (1, 2, 5)).where("n > lags + 1").select("series_id", "lags", "n", "k", "sigma", "cusum_t", "cusumsq_z", "cusum_significant")


register("cusum_lags", planted, _cusum, " UNION ALL ".join(_cusum_sql(k) for k in (1, 2, 5)), 5)

_HALF = "CASE WHEN n > 20 THEN round(v1 / v0, 5) END AS variance_ratio"
_DIAGNOSED = ", e AS (SELECT series_id, y - avg(y) OVER (PARTITION BY series_id) AS e, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM w2), m AS (SELECT series_id, any_value(n) AS n, sum(e * e) AS q, avg(e ^ 3) / avg(e ^ 2) ^ 1.5 AS skew, avg(e ^ 4) / avg(e ^ 2) ^ 2 - 3 AS excess, var_pop(e) FILTER (WHERE i <= n // 2) AS v0, var_pop(e) FILTER (WHERE i > n // 2) AS v1 FROM e GROUP BY series_id), c AS (SELECT a.series_id, b.i - a.i AS lag, sum(a.e * b.e) AS p FROM e a JOIN e b ON a.series_id = b.series_id AND b.i BETWEEN a.i + 1 AND a.i + 5 GROUP BY ALL), lb AS (SELECT series_id, sum(n * (n + 2) * (p / q) ^ 2 / (n - lag)) AS lb FROM c JOIN m USING (series_id) WHERE lag <= n // 4 GROUP BY series_id)"
register(
    "residual_diagnostics", user_series, lambda s: lagged.diagnostics(s, (1, 2)).select("series_id", "n", "skew", "excess", "jb", "jb_p", "ljung_box", "variance_ratio", "normal", "heavy_tails", "skewed"),
    U + ar_sql(2, "w2", False) + _DIAGNOSED + f" SELECT series_id, n, {r('skew', 'skew', 5)}, {r('excess', 'excess', 5)}, {r('n / 6 * (skew ^ 2 + excess ^ 2 / 4)', 'jb', 5)}, {r('exp(-n / 6 * (skew ^ 2 + excess ^ 2 / 4) / 2)', 'jb_p', 5)}, {r('lb', 'ljung_box', 5)}, {_HALF}, CAST(exp(-n / 6 * (skew ^ 2 + excess ^ 2 / 4) / 2) > 0.05 AS BIGINT) AS normal, CAST(excess > 3 AS BIGINT) AS heavy_tails, CAST(abs(skew) > 1 AS BIGINT) AS skewed FROM m LEFT JOIN lb USING (series_id) WHERE n > 10", 5,
)

# --- tests on the residuals of each period's own regression on five lags ---------------------------------------------
_OWN5 = U + ar_sql(5, "o5", True) + ", rs AS (SELECT series_id, t, period, round(y, 8) AS value FROM o5)"
_five = lambda s: lagged.period_residuals(s, lagged.first_lags(5)).withColumn("value", F.round("value", 8))  # equal ones stay ties
_distances = ", ".join(f"CASE WHEN any_value(n0) >= 2 AND any_value(n1) >= 2 THEN {r(x, n, 5)[: -len(f' AS {n}')]} END AS {n}" for x, n in (("max(abs(c0 / n0 - c1 / n1))", "ks"), ("sum(abs(c0 / n0 - c1 / n1) * gap)", "wasserstein"), ("sqrt(2 * sum((c0 / n0 - c1 / n1) ^ 2 * gap))", "energy")))
register("residual5_distances", user_series, lambda s: distribution.ecdf_distances(_five(s)), _OWN5 + ECDF.replace(" FROM s ", " FROM rs ") + f" SELECT series_id, CAST(any_value(n0) AS BIGINT) AS n0, CAST(any_value(n1) AS BIGINT) AS n1, {_distances} FROM e GROUP BY series_id", 5)
_CVM = ", i AS (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY value, t) AS i FROM rk), c AS (SELECT series_id, " + both("CAST(count(*) FILTER (WHERE period = @) AS DOUBLE) AS n@, sum((rank - i) ^ 2) FILTER (WHERE period = @) AS q@") + " FROM i GROUP BY series_id) SELECT series_id, CASE WHEN n0 >= 2 AND n1 >= 2 THEN round((n0 * q0 + n1 * q1) / (n0 * n1 * (n0 + n1)) - (4 * n0 * n1 - 1) / (6 * (n0 + n1)), 5) END AS cvm FROM c"
register("residual5_cramervonmises", user_series, lambda s: distribution.cramer_von_mises(_five(s)), _OWN5 + RANKED.replace(" FROM s)", " FROM rs)") + _CVM, 5)

# --- partial autocorrelation ---------------------------------------------------------------------------------------
_AT = lambda lags, sql=ACF: sql.replace("a.i + 10", f"a.i + {lags}")
WHOLE_ACF = ACF.replace("SELECT series_id, period, row_number() OVER (PARTITION BY series_id, period", "SELECT series_id, 0 AS period, row_number() OVER (PARTITION BY series_id").replace("avg(value) OVER (PARTITION BY series_id, period)", "avg(value) OVER (PARTITION BY series_id)")
#: The same recursion over lists, a row for each series, period and lag.
PARTIAL = (
    ", ra AS (SELECT series_id, period, any_value(n) AS n, list(acf * n / (n - lag) ORDER BY lag) AS r FROM acf WHERE lag < n // 2 GROUP BY series_id, period)"
    ", dl(series_id, period, n, k, r, phi, pacf) AS (SELECT series_id, period, n, 1, r, [r[1]], r[1] FROM ra UNION ALL SELECT series_id, period, n, k + 1, r, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - x * phi[k + 1 - j]), x), x"
    " FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS x FROM dl WHERE k < len(r)))"
    ", pa AS (SELECT series_id, period, n, CAST(k AS BIGINT) AS lag, pacf FROM dl)"
)
_RECURSIVE = U.replace("WITH ", "WITH RECURSIVE ", 1)
#: Far lags of short periods by products divided by n, with which the recursion can't break down.
register("pacf_lags_100", user_series, lambda s: lagged.partial(s, LONG, adjusted=False), _RECURSIVE + _AT(LONG) + PARTIAL.replace("acf * n / (n - lag)", "acf") + f" SELECT series_id, CAST(period AS INTEGER) AS period, lag, n, {r('pacf', 'pacf', 4)} FROM pa", 4)
_PROFILE = "SELECT CAST(period AS BIGINT) AS period, lag, count({c}) AS series, " + ", ".join(r(f"{f}({{c}})", n, 4) for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("min", "low"), ("max", "high"))) + ", round(avg(CASE WHEN abs({c}) > 1.96 / sqrt(n) THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END), 4) AS significant FROM {t} GROUP BY period, lag"
register("acf_profile", user_series, lambda s: lagged.lag_profile(lagged.autocorrelation(lagged.whole_series(s), LONG), "acf"), U + _AT(LONG, WHOLE_ACF) + " " + _PROFILE.format(c="acf", t="acf"), 4)
register("acf_profile_by_period", user_series, lambda s: lagged.lag_profile(lagged.autocorrelation(s, BY_PERIOD), "acf"), U + _AT(BY_PERIOD) + " " + _PROFILE.format(c="acf", t="acf"), 4)
register("pacf_profile", user_series, lambda s: lagged.lag_profile(lagged.partial(lagged.whole_series(s), BY_PERIOD), "pacf"), _RECURSIVE + _AT(BY_PERIOD, WHOLE_ACF) + PARTIAL + " " + _PROFILE.format(c="pacf", t="pa"), 4)
_SIDES = both("sum(pacf) FILTER (WHERE period = @) AS p@, max(n) FILTER (WHERE period = @) AS n@")
register("pacf_summary", user_series, lambda s: lagged.partial_summary(s, BY_PERIOD), _RECURSIVE + _AT(BY_PERIOD) + PARTIAL + f", g AS (SELECT series_id, lag, {_SIDES} FROM pa GROUP BY ALL) SELECT series_id, " + both("count(*) FILTER (WHERE abs(p@) > 1.96 / sqrt(n@)) AS significant_@, round(sum(abs(p@)), 4) AS abs_sum_@") + ", round(sqrt(sum((coalesce(p1, 0) - coalesce(p0, 0)) ^ 2)), 4) AS l2, round(sum(abs(coalesce(p1, 0) - coalesce(p0, 0))), 4) AS l1 FROM g GROUP BY series_id", 4)
