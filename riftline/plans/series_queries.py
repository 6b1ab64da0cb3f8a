"""Queries on the series of the events and embeddings tables, each with the same computation in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.functions.moments import rounded
from riftline.operators import datasets, distribution, evaluation, likelihood, regression, shape
from riftline.sources.series import planted_break, to_arrays, type_series, user_series, vector_series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_NUMBERED = """{name} AS (SELECT {key} AS series_id, CAST(row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS BIGINT) AS t,
  CAST(value AS DOUBLE) AS value, CASE WHEN ts >= TIMESTAMP '2024-01-22' THEN 1 ELSE 0 END AS period
  FROM events WHERE value IS NOT NULL AND NOT isnan(value))"""
#: Users' series, series of event types, series of vectors, and users' series with a break planted in every third.
U = "WITH " + _NUMBERED.format(name="s", key="user_id")
E = "WITH " + _NUMBERED.format(name="s", key="event_type")
V = """WITH s AS (SELECT vec_id AS series_id, CAST(i - 1 AS BIGINT) AS t, CAST(embedding[i] AS DOUBLE) AS value, CASE WHEN i - 1 >= 44 THEN 1 ELSE 0 END AS period
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] IS NOT NULL AND NOT isnan(embedding[i]))"""
B = "WITH " + _NUMBERED.format(name="raw", key="user_id") + """,
s AS (SELECT series_id, t, CASE WHEN series_id % 3 = 0 AND period = 1 THEN value * 1.0 + 25.0 ELSE value END AS value, period, series_id % 3 = 0 AS has_break FROM raw)"""


def register(name: str, source: Callable[[SparkSession, str], DataFrame], operator: Callable[[DataFrame], DataFrame], sql: str | None, digits: int = 6, nudge: float = 0.0) -> None:
    """nudge is added before rounding where values are short binary or decimal fractions that end in a rounding tie."""
    QUERIES[name] = lambda spark, sf_dir: rounded(operator(source(spark, sf_dir)), digits, nudge)
    if sql:
        ORACLES[name] = sql


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {name}"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_break(user_series(spark, sf_dir))


def both(template: str) -> str:
    """The template for period 0 and for period 1, joined by commas."""
    return ", ".join(template.replace("@", p) for p in "01")


F_ = lambda p: f"FILTER (WHERE period = {p})"
COUNTS = ", c AS (SELECT series_id, " + both("count(value) FILTER (WHERE period = @) AS n@, avg(value) FILTER (WHERE period = @) AS m@, var_samp(value) FILTER (WHERE period = @) AS v@") + " FROM s GROUP BY series_id)"
TESTABLE = "n0 >= 8 AND n1 >= 8 AND v0 > 0 AND v1 > 0"

# --- distribution -------------------------------------------------------------------------------------------------
_DESCRIPTIVE = U + ", d AS (SELECT series_id, " + both(
    "coalesce(avg(value) FILTER (WHERE period = @), 0) AS mean_@, coalesce(stddev_pop(value) FILTER (WHERE period = @), 0) AS std_@, skewness(value) FILTER (WHERE period = @) AS skew_@, kurtosis(value) FILTER (WHERE period = @) AS kurt_@, count(value) FILTER (WHERE period = @) AS n_@"
) + " FROM s GROUP BY series_id) SELECT series_id, " + both(", ".join(r(f"{x}_@", f"{x}_@") for x in ("mean", "std", "skew", "kurt")) + ", n_@") + ", " + ", ".join(r(f"{x}_1 - {x}_0", f"{x}_diff") for x in ("mean", "std", "skew", "kurt")) + ", " + ", ".join(r(f"{x}_1 / ({x}_0 + 1e-8)", f"{x}_ratio") for x in ("mean", "std")) + ", " + r("n_1 / (n_0 + 1)", "length_ratio") + " FROM d"
register("dist_descriptive", user_series, distribution.descriptive, _DESCRIPTIVE)
register("ttest_stat", user_series, distribution.student_t, U + COUNTS + f" SELECT series_id, CASE WHEN {TESTABLE} THEN round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) END AS t, CASE WHEN {TESTABLE} THEN CAST(n0 + n1 - 2 AS DOUBLE) END AS df FROM c")
register("welch_stat", user_series, distribution.welch_t, U + COUNTS + f" SELECT series_id, CASE WHEN {TESTABLE} THEN round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) END AS t, CASE WHEN {TESTABLE} THEN round((v0 / n0 + v1 / n1) ^ 2 / ((v0 / n0) ^ 2 / (n0 - 1) + (v1 / n1) ^ 2 / (n1 - 1)), 6) END AS df FROM c")
register("levene_stat", user_series, distribution.levene, U + ", q AS (SELECT series_id, period, quantile_cont(value, 0.5) AS med FROM s GROUP BY ALL), z AS (SELECT s.*, abs(value - med) AS z FROM s JOIN q USING (series_id, period)), c AS (SELECT series_id, avg(z) AS zz, " + both("count(*) FILTER (WHERE period = @) AS n@, var_samp(value) FILTER (WHERE period = @) AS v@, avg(z) FILTER (WHERE period = @) AS z@, var_pop(z) FILTER (WHERE period = @) AS s@") + f" FROM z GROUP BY series_id) SELECT series_id, CASE WHEN {TESTABLE} THEN round((n0 + n1 - 2) * (n0 * (z0 - zz) ^ 2 + n1 * (z1 - zz) ^ 2) / (n0 * s0 + n1 * s1), 6) END AS w FROM c")
RANKED = ", k AS (SELECT *, count(*) OVER (PARTITION BY series_id, value) AS ties, rank() OVER (PARTITION BY series_id ORDER BY value) AS low FROM s), rk AS (SELECT *, low + (ties - 1) / 2 AS rank FROM k)"
register("mannwhitney_u", user_series, distribution.mann_whitney, U + RANKED + ", c AS (SELECT series_id, sum(rank) FILTER (WHERE period = 0) AS r0, " + both("count(*) FILTER (WHERE period = @) AS n@, var_samp(value) FILTER (WHERE period = @) AS v@") + f", CAST(sum(ties * ties - 1) AS DOUBLE) AS tied FROM rk GROUP BY series_id), u AS (SELECT *, r0 - n0 * (n0 + 1) / 2 AS u FROM c) SELECT series_id, CASE WHEN {TESTABLE} THEN round(u, 6) END AS u, CASE WHEN {TESTABLE} THEN round((greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - tied / ((n0 + n1) * (n0 + n1 - 1)))), 6) END AS z FROM u")
ECDF = ", f AS (SELECT series_id, value, " + both("count(*) FILTER (WHERE period = @) AS f@") + " FROM s GROUP BY ALL), e AS (SELECT *, " + both("CAST(sum(f@) OVER (PARTITION BY series_id ORDER BY value) AS DOUBLE) AS c@, CAST(sum(f@) OVER (PARTITION BY series_id) AS DOUBLE) AS n@") + ", coalesce(lead(value) OVER (PARTITION BY series_id ORDER BY value) - value, 0) AS gap FROM f)"
register("ecdf_distances", user_series, distribution.ecdf_distances, U + ECDF + " SELECT series_id, CAST(any_value(n0) AS BIGINT) AS n0, CAST(any_value(n1) AS BIGINT) AS n1, " + ", ".join(f"CASE WHEN any_value(n0) >= 2 AND any_value(n1) >= 2 THEN {r(x, n).split(' AS ')[0]} END AS {n}" for x, n in (("max(abs(c0 / n0 - c1 / n1))", "ks"), ("sum(abs(c0 / n0 - c1 / n1) * gap)", "wasserstein"), ("sqrt(2 * sum((c0 / n0 - c1 / n1) ^ 2 * gap))", "energy"))) + " FROM e GROUP BY series_id")
register("cramervonmises_stat", user_series, distribution.cramer_von_mises, U + RANKED + ", i AS (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY value, t) AS i FROM rk), c AS (SELECT series_id, " + both("CAST(count(*) FILTER (WHERE period = @) AS DOUBLE) AS n@, sum((rank - i) ^ 2) FILTER (WHERE period = @) AS q@") + " FROM i GROUP BY series_id) SELECT series_id, CASE WHEN n0 >= 2 AND n1 >= 2 THEN round((n0 * q0 + n1 * q1) / (n0 * n1 * (n0 + n1)) - (4 * n0 * n1 - 1) / (6 * (n0 + n1)), 6) END AS cvm FROM c")
register("anderson_ksamp_stat", user_series, distribution.anderson_darling, U + ECDF + ", a AS (SELECT series_id, n0, n1, n0 + n1 AS n, f0 + f1 AS l, c0 + c1 - (f0 + f1) / 2 AS b, c0 - f0 / 2 AS m0, c1 - f1 / 2 AS m1 FROM e) SELECT series_id, CASE WHEN any_value(n0) >= 5 AND any_value(n1) >= 5 THEN round((any_value(n) - 1) / any_value(n) * (sum(l / n * (n * m0 - b * n0) ^ 2 / (b * (n - b) - n * l / 4)) / any_value(n0) + sum(l / n * (n * m1 - b * n1) ^ 2 / (b * (n - b) - n * l / 4)) / any_value(n1)), 6) END AS ad FROM a GROUP BY series_id")

# --- autoregression -----------------------------------------------------------------------------------------------
LAGGED = ", lf AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS x FROM s), lp AS (SELECT *, lag(value) OVER (PARTITION BY series_id, period ORDER BY t) AS x FROM s)"
_LINE = "count(x) {f} AS n{k}, regr_slope(value, x) {f} AS slope{k}, regr_intercept(value, x) {f} AS intercept{k}, regr_syy(value, x) {f} - regr_slope(value, x) {f} * regr_sxy(value, x) {f} AS rss{k}"
FITS = LAGGED + ", a AS (SELECT series_id, " + ", ".join(_LINE.format(f=F_(p), k=f"_{p}") for p in (0, 1)) + " FROM lp WHERE x IS NOT NULL GROUP BY series_id), b AS (SELECT series_id, " + _LINE.format(f="", k="_full") + " FROM lf WHERE x IS NOT NULL GROUP BY series_id), f AS (SELECT * FROM a JOIN b USING (series_id))"
_FIT_COLUMNS = ", ".join(f"n{k}, " + ", ".join(r(f"{x}{k}", f"{x}{k}") for x in ("slope", "intercept")) + f", round(rss{k}, 3) AS rss{k}" for k in ("_0", "_1", "_full"))


def _fits(series: DataFrame) -> DataFrame:
    f = regression.fits(series)
    return f.select("series_id", *[F.round(c, 3).alias(c) if c.startswith("rss") else F.col(c) for c in f.columns[1:]])


register("ar1_fit", user_series, _fits, U + FITS + f" SELECT series_id, {_FIT_COLUMNS} FROM f")
_CHOW = "CASE WHEN n_0 + n_1 - 4 > 0 AND rss_full - rss_0 - rss_1 > 0 THEN round(((rss_full - rss_0 - rss_1) / 2) / ((rss_0 + rss_1) / (n_0 + n_1 - 4)), 6) END AS chow_f"
register("chow_f", user_series, lambda s: regression.chow(s).select("series_id", "chow_f", "df2", "coef_distance"), U + FITS + f" SELECT series_id, {_CHOW}, CAST(n_0 + n_1 - 4 AS DOUBLE) AS df2, round(sqrt((slope_0 - slope_1) ^ 2 + (intercept_0 - intercept_1) ^ 2), 6) AS coef_distance FROM f")
RESIDUALS = LAGGED + ", g AS (SELECT series_id, " + _LINE.format(f="", k="") + ", count(*) FILTER (WHERE period = 0) AS before FROM lf WHERE x IS NOT NULL GROUP BY series_id), e AS (SELECT series_id, t, period, value - intercept - slope * x AS e, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, n, before, rss, sqrt(rss / (n - 2)) AS sigma FROM lf JOIN g USING (series_id) WHERE x IS NOT NULL)"
register("cusum_stat", user_series, regression.cusum, U + RESIDUALS + ", h AS (SELECT series_id, any_value(n) AS n, any_value(before) AS k, any_value(rss) AS rss, any_value(sigma) AS sigma, sum(e) FILTER (WHERE period = 0) AS s, sum(e * e) FILTER (WHERE period = 0) AS q, any_value(before) / any_value(n) AS u FROM e GROUP BY series_id) SELECT series_id, n, k, CASE WHEN k BETWEEN 1 AND n - 1 THEN round(s / (sigma * sqrt(n * u * (1 - u))), 6) END AS cusum_t, CASE WHEN k BETWEEN 1 AND n - 1 THEN round((q / rss - u) / sqrt(2 * u * (1 - u) / (n + 2)), 6) END AS cusumsq_z FROM h")
register("cusum_scan_argmax", planted, regression.cusum_scan, B + RESIDUALS + ", c AS (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY t) AS s FROM e), k AS (SELECT series_id, i AS k, s / (sigma * sqrt(n * (i / n) * (1 - i / n))) AS t_k FROM c WHERE i < n AND i >= before AND i <= before + floor((n - before) / 2)) SELECT series_id, k, round(t_k, 6) AS cusum_t FROM k QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(t_k) DESC, k) = 1")
register("jarque_bera_stat", user_series, regression.jarque_bera, U + RESIDUALS + ", m AS (SELECT series_id, e - avg(e) OVER (PARTITION BY series_id) AS e FROM e), k AS (SELECT series_id, count(*) AS n, avg(e ^ 3) / avg(e ^ 2) ^ 1.5 AS skew, avg(e ^ 4) / avg(e ^ 2) ^ 2 - 3 AS excess FROM m GROUP BY series_id) SELECT series_id, n, CASE WHEN n > 10 THEN round(skew, 6) END AS skew, CASE WHEN n > 10 THEN round(excess, 6) END AS excess, CASE WHEN n > 10 THEN round(n / 6 * (skew ^ 2 + excess ^ 2 / 4), 6) END AS jb FROM k")
register("half_variance_ratio", user_series, regression.half_variance_ratio, U + RESIDUALS + " SELECT series_id, CASE WHEN any_value(n) > 20 THEN round(var_pop(e) FILTER (WHERE i > floor(n / 2)) / var_pop(e) FILTER (WHERE i <= floor(n / 2)), 6) END AS variance_ratio FROM e GROUP BY series_id")
_SUPF_PARTS = {"x": "x", "y": "y", "xx": "x * x", "xy": "x * y", "yy": "y * y"}
_RSS = lambda n, g: f"({g('yy')} - {g('y')} ^ 2 / {n} - ({g('xy')} - {g('x')} * {g('y')} / {n}) ^ 2 / ({g('xx')} - {g('x')} ^ 2 / {n}))"
register("supf_scan_argmax", planted, regression.sup_f, B + LAGGED + ", m AS (SELECT series_id, t, period, x - avg(x) OVER w AS x, value - avg(value) OVER w AS y FROM lf WHERE x IS NOT NULL WINDOW w AS (PARTITION BY series_id)), p AS (SELECT series_id, row_number() OVER o AS i, count(*) OVER w AS n, sum(period) OVER w AS n1, " + ", ".join(f"sum({v}) OVER o AS l_{k}, sum({v}) OVER w AS a_{k}" for k, v in _SUPF_PARTS.items()) + " FROM m WINDOW w AS (PARTITION BY series_id), o AS (PARTITION BY series_id ORDER BY t)), z AS (SELECT series_id, i AS k, " + _RSS("n", lambda c: f"a_{c}") + " AS full_, " + _RSS("i", lambda c: f"l_{c}") + " + " + _RSS("(n - i)", lambda c: f"(a_{c} - l_{c})") + " AS split_, n FROM p WHERE i > 2 AND i < n - 2 AND i >= n - n1 + floor(n1 * 0.15) AND i <= n - floor(n1 * 0.15)) SELECT series_id, k, round(((full_ - split_) / 2) / (split_ / (n - 4)), 6) AS sup_f FROM z QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY (full_ - split_) / split_ DESC, k) = 1")

# --- shape --------------------------------------------------------------------------------------------------------
_COST = ", c AS (SELECT series_id, count(*) AS n_full, var_samp(value) AS v_full, " + both("count(*) FILTER (WHERE period = @) AS n_@, var_samp(value) FILTER (WHERE period = @) AS v_@") + " FROM s GROUP BY series_id), g AS (SELECT series_id, " + ", ".join(f"CASE WHEN n_{k} > 1 AND v_{k} > 0 THEN n_{k} * (ln(2 * pi() * v_{k}) + 1) / 2 END AS g_{k}, n_{k} * ln(coalesce(v_{k}, 0) + 1e-8) AS l_{k}" for k in ("full", "0", "1")) + " FROM c)"
register("changepoint_cost", user_series, shape.changepoint_cost, U + _COST + f" SELECT series_id, {r('g_full - (g_0 + g_1)', 'gauss_improvement')}, {r('(g_0 + g_1) / (g_full + 1e-8)', 'gauss_ratio')}, {r('l_full - (l_0 + l_1)', 'variance_improvement')}, {r('(l_0 + l_1) / (l_full + 1e-8)', 'variance_ratio')} FROM g")
register("binseg_split", planted, shape.binary_segmentation, B + ", c AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS x FROM s), p AS (SELECT series_id, t + 1 AS k, count(*) OVER w AS n, sum(x) OVER o AS s, sum(x) OVER w AS a, sum(x * x) OVER w AS q FROM c WINDOW w AS (PARTITION BY series_id), o AS (PARTITION BY series_id ORDER BY t)), z AS (SELECT series_id, k, q - s ^ 2 / k - (a - s) ^ 2 / (n - k) AS cost FROM p WHERE k >= 2 AND n - k >= 2) SELECT series_id, k, round(cost, 3) AS cost FROM z QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(cost, 6), k) = 1", 3)
_VOL = ", d AS (SELECT series_id, t, period, value - lag(value) OVER (PARTITION BY series_id, period ORDER BY t) AS r FROM s), w AS (SELECT *, CASE WHEN count(r) OVER o = 10 THEN stddev_samp(r) OVER o END AS rolling FROM d WHERE r IS NOT NULL WINDOW o AS (PARTITION BY series_id, period ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), g AS (SELECT series_id, " + both("stddev_pop(r) FILTER (WHERE period = @) AS realized_@, stddev_pop(rolling) FILTER (WHERE period = @) AS vol_of_vol_@, skewness(r) FILTER (WHERE period = @) AS skew_@, kurtosis(r) FILTER (WHERE period = @) AS kurt_@, stddev_pop(r) FILTER (WHERE period = @ AND r < 0) AS down_@, stddev_pop(r) FILTER (WHERE period = @ AND r > 0) AS up_@") + " FROM w GROUP BY series_id)"
register("volatility_features", user_series, shape.volatility, U + _VOL + " SELECT series_id, " + both(", ".join(r(f"{x}_@", f"{x}_@") for x in ("realized", "vol_of_vol", "skew", "kurt", "down", "up")) + ", " + r("up_@ - down_@", "asymmetry_@")) + ", " + ", ".join(r(f"{x}_1 - {x}_0", f"{x}_diff") for x in ("realized", "vol_of_vol", "down", "up")) + " FROM g")
register("rolling_boundary", user_series, shape.rolling_boundary, U + ", c AS (SELECT *, count(*) OVER w AS n, coalesce(min(t) FILTER (WHERE period = 1) OVER w, count(*) OVER w) AS b, floor(count(*) OVER w / 4) AS wd FROM s WINDOW w AS (PARTITION BY series_id)), m AS (SELECT a.series_id, a.t, any_value(a.b) AS b, avg(z.value) AS m FROM c a JOIN s z ON z.series_id = a.series_id AND z.t BETWEEN a.t - floor(a.wd / 2) AND a.t + floor((a.wd - 1) / 2) WHERE a.wd >= 3 AND a.t >= a.b - a.wd AND a.t < a.b + a.wd GROUP BY a.series_id, a.t HAVING count(*) = any_value(a.wd)), g AS (SELECT series_id, avg(m) FILTER (WHERE t < b) AS mean_before, avg(m) FILTER (WHERE t >= b) AS mean_after FROM m GROUP BY series_id) SELECT series_id, " + ", ".join((r("mean_before + 1e-9", "mean_before"), r("mean_after + 1e-9", "mean_after"), r("mean_after - mean_before + 1e-9", "mean_change"), r("mean_after / (mean_before + 1e-8) + 1e-9", "mean_ratio"))) + " FROM g", nudge=1e-9)
ACF = ", c AS (SELECT series_id, period, row_number() OVER (PARTITION BY series_id, period ORDER BY t) AS i, value - avg(value) OVER (PARTITION BY series_id, period) AS x FROM s), q AS (SELECT series_id, period, sum(x * x) AS q, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT a.series_id, a.period, b.i - a.i AS lag, sum(a.x * b.x) AS p FROM c a JOIN c b ON a.series_id = b.series_id AND a.period = b.period AND b.i BETWEEN a.i + 1 AND a.i + 10 GROUP BY ALL), acf AS (SELECT p.series_id, p.period, lag, n, p / q AS acf FROM p JOIN q USING (series_id, period))"
#: As far as lag 100 where a period is that long; Ljung-Box stays at 10.
LONG_ACF = ACF.replace("a.i + 10", "a.i + 100")
register("acf_lags", type_series, shape.autocorrelation, E + LONG_ACF + f" SELECT series_id, period, lag, n, {r('acf', 'acf')} FROM acf")
register("acf_summary", user_series, shape.autocorrelation_summary, U + LONG_ACF + f" SELECT series_id, period, {r('sum(abs(acf))', 'abs_sum')}, {r('avg(acf)', 'mean')}, {r('stddev_pop(acf)', 'std')}, count(*) FILTER (WHERE abs(acf) > 1.96 / sqrt(n)) AS significant, {r('sum(n * (n + 2) * acf ^ 2 / (n - lag)) FILTER (WHERE lag <= 10)', 'ljung_box')}, coalesce(min(lag) FILTER (WHERE abs(acf) < 0.1), 100) AS decay_lag FROM acf GROUP BY series_id, period")
register("acf_distance", user_series, shape.autocorrelation_distance, U + LONG_ACF + f", d AS (SELECT series_id, lag, coalesce(sum(acf) FILTER (WHERE period = 1), 0) - coalesce(sum(acf) FILTER (WHERE period = 0), 0) AS d FROM acf GROUP BY ALL) SELECT series_id, {r('sqrt(sum(d * d))', 'l2')}, {r('sum(abs(d))', 'l1')} FROM d GROUP BY series_id")
register("perm_entropy", user_series, shape.permutation_entropy, U + ", o AS (SELECT series_id, period, lag(value, 2) OVER w AS a, lag(value) OVER w AS b, value AS c FROM s WINDOW w AS (PARTITION BY series_id, period ORDER BY t)), k AS (SELECT series_id, period, (a > b, a > c, b > c) AS pattern, count(*) AS k FROM o WHERE a IS NOT NULL GROUP BY ALL), z AS (SELECT series_id, period, k / sum(k) OVER (PARTITION BY series_id, period) AS p FROM k), h AS (SELECT series_id, " + both("sum(-p * log2(p)) FILTER (WHERE period = @) AS e@") + f" FROM z GROUP BY series_id) SELECT series_id, {r('e0', 'entropy_0')}, {r('e1', 'entropy_1')}, {r('e1 - e0', 'entropy_diff')} FROM h")
register("multiscale_blocks", user_series, shape.block_spread, U + ", i AS (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY t) - 1 AS i FROM s), b AS (SELECT series_id, period, size, i // size AS block, stddev_pop(value) AS sd FROM i, (VALUES (5), (10), (20)) z(size) GROUP BY ALL HAVING count(*) = size), g AS (SELECT series_id, size, " + both("avg(sd) FILTER (WHERE period = @) AS spread_@, count(*) FILTER (WHERE period = @) AS blocks_@") + f" FROM b GROUP BY ALL) SELECT series_id, CAST(size AS BIGINT) AS size, {r('spread_0', 'spread_0')}, {r('spread_1', 'spread_1')}, blocks_0, blocks_1, {r('spread_1 / spread_0', 'ratio')} FROM g")
register("break_characteristics", planted, shape.break_characteristics, B + ", i AS (SELECT *, sum(period) OVER (PARTITION BY series_id) AS n1, row_number() OVER (PARTITION BY series_id, period ORDER BY t) - 1 AS i FROM s), g AS (SELECT series_id, stddev_pop(value) FILTER (WHERE period = 0) AS s0, stddev_pop(value) FILTER (WHERE period = 1) AS s1, stddev_pop(value) FILTER (WHERE period = 1 AND i < floor(n1 / 2)) AS early, stddev_pop(value) FILTER (WHERE period = 1 AND i >= floor(n1 / 2)) AS late FROM i GROUP BY series_id) SELECT series_id, " + ", ".join((r("abs(s1 / s0 - 1)", "magnitude"), r("abs(ln(s1 / s0))", "log_ratio"), r("abs(late - s0) / abs(early - s0)", "persistence"))) + " FROM g")

_SPREAD = ", sp AS (SELECT * FROM (SELECT series_id, t, CASE WHEN count(value) OVER w >= 5 THEN stddev_samp(value) OVER w END AS s FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE s IS NOT NULL)"
register("vol_persistence", user_series, shape.spread_persistence, U + _SPREAD + ", d AS (SELECT series_id, t, s - lag(s) OVER (PARTITION BY series_id ORDER BY t) AS d FROM sp), p AS (SELECT series_id, d, lag(d, 1) OVER w AS d1, lag(d, 5) OVER w AS d5, lag(d, 10) OVER w AS d10 FROM d WHERE d IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, " + ", ".join(r(f"corr(d, d{k})", f"persistence_{k}") for k in (1, 5, 10)) + " FROM p GROUP BY series_id")
register("vol_regime", user_series, shape.spread_regimes, U + _SPREAD + ", q AS (SELECT series_id, quantile_cont(s, 0.75) AS lim FROM sp GROUP BY series_id), h AS (SELECT series_id, t, CASE WHEN s > lim THEN 1 ELSE 0 END AS high FROM sp JOIN q USING (series_id)), f AS (SELECT series_id, abs(high - lag(high) OVER (PARTITION BY series_id ORDER BY t)) AS flip FROM h) SELECT series_id, CAST(sum(flip) AS BIGINT) AS flips, round(count(*) / nullif(sum(flip), 0), 6) AS mean_stay FROM f GROUP BY series_id")
register("vol_mean_reversion", user_series, shape.spread_reversion, U + ", sp AS (SELECT * FROM (SELECT series_id, t, period, CASE WHEN count(value) OVER w >= 5 THEN stddev_samp(value) OVER w END AS s FROM s WINDOW w AS (PARTITION BY series_id, period ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE s IS NOT NULL), p AS (SELECT *, lag(s) OVER (PARTITION BY series_id, period ORDER BY t) AS p FROM sp), g AS (SELECT series_id, " + both("regr_slope(s, p) FILTER (WHERE period = @ AND p IS NOT NULL) AS b@") + f" FROM p GROUP BY series_id) SELECT series_id, {r('b0', 'reversion_0')}, {r('b1', 'reversion_1')}, {r('abs(b1 - b0)', 'reversion_change')}, CASE WHEN abs(b1 - b0) > 0.3 THEN 1 ELSE 0 END AS changed FROM g")
register("period_correlation", user_series, shape.period_correlation, U + ", i AS (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY t) AS i FROM s) SELECT a.series_id, count(*) AS n, round(corr(a.value, b.value), 6) AS correlation FROM i a JOIN i b ON a.series_id = b.series_id AND a.i = b.i AND a.period = 0 AND b.period = 1 GROUP BY a.series_id")
register("winsorised_profile", user_series, lambda s: datasets.value_profile(shape.winsorised(s)).select("period", "n", "mean", "std", "low", "high"), U + ", q AS (SELECT series_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM s GROUP BY series_id), v AS (SELECT period, greatest(least(value, hi), lo) AS value FROM s JOIN q USING (series_id)), b AS (SELECT -1 AS period, value FROM v UNION ALL SELECT period, value FROM v) SELECT CAST(period AS BIGINT) AS period, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM b GROUP BY period")
_OWN = FITS + ", rs AS (SELECT lp.series_id, t, period, value - CASE WHEN period = 0 THEN intercept_0 + slope_0 * x ELSE intercept_1 + slope_1 * x END AS value FROM lp JOIN f USING (series_id) WHERE x IS NOT NULL)"
register("residual_welch", user_series, lambda s: distribution.welch_t(regression.period_residuals(s)).select("series_id", "df"), U + _OWN + COUNTS.replace(" FROM s ", " FROM rs ") + f" SELECT series_id, CASE WHEN {TESTABLE} THEN round((v0 / n0 + v1 / n1) ^ 2 / ((v0 / n0) ^ 2 / (n0 - 1) + (v1 / n1) ^ 2 / (n1 - 1)), 6) END AS df FROM c")
register("residual_levene", user_series, lambda s: distribution.levene(regression.period_residuals(s)), U + _OWN + ", q AS (SELECT series_id, period, quantile_cont(value, 0.5) AS med FROM rs GROUP BY ALL), z AS (SELECT rs.*, abs(value - med) AS z FROM rs JOIN q USING (series_id, period)), c AS (SELECT series_id, avg(z) AS zz, " + both("count(*) FILTER (WHERE period = @) AS n@, var_samp(value) FILTER (WHERE period = @) AS v@, avg(z) FILTER (WHERE period = @) AS z@, var_pop(z) FILTER (WHERE period = @) AS s@") + f" FROM z GROUP BY series_id) SELECT series_id, CASE WHEN {TESTABLE} THEN round((n0 + n1 - 2) * (n0 * (z0 - zz) ^ 2 + n1 * (z1 - zz) ^ 2) / (n0 * s0 + n1 * s1), 6) END AS w FROM c")


def _firing(series: DataFrame) -> DataFrame:
    return evaluation.joint_firing(regression.cusum(series).join(datasets.labels_of(series).withColumn("label", F.col("has_break").cast("int")), "series_id"), "cusum_t", "cusumsq_z", 1.96)


register("joint_firing", planted, _firing, B + RESIDUALS + ", h AS (SELECT series_id, any_value(n) AS n, any_value(before) AS k, any_value(rss) AS rss, any_value(sigma) AS sigma, sum(e) FILTER (WHERE period = 0) AS s, sum(e * e) FILTER (WHERE period = 0) AS q, any_value(before) / any_value(n) AS u FROM e GROUP BY series_id), z AS (SELECT series_id, CASE WHEN abs(s / (sigma * sqrt(n * u * (1 - u)))) > 1.96 THEN 1 ELSE 0 END AS a, CASE WHEN abs((q / rss - u) / sqrt(2 * u * (1 - u) / (n + 2))) > 1.96 THEN 1 ELSE 0 END AS b FROM h WHERE k BETWEEN 1 AND n - 1) SELECT CAST(a AS BIGINT) AS cusum_t_fires, CAST(b AS BIGINT) AS cusumsq_z_fires, count(*) AS n, round(avg(CASE WHEN series_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS break_rate FROM z GROUP BY ALL")

# --- likelihood ---------------------------------------------------------------------------------------------------
_SIDES = ", m AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, var_pop(value) AS v, " + both("CAST(count(*) FILTER (WHERE period = @) AS DOUBLE) AS n@, avg(value) FILTER (WHERE period = @) AS m@, var_pop(value) FILTER (WHERE period = @) AS v@") + " FROM s GROUP BY series_id)"
_LL = lambda n, v: f"(-{n} / 2 * (ln(2 * pi() * greatest({v}, 1e-12)) + 1))"
_CLIP = "1 / (1 + exp(-greatest(least({x} / 2, 10), -10)))"
register("lr_break_prob", planted, likelihood.likelihood_ratio, B + _SIDES + f", l AS (SELECT series_id, 2 * ({_LL('n0', 'v0')} + {_LL('n1', 'v1')} - {_LL('n', 'v')}) AS lr FROM m) SELECT series_id, {r('lr', 'lr')}, {r(_CLIP.format(x='lr'), 'probability')} FROM l")
register("aic_mean_var", planted, likelihood.information_criteria, B + _SIDES + f", a AS (SELECT series_id, 4 - 2 * {_LL('n', 'v')} AS aic_none, 6 - 2 * {_LL('n', '((n0 * v0 + n1 * v1) / n)')} AS aic_mean, 6 - 2 * ({_LL('n0', '(v0 + (m0 - m) ^ 2)')} + {_LL('n1', '(v1 + (m1 - m) ^ 2)')}) AS aic_variance, 8 - 2 * ({_LL('n0', 'v0')} + {_LL('n1', 'v1')}) AS aic_both FROM m), b AS (SELECT *, least(aic_none, aic_mean, aic_variance, aic_both) AS best FROM a) SELECT series_id, " + ", ".join(r(f"aic_{k}", f"aic_{k}") for k in ("none", "mean", "variance", "both")) + ", " + r("1 - exp(-(aic_none - best) / 2) / (exp(-(aic_none - best) / 2) + exp(-(aic_mean - best) / 2) + exp(-(aic_variance - best) / 2) + exp(-(aic_both - best) / 2))", "break_weight") + " FROM b")
_LAP = lambda k: f"(-n{k} * (ln(2 * greatest(b{k}, 1e-12)) + 1))"
register("bic_laplace_robust", planted, likelihood.laplace_criterion, B + ", q AS (SELECT series_id, quantile_cont(value, 0.5) AS q, " + both("quantile_cont(value, 0.5) FILTER (WHERE period = @) AS q@") + " FROM s GROUP BY series_id), d AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, avg(abs(value - q)) AS b, " + both("CAST(count(*) FILTER (WHERE period = @) AS DOUBLE) AS n@, avg(abs(value - q@)) FILTER (WHERE period = @) AS b@") + f" FROM s JOIN q USING (series_id) GROUP BY series_id), g AS (SELECT series_id, (2 * ln(n) - 2 * {_LAP('')}) - (4 * ln(n) - 2 * ({_LAP('0')} + {_LAP('1')})) AS gain FROM d) SELECT series_id, {r('gain', 'bic_gain')}, {r(_CLIP.format(x='gain'), 'probability')} FROM g")
_Q = lambda k: f"((q1_{k} - q0_{k}) / (q0_75 - q0_25))"
register("quantile_asymmetry", planted, likelihood.quantile_shift, B + ", q AS (SELECT series_id, " + both(", ".join(f"quantile_cont(value, {k / 100}) FILTER (WHERE period = @) AS q@_{k}" for k in (10, 25, 50, 75, 90))) + " FROM s GROUP BY series_id) SELECT series_id, " + ", ".join(r(_Q(k), f"shift_{k}") for k in (10, 25, 50, 75, 90)) + ", " + r(f"(abs({_Q(10)}) + abs({_Q(90)})) / (abs({_Q(25)}) + abs({_Q(75)}))", "tail_to_centre") + " FROM q")
register("extreme_events", planted, likelihood.extreme_rates, B + ", q AS (SELECT series_id, quantile_cont(value, 0.5) FILTER (WHERE period = 0) AS m FROM s GROUP BY series_id), d AS (SELECT s.*, abs(value - m) AS d FROM s JOIN q USING (series_id)), k AS (SELECT series_id, quantile_cont(d, 0.5) FILTER (WHERE period = 0) AS mad FROM d GROUP BY series_id) SELECT series_id, " + ", ".join(r(f"avg(CASE WHEN d > {x} * mad THEN 1.0 ELSE 0.0 END) FILTER (WHERE period = {p})", f"beyond_{str(x).replace('.', '_')}_{p}") for x in (2.0, 2.5, 3.0) for p in (0, 1)) + " FROM d JOIN k USING (series_id) GROUP BY series_id")
register("moment_change", user_series, likelihood.moment_change, U + ", c AS (SELECT series_id, period, value - avg(value) OVER (PARTITION BY series_id, period) AS x FROM s), k AS (SELECT series_id, period, avg(x ^ 3) / avg(x ^ 2) ^ 1.5 AS sk, avg(x ^ 4) / avg(x ^ 2) ^ 2 - 3 AS ku FROM c GROUP BY ALL) SELECT series_id, " + r("sum(sk) FILTER (WHERE period = 1) - sum(sk) FILTER (WHERE period = 0)", "skew_change") + ", " + r("sum(ku) FILTER (WHERE period = 1) - sum(ku) FILTER (WHERE period = 0)", "kurt_change") + " FROM k GROUP BY series_id")
register("robust_location_scale", planted, likelihood.location_scale, B + ", q AS (SELECT series_id, period, quantile_cont(value, 0.5) AS m FROM s GROUP BY ALL), d AS (SELECT series_id, period, any_value(m) AS m, quantile_cont(abs(value - m), 0.5) AS mad FROM s JOIN q USING (series_id, period) GROUP BY ALL), g AS (SELECT series_id, " + both("max(m) FILTER (WHERE period = @) AS m@, max(mad) FILTER (WHERE period = @) AS mad@") + f" FROM d GROUP BY series_id) SELECT series_id, {r('(m1 - m0) / mad0', 'location_shift')}, {r('mad1 / mad0', 'scale_ratio')} FROM g")

# --- data sets ----------------------------------------------------------------------------------------------------
_ARRAYS = ", a AS (SELECT series_id, list(value ORDER BY t) AS v, coalesce(min(t) FILTER (WHERE period = 1), count(*)) AS boundary, count(*) AS length FROM s GROUP BY series_id)"
_WINDOWS = _ARRAYS + ", w AS (SELECT series_id, boundary, unnest(range(0, length - {size} + 1, {stride})) AS window_start, v FROM a WHERE length >= {size})"
_SUMMED = "list_sum(v[window_start + 1:window_start + {size}])"


def _window_sums(windows: DataFrame) -> DataFrame:
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return windows.withColumn("total", total).drop("window")


register("series_profile", vector_series, lambda s: to_arrays(s).select("series_id", "boundary", "length", F.size("before").cast("long").alias("n0"), F.size("after").cast("long").alias("n1")), V + " SELECT series_id, coalesce(min(t) FILTER (WHERE period = 1), count(*)) AS boundary, count(*) AS length, count(*) FILTER (WHERE period = 0) AS n0, count(*) FILTER (WHERE period = 1) AS n1 FROM s GROUP BY series_id")
register("sliding_windows", type_series, lambda s: _window_sums(datasets.sliding_windows(s, 100, 20)), E + _WINDOWS.format(size=100, stride=20) + f" SELECT series_id, window_start, round({_SUMMED.format(size=100)}, 3) AS total FROM w", 3)
register("break_windows", type_series, lambda s: _window_sums(datasets.break_windows(s, 100, 5)), E + _WINDOWS.format(size=100, stride=5) + f" SELECT series_id, window_start, boundary - window_start AS break_position, round({_SUMMED.format(size=100)}, 3) AS total FROM w WHERE window_start + 10 <= boundary AND boundary <= window_start + 90", 3)
register("boundary_windows", user_series, lambda s: _window_sums(datasets.boundary_windows(s, 20)), U + ", i AS (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY CASE WHEN period = 0 THEN -t ELSE t END) AS i, count(*) FILTER (WHERE period = 0) OVER (PARTITION BY series_id) AS n0, count(*) FILTER (WHERE period = 1) OVER (PARTITION BY series_id) AS n1 FROM s) SELECT series_id, round(sum(value), 3) AS total FROM i WHERE i <= 10 AND n0 >= 10 AND n1 >= 10 GROUP BY series_id", 3)
_LABELS = ", l AS (SELECT series_id, bool_or(has_break) AS has_break FROM s GROUP BY series_id), h AS (SELECT *, (series_id * 2654435761 + 42) % 4294967296 AS h FROM l)"
register("random_sample", planted, lambda s: datasets.random_sample(datasets.labels_of(s), 10), B + _LABELS + " SELECT series_id, has_break FROM h ORDER BY h, series_id LIMIT 10")
register("balanced_sample", planted, lambda s: datasets.balanced_sample(datasets.labels_of(s), 12), B + _LABELS + ", n AS (SELECT count(*) FILTER (WHERE has_break) AS p, count(*) FILTER (WHERE NOT has_break) AS q FROM l) SELECT series_id, has_break FROM h, n QUALIFY row_number() OVER (PARTITION BY has_break ORDER BY h, series_id) <= CASE WHEN has_break THEN greatest(6, 12 - q) ELSE greatest(6, 12 - p) END")
register("stratified_split", planted, lambda s: datasets.stratified_split(datasets.labels_of(s), 0.8, 0.25), B + _LABELS + ", x AS (SELECT *, row_number() OVER (PARTITION BY has_break ORDER BY h, series_id) AS r, floor(count(*) OVER (PARTITION BY has_break) * 0.8) AS used FROM h) SELECT series_id, has_break, CASE WHEN r <= floor(used * 0.25) THEN 'validation' ELSE 'train' END AS part FROM x WHERE r <= used")
register("stratified_folds", planted, lambda s: datasets.stratified_folds(datasets.labels_of(s), 5), B + _LABELS + " SELECT series_id, has_break, (row_number() OVER (PARTITION BY has_break ORDER BY h, series_id) - 1) % 5 AS fold FROM h")
register("dataset_statistics", planted, datasets.dataset_statistics, B + ", l AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, bool_or(has_break) AS b FROM s GROUP BY series_id) SELECT count(*) AS series, count(*) FILTER (WHERE b) AS positive, count(*) FILTER (WHERE NOT b) AS negative, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) AS ratio, min(n) AS length_min, max(n) AS length_max, round(avg(n), 6) AS length_mean, round(stddev_pop(n), 6) AS length_std FROM l")
register("length_profile", user_series, datasets.length_profile, U + ", c AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, " + both("CAST(count(*) FILTER (WHERE period = @) AS DOUBLE) AS n@") + " FROM s GROUP BY series_id), l AS (SELECT *, CASE WHEN n1 > 0 THEN n0 / n1 END AS ratio FROM c) SELECT " + ", ".join(r(f"{f}({c}{x})", f"{c}_{k}") for c in ("n", "n0", "n1", "ratio") for k, f, x in (("mean", "avg", ""), ("median", "quantile_cont", ", 0.5"), ("min", "min", ""), ("max", "max", ""), ("std", "stddev_samp", ""))) + " FROM l")
register("value_profile", user_series, datasets.value_profile, U + ", b AS (SELECT -1 AS period, value FROM s UNION ALL SELECT period, value FROM s) SELECT CAST(period AS BIGINT) AS period, count(*) AS n, " + ", ".join(r(f"{f}(value{x})", k) for k, f, x in (("mean", "avg", ""), ("median", "quantile_cont", ", 0.5"), ("std", "stddev_samp", ""), ("low", "min", ""), ("high", "max", ""), ("skew", "skewness", ""), ("kurt", "kurtosis", ""))) + " FROM b GROUP BY period")
register("class_comparison", planted, datasets.class_comparison, B + ", p AS (SELECT series_id, bool_or(has_break) AS b, avg(value) FILTER (WHERE period = 1) - avg(value) FILTER (WHERE period = 0) AS dm, stddev_samp(value) FILTER (WHERE period = 1) - stddev_samp(value) FILTER (WHERE period = 0) AS ds FROM s GROUP BY series_id) SELECT CAST(b AS BIGINT) AS has_break, count(*) AS n, " + ", ".join(r(f"{f}({c}{x})", f"{c}_{k}") for c in ("dm", "ds") for k, f, x in (("mean", "avg", ""), ("std", "stddev_samp", ""), ("median", "quantile_cont", ", 0.5"))) + " FROM p GROUP BY b")
register("value_histogram", user_series, datasets.histogram, U + ", m AS (SELECT min(value) AS low, max(value) AS high FROM s) SELECT CAST(least(floor((value - low) * 20 / (high - low)), 19) AS BIGINT) AS bin, count(*) AS n FROM s, m GROUP BY 1")
_NAMES = ("mean_diff", "std_diff", "skew_diff", "kurt_diff")
register("feature_correlation", planted, lambda s: datasets.correlations(distribution.descriptive(s), list(_NAMES)), B + ", d AS (SELECT series_id, " + ", ".join(f"{f}(value) FILTER (WHERE period = 1) - {f}(value) FILTER (WHERE period = 0) AS {n}_diff" for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("skew", "skewness"), ("kurt", "kurtosis"))) + " FROM s GROUP BY series_id) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM d" for k, a in enumerate(_NAMES) for b in _NAMES[k + 1 :]))


# --- evaluation of the absolute t statistic on planted breaks --------------------------------------------------------
def scores(series: DataFrame) -> DataFrame:
    t = distribution.student_t(series).select("series_id", F.round(F.abs("t"), 6).alias("score")).where("score IS NOT NULL")
    return t.join(datasets.labels_of(series), "series_id").select("series_id", F.col("has_break").cast("long").alias("label"), "score")


_SCORES = B + COUNTS + f", l AS (SELECT series_id, CASE WHEN bool_or(has_break) THEN 1 ELSE 0 END AS label FROM s GROUP BY series_id), sc AS (SELECT series_id, CAST(label AS BIGINT) AS label, round(abs((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1))), 6) AS score FROM c JOIN l USING (series_id) WHERE {TESTABLE})"
register("roc_points", planted, lambda s: evaluation.roc_points(scores(s)), _SCORES + " SELECT DISTINCT score, round(sum(label) OVER o / sum(label) OVER (), 6) AS tpr, round(sum(1 - label) OVER o / sum(1 - label) OVER (), 6) AS fpr FROM sc WINDOW o AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
register("auc", planted, lambda s: evaluation.auc(scores(s)), _SCORES + " SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM sc a, sc b WHERE a.label = 1 AND b.label = 0")
register("confusion_matrix", planted, lambda s: evaluation.confusion(scores(s), 2.0), _SCORES + " SELECT label, CASE WHEN score >= 2.0 THEN CAST(1 AS BIGINT) ELSE 0 END AS predicted, count(*) AS n FROM sc GROUP BY ALL")
register("class_report", planted, lambda s: evaluation.class_report(scores(s), 2.0), _SCORES + ", g AS (SELECT CAST(k AS BIGINT) AS class, count(*) FILTER (WHERE label = k AND (score >= 2.0) = (k = 1)) AS tp, count(*) FILTER (WHERE (score >= 2.0) = (k = 1)) AS said, count(*) FILTER (WHERE label = k) AS support FROM sc, (VALUES (0), (1)) z(k) GROUP BY k) SELECT class, round(tp / nullif(said, 0), 6) AS precision, round(tp / nullif(support, 0), 6) AS recall, round(2 * tp / nullif(said + support, 0), 6) AS f1, support FROM g")
_THRESHOLDS = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]
register("threshold_sweep", planted, lambda s: evaluation.threshold_sweep(scores(s), _THRESHOLDS), _SCORES + ", g AS (SELECT th AS threshold, count(*) FILTER (WHERE score >= th AND label = 1) AS tp, count(*) FILTER (WHERE score >= th) AS said, sum(label) AS pos, count(*) AS n FROM sc, (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]::DOUBLE[]) AS th) GROUP BY th) SELECT threshold, round(tp / nullif(said, 0), 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall, round(2 * tp / nullif(said + pos, 0), 6) AS f1, round(said / n, 6) AS coverage FROM g")
