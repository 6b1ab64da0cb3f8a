"""Queries on profiles over series and on measures around the boundary, with the same computation in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.operators import datasets, distribution, profiles, regression
from riftline.plans.series_queries import _LABELS, _OWN, _WINDOWS, ACF, ECDF, ORACLES, RANKED, RESIDUALS, B, E, U, both, planted, r, register
from riftline.sources.series import type_series, user_series

_WHOLE_ACF = ACF.replace("SELECT series_id, period, row_number() OVER (PARTITION BY series_id, period", "SELECT series_id, 0 AS period, row_number() OVER (PARTITION BY series_id").replace("avg(value) OVER (PARTITION BY series_id, period)", "avg(value) OVER (PARTITION BY series_id)")

# --- profiles by lag ----------------------------------------------------------------------------------------------
register("lag_profile", user_series, profiles.lag_profile, U + ACF + " SELECT CAST(period AS BIGINT) AS period, lag, count(acf) AS series, " + ", ".join(r(f"{f}(acf)", k) for f, k in (("avg", "mean"), ("stddev_pop", "std"), ("min", "low"), ("max", "high"))) + ", round(avg(CASE WHEN abs(acf) > 1.96 / sqrt(n) THEN 1.0 WHEN acf IS NOT NULL THEN 0.0 END), 6) AS significant FROM acf GROUP BY period, lag")
_CHI2 = "[" + ", ".join(map(str, profiles.CHI2_95)) + "]"
register("ljung_box_profile", user_series, profiles.ljung_box_profile, U + ACF + f", q10 AS (SELECT series_id, period, lag, sum(n * (n + 2) * acf ^ 2 / (n - lag)) OVER (PARTITION BY series_id, period ORDER BY lag) AS qs FROM acf) SELECT CAST(period AS BIGINT) AS period, lag, count(qs) AS series, {r('avg(qs)', 'mean', 5)}, round(avg(CASE WHEN qs > {_CHI2}[lag] THEN 1.0 WHEN qs IS NOT NULL THEN 0.0 END), 5) AS significant FROM q10 GROUP BY period, lag", 5)
_TEN = "FILTER (WHERE lag <= 10)"
register("acf_columns", user_series, profiles.lag_columns, U + _WHOLE_ACF.replace("a.i + 10", "a.i + 20") + ", z AS (SELECT *, sign(lead(acf) OVER (PARTITION BY series_id ORDER BY lag)) <> sign(acf) AS turns FROM acf WHERE n >= 40) SELECT series_id, " + ", ".join(r(f"max(acf) FILTER (WHERE lag = {k})", f"acf_{k}") for k in (1, 2, 5, 10)) + f", {r(f'sum(abs(acf)) {_TEN}', 'abs_sum')}, {r(f'avg(acf) {_TEN}', 'mean')}, {r(f'stddev_pop(acf) {_TEN}', 'std')}, coalesce(min(lag) FILTER (WHERE turns), 20) AS first_zero FROM z GROUP BY series_id")
register("pacf_lag_relation", user_series, profiles.partial_lag_relation, U + ACF + ", a AS (SELECT series_id, period, " + ", ".join(f"max(acf * n / (n - {k})) FILTER (WHERE lag = {k}) AS r{k}" for k in (1, 2)) + " FROM acf GROUP BY series_id, period), pp AS (SELECT period, r1 AS p1, (r2 - r1 ^ 2) / nullif(1 - r1 ^ 2, 0) AS p2 FROM a) SELECT CAST(period AS BIGINT) AS period, count(*) AS series, " + ", ".join((r("avg(p1)", "mean_1", 5), r("avg(p2)", "mean_2", 5), r("regr_slope(p2, p1)", "slope", 5), r("regr_intercept(p2, p1)", "intercept", 5), r("corr(p1, p2)", "correlation", 5))) + " FROM pp WHERE abs(p1) < 1 AND p2 IS NOT NULL GROUP BY period", 5)
register("decay_comparison", planted, profiles.decay_comparison, B + _WHOLE_ACF.replace("a.i + 10", "a.i + 100") + ", dl AS (SELECT series_id, coalesce(min(lag) FILTER (WHERE abs(acf) < 0.1), 100) AS d FROM acf GROUP BY series_id), l AS (SELECT series_id, bool_or(has_break) AS hb FROM s GROUP BY series_id), j AS (SELECT d, hb FROM dl JOIN l USING (series_id)) SELECT (SELECT count(*) FROM j WHERE hb) AS breaks, (SELECT count(*) FROM j WHERE NOT hb) AS others, round(sum(CASE WHEN a.d > b.d THEN 1.0 WHEN a.d = b.d THEN 0.5 ELSE 0.0 END), 6) AS u FROM j a, j b WHERE a.hb AND NOT b.hb")

# --- whole tables -------------------------------------------------------------------------------------------------
register("described_values", user_series, profiles.described, U + " SELECT CAST(period AS BIGINT) AS period, count(*) AS n, " + ", ".join(r(f"{f}(value)", k) for f, k in (("avg", "mean"), ("stddev_samp", "std"), ("min", "low"), ("max", "high"))) + ", " + ", ".join(r(f"quantile_cont(value, 0.{k})", f"q{k}") for k in ("05", "25", "50", "75", "95")) + " FROM s GROUP BY period")
register("length_counts", user_series, profiles.length_counts, U + ", l AS (SELECT series_id, count(*) AS length FROM s GROUP BY series_id), c AS (SELECT length, count(*) AS n FROM l GROUP BY length) SELECT length, n, length = (SELECT length FROM c ORDER BY n DESC, length LIMIT 1) AS mode FROM c")
_MOMENTS = ", m AS (SELECT period, value - avg(value) OVER (PARTITION BY period) AS x FROM s), g AS (SELECT period, CAST(count(*) AS DOUBLE) AS n, avg(x ^ 3) / avg(x ^ 2) ^ 1.5 AS g1, avg(x ^ 4) / avg(x ^ 2) ^ 2 AS b2 FROM m GROUP BY period)"
_K2 = (
    ", h AS (SELECT *, sqrt(2 * (3 * (n ^ 2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ^ 2 * (n + 3) * (n + 5))) AS x, 6 * (n ^ 2 - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM g WHERE n >= 20)"
    ", k AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2)) ) AS zs, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / sb ^ 2)) AS a FROM h), z AS (SELECT *, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM k)"
)
register("normality_k2", user_series, profiles.normality, U + _MOMENTS + _K2 + " SELECT CAST(period AS BIGINT) AS period, CAST(n AS BIGINT) AS n, " + ", ".join((r("zs", "skew_z", 5), r("zk", "kurt_z", 5), r("zs ^ 2 + zk ^ 2", "k2", 5), r("exp(-(zs ^ 2 + zk ^ 2) / 2)", "p", 5))) + " FROM z", 5)
register("residual_normality", planted, profiles.residual_normality, B + RESIDUALS + ", m AS (SELECT series_id, e - avg(e) OVER (PARTITION BY series_id) AS e FROM e), k AS (SELECT series_id, count(*) AS n, exp(-count(*) / 6 * ((avg(e ^ 3) / avg(e ^ 2) ^ 1.5) ^ 2 + (avg(e ^ 4) / avg(e ^ 2) ^ 2 - 3) ^ 2 / 4) / 2) AS p FROM m GROUP BY series_id HAVING count(*) > 20) SELECT CAST(series_id % 3 = 0 AS BIGINT) AS has_break, count(*) AS series, round(avg(CASE WHEN p > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS normal, round(avg(p), 6) AS mean_p FROM k WHERE p IS NOT NULL GROUP BY 1")

# --- around the boundary ------------------------------------------------------------------------------------------
register("cusum_path", planted, profiles.cusum_path_at_boundary, B + RESIDUALS + ", f1 AS (SELECT series_id, min(t) AS f FROM e WHERE period = 1 GROUP BY series_id) SELECT series_id, round(sum(e) / sqrt(any_value(rss) / (any_value(n) - 1)), 5) AS path, round(sum(e ^ 2) / any_value(rss), 5) AS squares FROM e JOIN f1 USING (series_id) WHERE t <= f GROUP BY series_id", 5)
register("accepted_split", planted, profiles.accepted_split, B + f", p AS ({ORACLES['binseg_split']}), b AS (SELECT series_id, min(t) FILTER (WHERE period = 1) AS b, count(*) FILTER (WHERE period = 1) AS n1 FROM s GROUP BY series_id) SELECT series_id, CASE WHEN k >= b AND k < b + floor(n1 * 0.3) THEN k END AS k FROM p JOIN b USING (series_id)")
_COUNTS = "count(*) FILTER (WHERE period = 0) AS n0, count(*) FILTER (WHERE period = 1) AS n1"
register("break_gradualness", planted, profiles.gradualness, B + f", g AS (SELECT series_id, {_COUNTS} FROM s GROUP BY series_id), w AS (SELECT series_id, n0, least(10, n0 // 4, n1 // 4) AS w FROM g) SELECT series_id, round(abs(regr_slope(value, t)), 6) AS slope FROM s JOIN w USING (series_id) WHERE w >= 3 AND t >= n0 - w AND t < n0 + w GROUP BY series_id")
_BLOCKS = B + f", g AS (SELECT series_id, count(*) AS n, {_COUNTS} FROM s GROUP BY series_id), b AS (SELECT series_id, size, t // size AS block, stddev_pop(value) AS sd, t // size >= any_value(n0) // size AS late FROM s JOIN g USING (series_id), (VALUES (CAST(5 AS BIGINT)), (10), (20)) z(size) WHERE n >= size * 4 GROUP BY series_id, size, t // size HAVING count(*) = size), k AS (SELECT series_id, size, " + both("count(*) FILTER (WHERE late = (@ = 1)) AS k@, avg(sd) FILTER (WHERE late = (@ = 1)) AS m@, var_pop(sd) FILTER (WHERE late = (@ = 1)) AS v@") + " FROM b GROUP BY series_id, size), ef AS (SELECT series_id, size, k0 + k1 - 2 AS df, (m0 - m1) / nullif(sqrt((k0 * v0 + k1 * v1) / (k0 + k1 - 2) * (1 / k0 + 1 / k1)), 0) AS t, abs(m1 - m0) / nullif(sqrt((v0 + v1) / 2), 0) AS effect FROM k WHERE k0 > 2 AND k1 > 2)"
register("block_effects", planted, profiles.block_effects, _BLOCKS + f" SELECT series_id, size, df, {r('t', 't', 5)}, {r('effect', 'effect', 5)} FROM ef", 5)
register("dominant_block", planted, lambda s: profiles.dominant_block(profiles.block_effects(s)), _BLOCKS + " SELECT series_id, round(avg(CASE WHEN abs(t) > 2 THEN 1.0 ELSE 0.0 END), 6) AS consistency, arg_max(size, (effect, -size)) FILTER (WHERE abs(t) > 2) AS dominant_size FROM ef GROUP BY series_id")
_ROLLED = ORACLES["rolling_boundary"].split(" SELECT series_id, round(")[0].replace("avg(z.value) AS m", "stddev_samp(z.value) AS m").replace("mean_before", "std_before").replace("mean_after", "std_after")
register("rolling_spread_boundary", user_series, profiles.rolling_spread_boundary, _ROLLED + " SELECT series_id, " + ", ".join((r("std_before", "std_before", 5), r("std_after", "std_after", 5), r("std_after - std_before", "std_change", 5), r("std_after / (std_before + 1e-8)", "std_ratio", 5))) + " FROM g", 5)

# --- further tests on the residuals of each period's own fit ------------------------------------------------------
for _name, _operator, _fragment in (("ecdf_distances", distribution.ecdf_distances, ECDF), ("mannwhitney_u", distribution.mann_whitney, RANKED)):
    _sql = ORACLES[_name].removeprefix(U).replace(_fragment, _fragment.replace(" FROM s ", " FROM rs ").replace(" FROM s)", " FROM rs)"))
    register(f"residual_{_name}", user_series, lambda s, _operator=_operator: _operator(regression.period_residuals(s)), U + _OWN.replace(", f AS (SELECT * FROM a JOIN b", ", ft AS (SELECT * FROM a JOIN b").replace("JOIN f USING", "JOIN ft USING") + _sql)

# --- samples and windows ------------------------------------------------------------------------------------------
register("series_ids", planted, lambda s: datasets.labels_of(s), B + " SELECT series_id, bool_or(has_break) AS has_break FROM s GROUP BY series_id")
register("point_lookup", planted, lambda s: datasets.one_series(s, 3).select("series_id", "t", "value", "period"), B + " SELECT series_id, t, round(value, 6) AS value, period FROM s WHERE series_id = 3")
register("positive_sample", planted, lambda s: datasets.class_sample(datasets.labels_of(s), True, 5), B + _LABELS + " SELECT series_id, has_break FROM h WHERE has_break ORDER BY h, series_id LIMIT 5")
register("negative_sample", planted, lambda s: datasets.class_sample(datasets.labels_of(s), False, 5), B + _LABELS + " SELECT series_id, has_break FROM h WHERE NOT has_break ORDER BY h, series_id LIMIT 5")
_MARKED = E + _WINDOWS.format(size=100, stride=20) + ", m AS (SELECT series_id, window_start, CASE WHEN window_start + 10 <= boundary AND boundary <= window_start + 90 THEN boundary - window_start END AS break_position, md5(series_id || ':' || window_start || ':42') AS h FROM w)"
_MARKED_WINDOWS = lambda s: datasets.marked_windows(s, 100, 20)
register("window_encodings", type_series, lambda s: datasets.break_encodings(_MARKED_WINDOWS(s), 100), _MARKED + " SELECT series_id, window_start, round(coalesce(break_position / 100, -1), 6) AS break_code FROM m")
register("balanced_windows", type_series, lambda s: datasets.balanced_windows(_MARKED_WINDOWS(s).drop("window")), _MARKED + ", n AS (SELECT count(break_position) // 3 * 7 + count(break_position) % 3 * 7 // 3 AS want FROM m) SELECT series_id, window_start, break_position FROM m WHERE break_position IS NOT NULL UNION ALL SELECT series_id, window_start, break_position FROM (SELECT m.*, want, row_number() OVER (ORDER BY h, series_id, window_start) AS k FROM m, n WHERE break_position IS NULL) WHERE k <= want")
register("window_distribution", type_series, lambda s: datasets.window_distribution(_MARKED_WINDOWS(s)), _MARKED + ", c AS (SELECT series_id, count(*) AS k FROM m GROUP BY series_id) SELECT (SELECT count(*) FROM c) AS series, " + ", ".join(f"(SELECT {r(f'{f}(k)', n).split(' AS ')[0]} FROM c) AS {n}" for f, n in (("avg", "per_series_mean"), ("stddev_pop", "per_series_std"))) + ", (SELECT min(k) FROM c) AS per_series_min, (SELECT max(k) FROM c) AS per_series_max, round(avg(break_position), 6) AS position_mean, round(stddev_pop(break_position), 6) AS position_std, min(break_position) AS position_min, max(break_position) AS position_max, count(break_position) AS with_break, count(*) - count(break_position) AS without_break, round(count(break_position) / count(*), 6) AS break_ratio FROM m")


def _repeated(series: DataFrame) -> DataFrame:
    d = distribution.descriptive(series).select("series_id", "skew_0", "skew_1", F.col("skew_0").alias("skew_copy"))
    return datasets.complete_rows(datasets.without_copies(d, {"skew_copy": "skew_0"}), "all", ["skew_0", "skew_1"])


register("complete_rows", user_series, _repeated, f"SELECT series_id, skew_0, skew_1 FROM ({ORACLES['dist_descriptive']}) d WHERE skew_0 IS NOT NULL OR skew_1 IS NOT NULL")
register("aligned_features", user_series, lambda s: datasets.aligned(distribution.descriptive(s).select("series_id", "mean_diff", "std_diff"), ["mean_diff", "not_there"]), f"SELECT series_id, coalesce(mean_diff, 0) AS mean_diff, CAST(0 AS DOUBLE) AS not_there FROM ({ORACLES['dist_descriptive']}) d")
register("common_features", user_series, lambda s: datasets.stacked_common(distribution.descriptive(s).select("series_id", "mean_0", "std_0"), distribution.descriptive(s).select("series_id", "mean_0", "skew_0")), f"SELECT series_id, mean_0 FROM ({ORACLES['dist_descriptive']}) a UNION ALL SELECT series_id, mean_0 FROM ({ORACLES['dist_descriptive']}) b")

# --- summary of a data set ------------------------------------------------------------------------------------------
_PER = ", p AS (SELECT series_id, bool_or(has_break) AS b, CAST(count(*) AS DOUBLE) AS length, " + both("avg(value) FILTER (WHERE period = @) AS m@, stddev_samp(value) FILTER (WHERE period = @) AS s@, CAST(count(*) FILTER (WHERE period = @) AS DOUBLE) AS k@") + ", avg(value) AS series_mean, stddev_samp(value) AS series_std FROM s GROUP BY series_id), q AS (SELECT series_id, b, length, k0 AS before, k1 AS after, CASE WHEN k1 > 0 THEN k0 / k1 END AS ratio, series_mean, series_std, m1 - m0 AS dm, s1 - s0 AS ds FROM p)"
_BOTH = lambda name, x: f"{r(f'avg({x})', f'{name}_mean')}, {r(f'stddev_samp({x})', f'{name}_std')}"
_CHANGES = ", ".join(f"round({f}({c}) FILTER (WHERE {hit}), 6) AS {n}_{c}_{k}" for c in ("dm", "ds") for n, hit in (("break", "b"), ("other", "NOT b")) for f, k in (("avg", "mean"), ("stddev_samp", "std")))
register("dataset_summary", planted, profiles.summary, B + _PER + ", z AS (SELECT " + _BOTH("value", "value") + " FROM s), y AS (SELECT count(*) AS series, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) AS break_ratio, " + ", ".join(_BOTH(c, c) for c in ("length", "before", "after", "ratio", "series_mean", "series_std")) + f", min(length) AS length_min, max(length) AS length_max, {_CHANGES} FROM q) SELECT * FROM y, z")
_WELCH = "(v0 / n0 + v1 / n1)"
register("class_t_tests", planted, lambda s: profiles.class_t_tests(s).drop("p"), B + _PER + ", l AS (SELECT b, 'dm' AS change, dm AS x FROM q UNION ALL SELECT b, 'ds', ds FROM q), g AS (SELECT change, " + both("count(x) FILTER (WHERE CAST(b AS INTEGER) = @) AS n@, avg(x) FILTER (WHERE CAST(b AS INTEGER) = @) AS m@, var_samp(x) FILTER (WHERE CAST(b AS INTEGER) = @) AS v@") + f" FROM l GROUP BY change) SELECT change, {r(f'(m1 - m0) / sqrt({_WELCH})', 't', 5)}, {r(f'{_WELCH} ^ 2 / ((v0 / n0) ^ 2 / (n0 - 1) + (v1 / n1) ^ 2 / (n1 - 1))', 'df', 5)} FROM g", 5)
