"""Queries on embedded series, with the same computation in DuckDB's SQL where it has the means."""

from __future__ import annotations

from riftline.operators import embedding
from riftline.plans.lag_queries import ar_sql
from riftline.plans.series_queries import B, E, U, both, planted, r, register
from riftline.sources.series import type_series, user_series

_APEN = (
    ", i AS (SELECT series_id, period, row_number() OVER o AS i, value AS a, lead(value) OVER o AS b, lead(value, 2) OVER o AS c, 0.2 * stddev_pop(value) OVER w AS r, count(*) OVER w AS n FROM s WINDOW o AS (PARTITION BY series_id, period ORDER BY t), w AS (PARTITION BY series_id, period))"
    ", p AS (SELECT x.series_id, x.period, x.i, any_value(x.n) AS n, count(*) AS k2, count(*) FILTER (WHERE abs(x.c - y.c) <= x.r) AS k3 FROM i x JOIN i y ON x.series_id = y.series_id AND x.period = y.period AND abs(x.a - y.a) <= x.r AND abs(x.b - y.b) <= x.r WHERE x.r > 0 AND x.n > 4 GROUP BY ALL)"
    ", e AS (SELECT series_id, period, avg(ln(k2 / (n - 1))) - avg(ln(k3 / (n - 2))) FILTER (WHERE k3 > 0) AS e FROM p GROUP BY ALL), z AS (SELECT series_id, " + both("max(e) FILTER (WHERE period = @) AS e@") + " FROM e GROUP BY series_id), n AS (SELECT DISTINCT series_id FROM s)"
)
APEN = U + _APEN + f" SELECT series_id, {r('e0', 'apen_0', 5)}, {r('e1', 'apen_1', 5)}, {r('e1 - e0', 'apen_diff', 5)} FROM n LEFT JOIN z USING (series_id)"
register("approx_entropy", user_series, embedding.approximate_entropy, APEN, 5)

register("factor_break", type_series, embedding.factors, None)
register("factor_scan", user_series, embedding.factor_scan, None)

_LAGS = ", ".join(f"lag(value, {j}) OVER (PARTITION BY series_id, period ORDER BY t) AS x{j}" for j in (1, 2, 3))
_PAIRS = [(a, b) for k, a in enumerate(("value", "x1", "x2", "x3")) for b in ("value", "x1", "x2", "x3")[k + 1 :]]
_CORRELATED = "cr AS (SELECT series_id, " + ", ".join(f"abs(corr({a}, {b}) FILTER (WHERE period = 1) - corr({a}, {b}) FILTER (WHERE period = 0)) AS c{k}" for k, (a, b) in enumerate(_PAIRS)) + f" FROM (SELECT series_id, period, value, {_LAGS} FROM s) WHERE x3 IS NOT NULL GROUP BY series_id)"
_CHANGES = [f"c{k}" for k in range(len(_PAIRS))]
_FIT = "a AS (SELECT series_id, sum(y * y) AS rss FROM w3 GROUP BY series_id), y0 AS (SELECT series_id, " + both("sum(y * y) FILTER (WHERE period = @) AS rss@, count(*) FILTER (WHERE period = @) AS n@") + " FROM o3 GROUP BY series_id), t0 AS (SELECT series_id, " + both("sum(y * y) FILTER (WHERE period = @) AS yy@") + " FROM o3_0 GROUP BY series_id)"
register(
    "factor_regression", planted, embedding.factor_regression,
    B + ar_sql(3, "w3", False) + ar_sql(3, "o3", True) + f", {_FIT}, {_CORRELATED} SELECT series_id, {r('1 - rss0 / yy0', 'r2_0', 5)}, {r('1 - rss1 / yy1', 'r2_1', 5)}, {r('rss0 / yy0 - rss1 / yy1', 'r2_diff', 5)}, CASE WHEN n0 + n1 > 8 THEN round((rss - rss0 - rss1) / 4 / ((rss0 + rss1) / (n0 + n1 - 8)), 5) END AS chow, {r('(' + ' + '.join(_CHANGES) + ') / 6', 'correlation_change', 5)}, {r('greatest(' + ', '.join(_CHANGES) + ')', 'correlation_change_max', 5)} FROM a JOIN y0 USING (series_id) JOIN t0 USING (series_id) JOIN cr USING (series_id)", 5,
)
register("supf_lags_argmax", planted, lambda s: embedding.sup_f_lags(s, 2), None, 5)

_SEGMENTS = ", c AS (SELECT series_id, period, row_number() OVER (PARTITION BY series_id, period ORDER BY t) - 1 AS i, value - avg(value) OVER (PARTITION BY series_id, period) AS x FROM s), g AS (SELECT *, i // 64 AS segment, i % 64 AS j, count(*) OVER (PARTITION BY series_id, period, i // 64) AS size FROM c)"
_POWERS = ", w AS (SELECT series_id, period, segment, k, (sum(x * cos(2 * pi() * ((j * k) % 64) / 64)) ^ 2 + sum(x * sin(2 * pi() * ((j * k) % 64) / 64)) ^ 2) / 64 AS p FROM g, range(1, 33) q(k) WHERE size = 64 GROUP BY ALL), m AS (SELECT series_id, period, k, avg(p) AS p FROM w GROUP BY ALL), u AS (SELECT *, k / 64 AS f, sum(p) OVER e AS total, sum(p) OVER (PARTITION BY series_id, period ORDER BY k) AS run, sum(k / 64 * p) OVER e / nullif(sum(p) OVER e, 0) AS centre FROM m WINDOW e AS (PARTITION BY series_id, period))"
_SIDE = "sum(p) FILTER (WHERE period = @ AND k <= 8) AS low_@, sum(p) FILTER (WHERE period = @ AND k BETWEEN 9 AND 16) AS mid_@, sum(p) FILTER (WHERE period = @ AND k > 16) AS high_@, sum(p) FILTER (WHERE period = @) AS energy_@, max(centre) FILTER (WHERE period = @) AS centroid_@, sqrt(sum((f - centre) ^ 2 * p) FILTER (WHERE period = @) / nullif(sum(p) FILTER (WHERE period = @), 0)) AS bandwidth_@, min(f) FILTER (WHERE period = @ AND round(run - 0.85 * total, 9) >= 0) AS rolloff_@, arg_max(f, (round(p, 9), -k)) FILTER (WHERE period = @) AS dominant_@"
_NAMES = ["low", "mid", "high", "energy", "centroid", "bandwidth", "rolloff", "dominant"]
register(
    "band_energies", type_series, embedding.band_energies,
    E + _SEGMENTS + _POWERS + f", z AS (SELECT series_id, {both(_SIDE)} FROM u GROUP BY series_id) SELECT series_id, " + both(", ".join(r(f"{n}_@", f"{n}_@", 4) for n in _NAMES)) + f", {r('energy_1 / energy_0', 'energy_ratio', 4)}, " + ", ".join(r(f"{n}_1 - {n}_0", f"{n}_diff", 4) for n in _NAMES[4:]) + " FROM z", 4,
)
