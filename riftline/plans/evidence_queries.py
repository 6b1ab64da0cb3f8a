"""Queries on probabilities of a break, with the same computation in DuckDB's SQL."""

from __future__ import annotations

from riftline.operators import evidence
from riftline.plans.embedding_queries import APEN
from riftline.plans.series_queries import ORACLES, B, U, both, planted, r, register

_MEDIANS = ", x AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS x FROM s), q AS (SELECT series_id, quantile_cont(value, 0.5) AS q, " + both("quantile_cont(value, 0.5) FILTER (WHERE period = @) AS q@") + " FROM s GROUP BY series_id), d AS (SELECT x.*, abs(value - q) AS d, abs(value - CASE WHEN period = 0 THEN q0 ELSE q1 END) AS own FROM x JOIN q USING (series_id))"


def _part(k: str) -> str:
    f = f" FILTER (WHERE period = {k})" if k else ""
    own = "own" if k else "d"
    rest = lambda x: f"(regr_syy(value, {x}){f} - coalesce(CASE WHEN regr_sxx(value, {x}){f} > 0 THEN regr_sxy(value, {x}){f} ^ 2 / regr_sxx(value, {x}){f} END, 0))"
    return f"CAST(count(value){f} AS DOUBLE) AS n{k}, avg(value){f} AS m{k}, var_pop(value){f} AS v{k}, {rest('t')} AS trend{k}, {rest('x')} AS ar{k}, sum({own}){f} AS l{k}, quantile_cont({own}, 0.5){f} AS mad{k}"


_GAUSS = lambda n, ss, v: f"(-{n} / 2 * ln(2 * pi() * greatest({v}, 1e-12)) - {ss} / (2 * greatest({v}, 1e-12)))"
_LAPLACE = lambda k: f"(-n{k} * ln(2 * greatest(1.4826 * mad{k}, 1e-6)) - l{k} / greatest(1.4826 * mad{k}, 1e-6))"
_AROUND = lambda k: _GAUSS(f"n{k}", f"(n{k} * (v{k} + (m{k} - m) ^ 2))", f"v{k}")
_OWN = lambda k: _GAUSS(f"n{k}", f"(n{k} * v{k})", f"v{k}")
_AIC = lambda ll, k, n: f"(2 * {k} - 2 * {ll} + CASE WHEN {n} / {k} < 40 THEN 2.0 * {k} * ({k} + 1) / ({n} - {k} - 1) ELSE 0 END)"
_WHOLE = _GAUSS("n", "(n * v)", "v")
_LINES = lambda k, n: (_GAUSS(n, k, f"({k} / {n})"), _GAUSS(n, f"(coalesce({k}0, 0) + coalesce({k}1, 0))", f"((coalesce({k}0, 0) + coalesce({k}1, 0)) / {n})"))
_FITS = {
    "mean": (_AIC(_WHOLE, 2, "n"), _AIC(_GAUSS("n", "(n0 * v0 + n1 * v1)", "v"), 3, "n"), "n0 >= 10 AND n1 >= 10"),
    "variance": (_AIC(_WHOLE, 2, "n"), _AIC(f"({_AROUND('0')} + {_AROUND('1')})", 3, "n"), "n0 >= 10 AND n1 >= 10"),
    "mean_variance": (_AIC(_WHOLE, 2, "n"), _AIC(f"({_OWN('0')} + {_OWN('1')})", 4, "n"), "n0 >= 10 AND n1 >= 10"),
    "trend": (_AIC(_LINES("trend", "n")[0], 3, "n"), _AIC(_LINES("trend", "n")[1], 5, "n"), "n0 >= 10 AND n1 >= 10"),
    "ar": (_AIC(_LINES("ar", "(n - 1)")[0], 3, "(n - 1)"), _AIC(_LINES("ar", "(n - 1)")[1], 5, "(n - 1)"), "n0 >= 11 AND n1 >= 10 AND n >= 20"),
    "scale": (_AIC(_LAPLACE(""), 2, "n"), _AIC(f"({_LAPLACE('0')} + {_LAPLACE('1')})", 4, "n"), "n0 >= 10 AND n1 >= 10"),
}
_P = "CASE WHEN NOT coalesce(ok_{m}, false) THEN 0 WHEN b_{m} - a_{m} < -10 THEN 0.99 WHEN b_{m} - a_{m} > 10 THEN 0.01 ELSE greatest(least(1 / (1 + exp((b_{m} - a_{m}) / 2)), 0.99), 0.01) END"
_COMPARED = B + _MEDIANS + ", g AS (SELECT series_id, " + ", ".join(_part(k) for k in ("", "0", "1")) + " FROM d GROUP BY series_id HAVING count(*) >= 2), a AS (SELECT series_id, " + ", ".join(f"({ok}) AS ok_{m}, CASE WHEN {ok} THEN {a} END AS a_{m}, CASE WHEN {ok} THEN {b} END AS b_{m}" for m, (a, b, ok) in _FITS.items()) + " FROM g), p AS (SELECT series_id, " + ", ".join(f"CAST({_P.format(m=m)} AS DOUBLE) AS {m}, least(a_{m}, b_{m}) AS w_{m}" for m in _FITS) + " FROM a), z AS (SELECT *, least(" + ", ".join(f"w_{m}" for m in _FITS) + ") AS best FROM p)"
_WEIGHT = lambda m: f"coalesce(exp((best - w_{m}) / 2), 0)"
register("segment_models", planted, evidence.segment_models, _COMPARED + " SELECT series_id, " + ", ".join(r(m, m, 5) for m in _FITS) + ", " + r("greatest(" + ", ".join(_FITS) + ")", "max", 5) + ", " + r("(" + " + ".join(_FITS) + ") / 6", "average", 5) + ", " + r("coalesce((" + " + ".join(f"{_WEIGHT(m)} * {m}" for m in _FITS) + ") / nullif(" + " + ".join(map(_WEIGHT, _FITS)) + ", 0), 0)", "weighted", 5) + " FROM z", 5)

_STEPS = lambda x, steps, none: f"CASE WHEN ({x}) IS NULL THEN NULL " + " ".join(f"WHEN ({x}) > {b} THEN {e}" for b, e in steps) + f" ELSE {none} END"
_RELATIVE = lambda k: f"CASE WHEN {k}0 + {k}1 > 1e-8 THEN abs({k}1 - {k}0) / ({k}0 + {k}1 + 1e-8) END"
_MEAN = lambda parts: "coalesce(list_avg([" + ", ".join(parts) + "]), 0)"
_ROLLED = ", rl AS (SELECT *, value - lag(value) OVER o AS r, CASE WHEN size > 10 THEN CASE least(size // 3, 5) " + " ".join(f"WHEN {k} THEN CASE WHEN count(*) OVER w{k} = {k} THEN stddev_pop(value) OVER w{k} END" for k in (3, 4, 5)) + " END END AS sd FROM (SELECT *, count(*) OVER (PARTITION BY series_id, period) AS size FROM d) WINDOW o AS (PARTITION BY series_id, period ORDER BY t), " + ", ".join(f"w{k} AS (PARTITION BY series_id, period ORDER BY t ROWS {k - 1} PRECEDING)" for k in (3, 4, 5)) + ")"
_SIDE = "count(*) FILTER (WHERE period = @) AS n@, quantile_cont(own, 0.5) FILTER (WHERE period = @) AS mad@, " + ", ".join(f"quantile_cont(value, 0.{k}) FILTER (WHERE period = @) AS q{k}@" for k in (1, 5, 9)) + ", " + ", ".join(f"avg(CASE WHEN d > {k / 2} * mad THEN 1.0 ELSE 0.0 END) FILTER (WHERE period = @) AS x{k}@" for k in (4, 5, 6)) + ", stddev_pop(r) FILTER (WHERE period = @) AS r@, stddev_pop(value) FILTER (WHERE period = @) AS v@, coalesce(stddev_pop(sd) FILTER (WHERE period = @), 0) AS s@, " + ", ".join(f"coalesce(avg(z ^ {p}) FILTER (WHERE period = @) / nullif(avg(z ^ 2) FILTER (WHERE period = @), 0) ^ {q} - {o}, 0) AS {n}@" for n, p, q, o in (("skew", 3, 1.5, 0), ("kurt", 4, 2, 3)))
_MOVED = lambda k: f"CASE WHEN abs(all{k}) > 1e-8 THEN abs(q{k}1 - q{k}0) / abs(all{k}) END"
_KINDS = {
    "quantiles": "coalesce(" + _STEPS(f"({_MOVED(1)} + {_MOVED(9)}) / 2 / ({_MOVED(5)} + 1e-8)", ((3, 0.9), (1.5, 0.7), (1.2, 0.4)), 0.1) + ", 0)",
    "extremes": "CASE WHEN mad < 1e-8 THEN 0 ELSE " + _MEAN([_STEPS(_RELATIVE(f"x{k}"), ((0.5, 0.8), (0.3, 0.6), (0.1, 0.3)), 0.1) for k in (4, 5, 6)]) + " END",
    "moments": "least(0.95, " + _STEPS("abs(skew1 - skew0)", ((1.5, 0.5), (0.5, 0.3)), 0) + " + " + _STEPS("abs(kurt1 - kurt0)", ((2, 0.5), (1, 0.3)), 0) + ")",
    "timescales": _MEAN([_STEPS(_RELATIVE(k), ((0.5, 0.7), (0.3, 0.5), (0.1, 0.2)), 0.05) for k in "rvs"]),
    "location_scale": "CASE WHEN mad < 1e-8 THEN 0 ELSE least(0.95, " + _STEPS("abs(q51 - q50) / mad", ((2, 0.6), (1, 0.4), (0.5, 0.2)), 0) + " + coalesce(" + _STEPS("CASE WHEN mad0 + mad1 > 1e-8 THEN abs(mad1 - mad0) / (mad0 + mad1) END", ((0.5, 0.4), (0.3, 0.2)), 0) + ", 0)) END",
}
_ENOUGH = "n0 >= greatest(floor(n * 0.15), {k}) AND n1 >= greatest(floor(n * 0.15), {k})"
_EVIDENCE = B + _MEDIANS + _ROLLED + ", md AS (SELECT series_id, quantile_cont(d, 0.5) AS mad FROM d GROUP BY series_id), c AS (SELECT rl.*, mad, value - avg(value) OVER (PARTITION BY series_id, period) AS z FROM rl JOIN md USING (series_id)), g AS (SELECT series_id, count(*) AS n, any_value(mad) AS mad, " + ", ".join(f"quantile_cont(value, 0.{k}) AS all{k}" for k in (1, 5, 9)) + ", " + both(_SIDE) + " FROM c GROUP BY series_id), k5 AS (SELECT series_id, n, n0, n1, " + ", ".join(f"CAST(CASE WHEN {_ENOUGH.format(k=15 if k == 'moments' else 10)} THEN {x} ELSE 0 END AS DOUBLE) AS {k}" for k, x in _KINDS.items()) + " FROM g)"
_PATTERNS = ORACLES["perm_entropy"].replace(U, B, 1)
_ENTROPIES = f", pe AS ({_PATTERNS}), ae AS ({APEN.replace(U, B, 1)}), k AS (SELECT k5.*, CAST(CASE WHEN {_ENOUGH.format(k=15)} THEN least(0.95, coalesce({_STEPS('abs(entropy_diff) / log2(6)', ((0.3, 0.5), (0.1, 0.3)), 0)}, 0) + {_STEPS('abs(coalesce(apen_1, 0) - coalesce(apen_0, 0))', ((0.5, 0.5), (0.2, 0.3)), 0)}) ELSE 0 END AS DOUBLE) AS entropy FROM k5 LEFT JOIN pe USING (series_id) LEFT JOIN ae USING (series_id))"
_SIX = [*_KINDS, "entropy"]
_SUMS = {"largest": "greatest(" + ", ".join(_SIX) + ")", "average": "(" + " + ".join(_SIX) + ") / 6", "evidence": "least(0.95, 0.25 * quantiles + 0.20 * entropy + 0.20 * extremes + 0.15 * moments + 0.15 * timescales + 0.05 * location_scale)"}
register("break_evidence", planted, evidence.evidence, _EVIDENCE + _ENTROPIES + " SELECT series_id, " + ", ".join(r(k, k, 5) for k in _SIX) + ", " + ", ".join(r(f"CASE WHEN n < 20 THEN 0.05 ELSE {x} END", k, 5) for k, x in _SUMS.items()) + " FROM k", 5)
