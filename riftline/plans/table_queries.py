"""Queries on whole tables of series: unions, lookups, samples by rank, padded and standardised windows, effect sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.operators import datasets, distribution, evaluation, shape
from riftline.plans import features, selection
from riftline.plans.series_queries import COUNTS, ORACLES, TESTABLE, B, E, U, both, planted, r, register
from riftline.sources.checkpoints import shared_folder
from riftline.sources.feature_store import cached
from riftline.sources.series import from_arrays, to_arrays, type_series, user_series, with_labels

SIZE, STRIDE = 60, 20


def _labelled_half(series: DataFrame) -> DataFrame:
    """Lengths with labels that only series of even id have."""
    labels = datasets.labels_of(series).where("series_id % 2 = 0")
    return with_labels(series.drop("has_break"), labels).groupBy("series_id").agg(F.first("has_break").alias("has_break"), F.count("*").alias("n"))


def _untested(series: DataFrame) -> DataFrame:
    return features.rejected(series, distribution.student_t(series).where("t IS NOT NULL"))


def _strongest(series: DataFrame) -> DataFrame:
    t = distribution.student_t(series).select("series_id", F.round("t", 6).alias("t"))
    return t.where("t IS NOT NULL").orderBy(F.abs("t").desc(), "series_id").limit(10)


def _filled_t(series: DataFrame) -> DataFrame:
    return features.filled(distribution.student_t(series).select("series_id", "t"))


def _return_profile(series: DataFrame) -> DataFrame:
    g = shape.log_returns(series).groupBy("series_id", F.col("period").cast("long").alias("period"))
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _changes(series: DataFrame) -> DataFrame:
    labels = datasets.labels_of(series).select("series_id", F.col("has_break").cast("int").alias("label"))
    return distribution.descriptive(series).select("series_id", "mean_diff", "std_diff").join(labels, "series_id")


def _buckets(series: DataFrame) -> DataFrame:
    return evaluation.signal_buckets(_changes(series).select("series_id", "label", F.col("mean_diff").alias("score")))


def _padded_sums(series: DataFrame) -> DataFrame:
    w = datasets.inference_windows(series, SIZE, STRIDE)
    return w.select("series_id", "window_start", F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _standardised_sums(series: DataFrame) -> DataFrame:
    z = datasets.standardised(datasets.sliding_windows(series, 100, STRIDE))
    return z.groupBy("series_id", "window_start").agg(F.sum("z").alias("z"))


register("series_to_long", user_series, lambda s: from_arrays(to_arrays(s)), U + " SELECT series_id, t, round(value, 6) AS value, period FROM s")
register("label_lookup", planted, _labelled_half, B + " SELECT series_id, CASE WHEN series_id % 2 = 0 THEN any_value(has_break) END AS has_break, count(*) AS n FROM s GROUP BY series_id")
register("untested_series", user_series, _untested, U + COUNTS + f" SELECT series_id FROM c WHERE ({TESTABLE}) IS NOT TRUE")
register("strongest_series", user_series, _strongest, f"SELECT series_id, t FROM ({ORACLES['ttest_stat']}) q WHERE t IS NOT NULL ORDER BY abs(t) DESC, series_id LIMIT 10")
_T = U + COUNTS + f", st AS (SELECT series_id, CASE WHEN {TESTABLE} THEN (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) END AS t FROM c)"
register("median_filled", user_series, _filled_t, _T + f" SELECT series_id, {r('coalesce(t, (SELECT quantile_cont(t, 0.5) FROM st), 0)', 't', 5)} FROM st", 5)

_LAG = ", b AS (SELECT *, lag(value) OVER (PARTITION BY series_id, period ORDER BY t) AS prev FROM s)"
register("log_returns", user_series, _return_profile, U + _LAG + ", x AS (SELECT series_id, period, ln(value) - ln(prev) AS x FROM b WHERE prev > 0 AND value > 0) SELECT series_id, CAST(period AS BIGINT) AS period, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY ALL")
_SPREADS = both("stddev_pop(value - prev) FILTER (WHERE period = @) AS d@, stddev_pop(value) FILTER (WHERE period = @) AS v@, stddev_pop(s5) FILTER (WHERE period = @) AS s@")
register("vol_timescales", user_series, shape.timescales, U + _LAG + ", w AS (SELECT *, CASE WHEN count(*) OVER k = 5 THEN stddev_pop(value) OVER k END AS s5 FROM b WINDOW k AS (PARTITION BY series_id, period ORDER BY t ROWS 4 PRECEDING)), g AS (SELECT series_id, " + _SPREADS + " FROM w GROUP BY series_id) SELECT series_id, " + ", ".join(r(f"{c}1 / nullif({c}0, 0)", n) for c, n in (("d", "difference_ratio"), ("v", "spread_ratio"), ("s", "vol_of_vol_ratio"))) + " FROM g")
_SPLIT = ", ".join(f"{f}(value) FILTER (WHERE s.t {c} b.k) AS {n}" for n, f, c in (("m0", "avg", "<"), ("m1", "avg", ">="), ("s0", "stddev_pop", "<"), ("s1", "stddev_pop", ">=")))
register("detected_break", planted, shape.at_detected_break, B + f", b AS ({ORACLES['binseg_split']}), g AS (SELECT s.series_id, any_value(b.k) AS k, count(*) AS n, {_SPLIT} FROM s JOIN b ON s.series_id = b.series_id GROUP BY s.series_id) SELECT series_id, round(k / n, 6) AS location, round(abs(m1 - m0), 6) AS mean_gap, round(abs(s1 - s0), 6) AS spread_gap FROM g")

_CHANGES = ", g AS (SELECT series_id, any_value(has_break) AS b, avg(value) FILTER (WHERE period = 1) - avg(value) FILTER (WHERE period = 0) AS mean_diff, stddev_pop(value) FILTER (WHERE period = 1) - stddev_pop(value) FILTER (WHERE period = 0) AS std_diff FROM s GROUP BY series_id)"
_D = "SELECT '{c}' AS feature, round((avg({c}) FILTER (WHERE b) - avg({c}) FILTER (WHERE NOT b)) / sqrt(((count({c}) FILTER (WHERE NOT b) - 1) * var_samp({c}) FILTER (WHERE NOT b) + (count({c}) FILTER (WHERE b) - 1) * var_samp({c}) FILTER (WHERE b)) / (count({c}) - 2)), 6) AS d FROM g"
register("cohens_d", planted, lambda s: evaluation.cohens_d(_changes(s), ["mean_diff", "std_diff"]), B + _CHANGES + " " + " UNION ALL ".join(_D.format(c=c) for c in ("mean_diff", "std_diff")))
_QUARTERS = " + ".join(f"(CASE WHEN mean_diff > q{k} THEN 1 ELSE 0 END)" for k in (1, 2, 3))
register("signal_buckets", planted, _buckets, B + _CHANGES + ", q AS (SELECT " + ", ".join(f"quantile_cont(mean_diff, {x}) AS q{k}" for k, x in ((1, 0.25), (2, 0.5), (3, 0.75))) + f" FROM g WHERE b) SELECT CAST(1 + {_QUARTERS} AS BIGINT) AS bucket, count(*) AS n, round(avg(mean_diff), 6) AS mean_score FROM g CROSS JOIN q WHERE b AND mean_diff IS NOT NULL GROUP BY 1")

_N = ", n AS (SELECT series_id, count(*) AS n FROM s GROUP BY series_id)"
_STARTS = ", st AS (SELECT series_id, n, unnest(range(0, {last} + 1, {stride})) AS window_start FROM n), j AS (SELECT unnest(range({size})) AS j)"
register("inference_windows", user_series, _padded_sums, U + _N + _STARTS.format(last=f"greatest(n - {SIZE}, 0)", stride=STRIDE, size=SIZE) + " SELECT st.series_id, st.window_start, round(sum(s.value), 3) AS total FROM st CROSS JOIN j JOIN s ON s.series_id = st.series_id AND s.t = least(st.window_start + j.j, st.n - 1) GROUP BY ALL", 3)
register("standardised_windows", type_series, _standardised_sums, E + _N + _STARTS.format(last="n - 100", stride=STRIDE, size=100) + ", c AS (SELECT st.series_id, st.window_start, j.j, s.value FROM st CROSS JOIN j JOIN s ON s.series_id = st.series_id AND s.t = st.window_start + j.j WHERE st.n >= 100), p AS (SELECT j, avg(value) AS m, stddev_pop(value) AS d FROM c GROUP BY j) SELECT series_id, window_start, round(sum((value - m) / nullif(d, 0)), 4) AS z FROM c JOIN p USING (j) GROUP BY ALL", 4)

# --- information of features on the label, in ten bins of equal counts -------------------------------------------------
_BINNED = lambda c: f"q_{c} AS (SELECT " + ", ".join(f"quantile_cont({c}, {k / 10}) AS q{k}" for k in range(1, 10)) + f" FROM g), b_{c} AS (SELECT '{c}' AS feature, " + " + ".join(f"CASE WHEN {c} > q{k} THEN 1 ELSE 0 END" for k in range(1, 10)) + f" AS bin, b AS label FROM g, q_{c} WHERE {c} IS NOT NULL)"
_COUNTED = "k AS (SELECT feature, bin, label, count(*) AS k FROM (SELECT * FROM b_mean_diff UNION ALL SELECT * FROM b_std_diff) GROUP BY ALL), i AS (SELECT feature, k / sum(k) OVER (PARTITION BY feature) * ln(k * sum(k) OVER (PARTITION BY feature) / (sum(k) OVER (PARTITION BY feature, bin) * sum(k) OVER (PARTITION BY feature, label))) AS i FROM k)"
register("mi_scores", planted, lambda s: selection.mutual_information(_changes(s), ["mean_diff", "std_diff"]), B + _CHANGES + f", {_BINNED('mean_diff')}, {_BINNED('std_diff')}, {_COUNTED} SELECT feature, {r('sum(i)', 'information')} FROM i GROUP BY feature")


# --- a store that holds some of the series already -------------------------------------------------------------------
def _from_store(series: DataFrame) -> DataFrame:
    """Descriptive features by way of a store that was filled from the series before a break was planted in every third."""
    place = f"{shared_folder(series.sparkSession)}/features-{uuid.uuid4()}"
    before = series.withColumn("value", F.when(F.col("has_break") & (F.col("period") == 1), F.col("value") - 25.0).otherwise(F.col("value")))
    cached(before, place, "descriptive", distribution.descriptive)
    return cached(series, place, "descriptive", distribution.descriptive)


register("cached_features", planted, _from_store, ORACLES["dist_descriptive"].replace(U, B, 1))
