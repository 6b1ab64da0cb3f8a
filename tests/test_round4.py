"""Statements of the fourth round's findings."""

import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from riftline.catalog import ORACLES, QUERIES
from riftline.operators import shape
from riftline.plans import features, model_queries


def stored(folder, series: dict[int, tuple[list, list]]) -> str:
    """A folder with an events table of series, each given by the values of its two periods."""
    rows = [(u, i, 22 * (i >= len(a)), float(x)) for u, (a, b) in series.items() for i, x in enumerate(a + b)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (user_id BIGINT, event_id BIGINT, d INTEGER, value DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_days(d) + to_seconds(event_id) AS ts, user_id, 'view' AS event_type, value, '{{}}' AS props FROM e) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def differing(spark, sf_dir: str, name: str) -> list:
    """Rows of a query that its SQL hasn't, and rows of the SQL that the query hasn't."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    return sorted(set(map(tuple, QUERIES[name](spark, sf_dir).select(*names).collect())) ^ set(want.fetchall()), key=str)


def test_chow_of_short_periods_and_of_exact_fits_is_the_sql(spark, tmp_path):
    """Periods with no row of their own, alone or both, and periods of one value each."""
    values = [27.35, 100.31, 12.7, 34.92, 40.98, 168.78, 215.27, 14.22, 19.97, 22.01, 32.8, 22.58, 6.96, 36.68, 55.4, 86.66, 132.16, 39.02, 75.07, 96.1, 32.03, 13.8, 86.13, 40.45]
    series = {0: (values, values[3:8]), 1: (values[:4], values), 2: (values[:4], values[5:9]), 3: ([5.0] * 20, [7.0] * 20), 4: (values, values[::-1]), 5: (values[:1], values[5:6]), 6: (values, [])}
    folder = stored(tmp_path, series)
    assert not differing(spark, folder, "chow_f_lags")
    rows = {(r["series_id"], r["lags"]): r for r in QUERIES["chow_f_lags"](spark, folder).collect()}
    assert rows[0, 5]["n_1"] == 0 and rows[0, 5]["rss_1"] is None and rows[0, 5]["chow_f"] is None and (2, 5) not in rows and rows[3, 1]["chow_f"] == float("inf")


def test_residuals_of_as_many_rows_as_coefficients_have_no_order(spark, tmp_path):
    """The second period's six rows are fitted exactly by five lags: the residuals are ties, however close to one plane the lags lie."""
    before = [9.73, 0.76, 33.37, 3.41, 39.91, 26.32, 1.91, 64.19, 72.06, 10.66, 12.22, 32.95, 61.83, 109.67, 20.71, 75.5, 59.25, 36.97, 7.1, 1.24, 74.75, 183.46, 82.54, 58.24, 2.46, 13.73, 20.7, 138.07, 12.95, 5.97, 301.53, 24.83, 8.15, 188.51, 59.54, 42.71, 15.57, 126.84, 18.11]
    after = [16.18, 241.89, 34.84, 8.52, 18.21, 24.24, 81.5, 0.84, 10.37, 111.24, 88.26]
    assert not differing(spark, stored(tmp_path, {118: (before, after)}), "residual5_cramervonmises")


def test_regimes_of_equal_spreads_at_the_quartile_are_exact(spark):
    """Values that return every 20 steps: from the 20th on all spreads are equal, and are the quartile; exact fractions say how often it is crossed."""
    rows, want, r = [], {}, random.Random(5)
    for k in range(12):
        once = [r.randint(0, 20_000) for _ in range(20)]
        values = [once[t % 20] for t in range(64)]
        rows += [(k, t, x / 100, 0) for t, x in enumerate(values)]
        windows = [values[max(0, t - 19) : t + 1] for t in range(4, 64)]
        spreads = [Fraction(sum(x * x for x in w) - Fraction(sum(w) ** 2, len(w)), len(w) - 1) for w in windows]
        low, high = sorted(spreads)[44:46]  # the quartile of 60 spreads lies between these
        if low == high:
            above = [s > low for s in spreads]
            want[k] = sum(a != b for a, b in zip(above, above[1:]))
    got = {x["series_id"]: x["flips"] for x in shape.spread_regimes(spark.createDataFrame(rows, "series_id long, t long, value double, period int")).collect()}
    assert len(want) > 6 and all(got[k] == n for k, n in want.items())


class Asked(Exception):
    """Thrown in place of the matrix, with the extractors asked for."""


@pytest.mark.parametrize("name", ["five_models_auc", "augmented_gain", "cv_metrics", "stacked_auc", "logistic_cv_auc", "gbt_cv_auc"])
def test_models_learn_from_all_extractors(spark, monkeypatch, name):
    def asked(series, names=tuple(features.EXTRACTORS)):
        raise Asked(*names)

    monkeypatch.setattr(features, "feature_matrix", asked)
    with pytest.raises(Asked) as e:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert e.value.args == tuple(features.EXTRACTORS)


def test_search_has_the_tries_and_folds_of_the_reference(spark, monkeypatch):
    """Twenty tries, of which the first eight are drawn evenly and scored together, each in five folds."""
    tried, together = [], []
    monkeypatch.setattr(model_queries, "_matrix", lambda *a: spark.createDataFrame([(k, float(k % 2), k * 0.1) for k in range(10)], "series_id long, label double, x double"))
    monkeypatch.setattr(features, "in_folds", lambda m, k: m)
    monkeypatch.setattr(features, "scored", lambda m, k, kind, **p: tried.append(k) or m)
    monkeypatch.setattr(features.evaluation, "auc", lambda scores: spark.range(1).select(F.lit(0.5).alias("auc")))
    monkeypatch.setattr(features, "together", lambda spark, run, items: together.append(len(items)) or [run(x) for x in items])
    rows = QUERIES["tpe_auc"](spark, "").collect()
    assert [r["try"] for r in rows] == list(range(20)) and tried == [5] * 20 and together == [8] + [1] * 12
