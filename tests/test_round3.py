"""Statements of the third round's findings."""

import math
import threading
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riftline.operators import evidence, grouped, shape
from riftline.plans import features
from riftline.plans.evidence_queries import ORACLES as EVIDENCES
from riftline.plans.model_queries import QUERIES
from riftline.plans.series_queries import ORACLES

EVIDENCE = EVIDENCES["break_evidence"]


def test_reversion_of_short_and_constant_periods_is_the_sql(spark):
    """Periods of one spread, of one pair of spreads and of equal spreads; a series without any pair keeps its row."""
    lengths = {0: (5, 12), 1: (6, 12), 2: (12, 4), 3: (5, 3), 4: (12, 12), 5: (4, 4), 6: (12, 12)}
    rows = []
    for k, (a, b) in lengths.items():
        rows += [(k, t, 29.27 if k == 4 else float((t * t * 7 + k) % 11), int(t >= a)) for t in range(a + b)]
    got = {r["series_id"]: r.asDict() for r in shape.spread_reversion(spark.createDataFrame(rows, "series_id long, t long, value double, period int")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, event_id BIGINT, ts TIMESTAMP, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, TIMESTAMP '2024-01-01' + to_days(CAST(? AS INTEGER)) + to_seconds(?), ?)", [(k, t, 22 * p, t, v) for k, t, v, p in rows])
    cursor = con.execute(ORACLES["vol_mean_reversion"])
    names = [d[0] for d in cursor.description]
    want = {r[0]: dict(zip(names, r, strict=True)) for r in cursor.fetchall()}
    assert got.keys() == want.keys() and 3 in got and 5 not in got
    for k, row in want.items():
        for n, y in row.items():
            x = got[k][n]
            assert x == y or (math.isnan(x) and math.isnan(y)) or abs(x - y) < 1e-6, (k, n, x, y)


def test_evidence_of_a_change_of_regularity_on_its_bound(spark):
    """The approximate entropies, 0.60937 and 0.40937, differ by the bound 0.2, which isn't exceeded."""
    before = [27.35, 100.31, 12.7, 34.92, 40.98, 168.78, 215.27, 14.22, 19.97, 22.01, 32.8, 22.58, 6.96, 36.68, 55.4, 86.66, 132.16, 39.02, 75.07, 96.1, 32.03, 13.8, 86.13, 40.45, 28.58, 47.92, 62.9, 9.83, 18.73, 34.23, 5.72, 59.72, 75.97, 59.69, 42.45, 34.84, 404.27, 20.65]
    after = [7.15, 16.92, 61.11, 13.53, 30.48, 57.68, 122.74, 15.36, 19.32, 169.78, 36.51, 24.95, 53.42, 8.07, 29.86, 0.06, 55.26, 111.12, 22.31, 59.83, 6.86, 69.67, 25.66, 188.27, 223.47, 63.72, 10.06, 18.82]
    rows = [(1, t, v, int(t >= len(before))) for t, v in enumerate(before + after)]
    got = evidence.evidence(spark.createDataFrame(rows, "series_id long, t long, value double, period int")).first()
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, event_id BIGINT, ts TIMESTAMP, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, TIMESTAMP '2024-01-01' + to_days(CAST(? AS INTEGER)) + to_seconds(?), ?)", [(k, t, 22 * p, t, v) for k, t, v, p in rows])
    cursor = con.execute(EVIDENCE)
    want = dict(zip([d[0] for d in cursor.description], cursor.fetchone(), strict=True))
    assert want["entropy"] == 0.0 and all(abs(got[n] - x) < 1e-5 for n, x in want.items())


def test_candidates_of_near_copies_are_one_row_a_query_and_tree(spark):
    """Near copies share prefixes of every level, and the table lies in many partitions: rows still are one for each query, tree and block."""
    ann = pytest.importorskip("riftline.llm.ann")
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2, 400) + (5 << ann.BITS)  # strings that differ in the last bit only
    rows = pd.DataFrame({"string": codes, "block": np.arange(400) % 3, "place": np.arange(400) // 3})
    asked = pd.DataFrame({"query_id": np.arange(50), "string": codes[:50], "level": np.full(50, 1)})
    counts = ann.count_prefixes(rows, asked, 1)
    assert counts["query_id"].tolist() == list(range(50)) and all(len(c) == ann.LEVELS and c[0] == 399 for c in counts["counts"])
    assert [c[-1] + 1 for c in counts["counts"]] == [(codes == x).sum() for x in codes[:50]]
    listed = ann.list_candidates(rows, asked)
    assert listed["query_id"].tolist() == list(range(50))
    assert all(sorted(zip(np.repeat(b, [len(p) for p in ps]), np.concatenate(ps))) == sorted(zip(rows["block"], rows["place"])) for b, ps in zip(listed["blocks"], listed["places"]))
    vectors = spark.range(500).select(F.array("id").alias("ids"), F.col("id").alias("v")).repartition(60)
    blocks = ann.placed(vectors, 500).groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("place").alias("k"), F.max("place").alias("m")).collect()
    assert [(r["n"], r["k"], r["m"]) for r in blocks] == [(500, 500, 499)]


def test_settled_rows_leave_no_shuffle_files(spark):
    """The files of the shuffles behind a checkpoint go with its execution, and the setting is as before."""
    common = pytest.importorskip("riftline.llm.common")
    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {f.name for f in folder.rglob("shuffle_*")}
    first, setting = files(), spark.conf.get(common.CLEANED)
    sums = common.settled(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s")))
    end = time.time() + 20
    while files() - first and time.time() < end:
        time.sleep(0.2)
    assert not files() - first and spark.conf.get(common.CLEANED) == setting
    assert sums.agg(F.sum("s")).first()[0] == 9_999 * 5_000


def test_garch_steps_once_in_time_for_the_whole_grid():
    """The likelihoods of one model at a time, to the last digit, with one pass over time for a grid and in blocks of it."""
    x = np.random.default_rng(8).normal(size=300)
    e, v, grid = x - x.mean(), x.var(), [(0.0, 0.5), (0.1, 0.6), (0.25, 0.5)]
    want = []
    for alpha, beta in grid:
        h, total = v, 0.0
        for r in e**2:
            total -= 0.5 * (np.log(2 * np.pi * h) + r / h)
            h = (1 - alpha - beta) * v + alpha * r + beta * h
        want.append(total)
    assert grouped.garch_likelihoods(e, v, grid).tolist() == want
    kept, grouped.GRID_VALUES = grouped.GRID_VALUES, 21
    try:
        assert grouped.garch_likelihoods(e, v, grid).tolist() == want
    finally:
        grouped.GRID_VALUES = kept


def test_five_models_share_one_matrix(spark, monkeypatch):
    made = []
    whole = features.feature_matrix
    monkeypatch.setattr(features, "feature_matrix", lambda *a: made.append(a) or whole(*a))
    row = QUERIES["five_models_auc"](spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1 and len(row) == 1


def test_models_learn_from_few_partitions(spark, monkeypatch):
    """Each step of a model is a job over all partitions of its rows: they follow their size, not the number of shuffle partitions."""
    rng = np.random.default_rng(4)
    rows = [(i, float(i % 2), float(x)) for i, x in enumerate(rng.normal(size=200))]
    setting, parts = spark.conf.get("spark.sql.shuffle.partitions"), []
    fit = features.fit
    monkeypatch.setattr(features, "fit", lambda m, *a, **k: parts.append(m.rdd.getNumPartitions()) or fit(m, *a, **k))
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        matrix = spark.createDataFrame(rows, "series_id long, label double, x double").repartition("series_id")
        scores = features.out_of_fold(matrix, 2, "tree", depth=2)
        assert scores.count() == 200 and len(parts) == 2 and max(parts) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)


def test_blocks_follow_the_table_not_its_partitions(spark, monkeypatch):
    """Vectors lie in blocks of one size in however many partitions a table is dealt anew, and each has a place of its own."""
    ann = pytest.importorskip("riftline.llm.ann")
    vectors = spark.range(500).select(F.array("id").alias("ids"), F.col("id").alias("v")).repartition(37)
    whole = type(vectors).repartition
    monkeypatch.setattr(type(vectors), "repartition", lambda self, n, *keys: whole(self, max(n, 64) if keys else n, *keys))
    for rows, blocks in ((20_000, 1), (100, 6)):
        monkeypatch.setattr(ann, "BLOCK_ROWS", rows)
        got = ann.placed(vectors, 500).groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("place").alias("k"), F.countDistinct("v").alias("v"), F.max("place").alias("m")).collect()
        assert len(got) == blocks and sum(r["n"] for r in got) == 500 and max(r["n"] for r in got) == -(-500 // blocks)
        assert all(r["n"] == r["k"] == r["v"] == r["m"] + 1 for r in got)


def test_search_learns_from_few_partitions(spark, monkeypatch):
    """Every try of the search has the few partitions of its rows, too."""
    from riftline.plans import selection

    setting, parts, fit = spark.conf.get("spark.sql.shuffle.partitions"), [], features.fit
    monkeypatch.setattr(features, "fit", lambda m, *a, **k: parts.append(m.rdd.getNumPartitions()) or fit(m, *a, **k))
    monkeypatch.setattr(selection, "SPACE", selection.SPACE | {"maxIter": (1, 2, True, True)})
    rows = [(i, float(i % 2), float(x)) for i, x in enumerate(np.random.default_rng(5).normal(size=100))]
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        found = selection.search_trees(spark.createDataFrame(rows, "series_id long, label double, x double"), tries=1, first=1)
        assert found.count() == 1 and len(parts) == 2 and max(parts) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)


def test_search_makes_folds_once_and_learns_together(spark, monkeypatch):
    """Tries share one matrix in folds, and models that needn't wait for a score learn at the same time, with the scores that they have alone."""
    from riftline.plans import selection

    made, dealt, fit, met = [], features.datasets.stratified_folds, features.fit, threading.Barrier(4, timeout=30)
    monkeypatch.setattr(features.datasets, "stratified_folds", lambda *a: made.append(a) or dealt(*a))
    monkeypatch.setattr(features, "fit", lambda *a, **k: met.wait() >= 0 and fit(*a, **k))
    monkeypatch.setattr(selection, "SPACE", selection.SPACE | {"maxIter": (1, 3, True, True)})
    rows = [(i, float(i % 2), float(x) + i % 2) for i, x in enumerate(np.random.default_rng(6).normal(size=200))]
    matrix = spark.createDataFrame(rows, "series_id long, label double, x double")
    found = selection.search_trees(matrix, tries=2, first=2).collect()
    assert len(made) == 1 and [r["try"] for r in found] == [0, 1]
    monkeypatch.setattr(features, "fit", fit)
    monkeypatch.setattr(features, "together", lambda spark, run, items: [run(x) for x in items])
    assert selection.search_trees(matrix, tries=2, first=2).collect() == found


def test_first_draws_are_scored_at_once():
    """The draws and scores are those of one try after another."""
    from riftline.plans import selection

    sizes, score = [], lambda p: -sum((x - 0.3) ** 2 for x in p.values())
    space = {c: (0.0, 1.0, False, False) for c in "abc"}
    each = lambda f, items: sizes.append(len(items)) or map(f, items)
    got = selection.searched(score, 6, 7, space, first=4, each=each)
    draws = selection.Draws(space, 7, 4)
    for _ in range(6):
        unit = draws.next()
        draws.tell(unit, score(draws.named(unit)))
    assert sizes == [4, 1, 1] and got == [(draws.named(u), s) for u, s in draws.tried]
    assert len(selection.searched(score, 2, 7, space, first=4)) == 2
