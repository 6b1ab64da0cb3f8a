"""Hard negatives against scoring every pair, and their edges."""

import glob
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.llm import queries
from riftline.llm.hard_negatives import Block, mine, relabelled

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def anchor():
    return F.col("vec_id") % 50 == 0


def by_hand(rows, positives=5, negatives=3):
    """Every pair scored with whole numbers of any size; rows of (vec_id, vector, label)."""
    some = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, a, y) in enumerate(some):
        if i is None or i % 50:
            continue
        scored = sorted((-sum(x * z for x, z in zip(a, b)), j is not None, j or 0, j, w) for m, (j, b, w) in enumerate(some) if m != n)
        for p in [r for r in scored if r[4] == y][:positives]:
            window = [r for r in scored if r[4] != y and 50 * -p[0] <= 100 * -r[0] <= 95 * -p[0]][:negatives]
            out += [(i, p[3], k + 1, r[3], -p[0], -r[0]) for k, r in enumerate(window)]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("block", [7, 100, 16_384])
def test_equals_every_pair(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(i), (rng.normal(size=12) + (i % 4)).round(1).tolist(), int(i % 5 if i % 3 else 0)) for i in range(0, 1500, 5)]  # a hot label and many ties
    assert found(mine(spark.createDataFrame(rows, SCHEMA), anchor(), rows_of_block=block)) == by_hand(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(0, 1) for _ in range(4)], i % 2) for i in range(60)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5], 0), (None, [0.4] * 4, 1), (100, None, 0), (100, [1.0, None, 1.0, 1.0], 0), (100, [1.0, float("nan"), 0.0, 0.0], 1), (100, [float("inf"), 0.0, 0.0, 0.0], 1), (100, [0.5] * 4, None)]
    rows += [(50, [0.9, 0.9, 0.9, 0.9], 0), (50, [0.8, 0.9, 0.9, 0.9], 1), (150, [], 0), (200, [0.7, 0.7], 1), (250, [0.5] * 6, 0), (7, [0.25] * 4, 1), (7, [0.25] * 4, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS deal", "3 AS kind", "4 AS score")
    assert found(mine(df, anchor(), rows_of_block=9)) == by_hand(rows)


def test_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.uniform(0.2, 1, size=3) * 2.0**21).tolist(), int(i % 2)) for i in range(0, 500, 10)]
    assert found(mine(spark.createDataFrame(rows, SCHEMA), anchor())) == by_hand(rows)
    huge = spark.createDataFrame([(0, [1e300, 1.0], 0), (1, [1e300, -1e300], 0), (2, [1e290, 2.0], 1)], SCHEMA)
    assert mine(huge, anchor()).count() <= 3


def test_empty(spark):
    assert mine(spark.createDataFrame([], SCHEMA), anchor()).count() == 0
    assert mine(spark.createDataFrame([(50, [1.0], 1)], SCHEMA), anchor()).count() == 0


def test_bounds_hold():
    import pandas as pd

    rng = np.random.default_rng(2)
    values = np.floor(rng.normal(size=(500, 16)) * 60)
    rows = pd.DataFrame({"key": range(500), "label": 0, "vec_id": pd.array(range(500), dtype="Int64")})
    block = Block(rows, values, values.min(axis=0), values.max(axis=0))
    for anchor in values[:20]:
        lower, width = block.bounds(anchor)
        exact = values @ anchor
        assert (lower <= exact).all() and (exact <= lower + width).all() and width < 0.5 * np.ptp(exact)


def test_same_as_sql(spark):
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/embeddings.parquet"):
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    name = "op12_hard_negatives"
    got = queries.QUERIES[name](spark, DATA)
    sql = c.execute(queries.ORACLES[name])
    assert [d[0] for d in sql.description] == got.columns
    rows = found(got)
    assert rows and rows == sorted(sql.fetchall(), key=str)
    assert relabelled(spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (None, [1.0], 3), (14, [1.0], None)], SCHEMA)).select("label").collect() == [(0,), (9,), (3,), (None,)]
