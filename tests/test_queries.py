"""Every query with a DuckDB counterpart gives the same rows on the smallest tables."""

import glob
import math

import duckdb
import pytest

from riftline import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(row[k]) for k in order) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    mine, other = canonical([tuple(r) for r in df.collect()], df.columns), canonical(cursor.fetchall(), names)
    assert len(mine) == len(other)
    for a, b in zip(mine, other, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x))), (a, b)
