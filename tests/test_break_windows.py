from riftline.operators import datasets
from riftline.plans.series_queries import QUERIES


def test_no_window_of_a_series_is_dropped(spark):
    """17 windows of 100 at a stride of 5 hold the boundary 10 from both ends; the last ones count too."""
    rows = QUERIES["break_windows"](spark, "/root/testdata/sf0.01").groupBy("series_id").count().collect()
    assert rows and max(r["count"] for r in rows) > 8 and all(r["count"] <= 17 for r in rows)


def test_windows_of_a_long_series_come_in_short_rows(spark):
    """Longer than three stretches and no multiple of the stride; no row of the plan holds the series."""
    n, size, stride = 7001, 100, 20
    series = spark.range(n).selectExpr("'a' AS series_id", "id AS t", "CAST(id AS DOUBLE) AS value", "CAST(id >= 4100 AS INT) AS period")
    got = {r["window_start"]: r["window"] for r in datasets.sliding_windows(series, size, stride).collect()}
    assert got == {k: [float(x) for x in range(k, k + size)] for k in range(0, n - size + 1, stride)}
    assert datasets._chunks(series, size, stride).selectExpr("max(size(v))").first()[0] <= datasets.CHUNK + stride + size
    assert datasets.inference_windows(series, size, stride).count() == len(got)
    marked = {r["window_start"]: r["break_position"] for r in datasets.marked_windows(series, size, stride).collect()}
    assert marked == {k: 4100 - k if 10 <= 4100 - k <= 90 else None for k in got}
    assert datasets.boundary_windows(series, 6).first()["window"] == [4097.0, 4098.0, 4099.0, 4100.0, 4101.0, 4102.0]
