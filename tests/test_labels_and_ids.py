from riftline.operators import datasets


def test_large_ids_are_ordered_and_missing_labels_are_negative(spark):
    rows = [(2**62 + k, k, 1.0, 0, True if k < 4 else None) for k in range(10)]
    series = spark.createDataFrame(rows, "series_id long, t long, value double, period int, has_break boolean")
    labels = datasets.labels_of(series)
    assert {r["has_break"] for r in labels.collect()} == {True, False}
    assert labels.where("NOT has_break").count() == 6
    assert datasets.random_sample(labels, 5).count() == 5
    balanced = datasets.balanced_sample(labels, 8).collect()
    assert sum(r["has_break"] for r in balanced) == 4 == sum(not r["has_break"] for r in balanced)
    assert {r["fold"] for r in datasets.stratified_folds(labels, 2).collect()} == {0, 1}
