from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from riftline.llm.ann import enough, nearest


def test_ascent_follows_from_the_recall(spark):
    """With 20 vectors only, less than nine tenths of the neighbours would be met."""
    x = np.random.default_rng(3).normal(size=(3000, 32)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in nearest(df, F.col("vec_id") % 100 == 0, trees=8, least=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * 30


def test_enough_is_the_smallest_number():
    held = np.array([[100, 10, 1]] * 50)
    assert enough(held, [np.array([1] * 10)] * 50, 5, 0.9) == 11
    assert enough(held, [np.array([2] * 10)] * 50, 5, 0.9) == 5
    assert enough(held, [np.array([0] * 10)] * 50, 5, 0.9) == 101
