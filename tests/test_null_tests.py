"""Null distributions over all series without a break, against a plain count."""

import numpy as np
import pytest

from riftline.plans import features


def test_shares_count_every_series_without_a_break(spark):
    rng = np.random.default_rng(3)
    values = [*np.round(rng.normal(size=2_000), 2).tolist(), 9.0, -9.0, None]
    rows = [(k, k % 3 == 0, v) for k, v in enumerate(values)]
    gains = spark.createDataFrame([(k, int(b), v) for k, b, v in rows], "series_id long, label int, gain double")
    null = np.array([v for _, b, v in rows if not b and v is not None])
    got = {r["series_id"]: r for r in features.null_tests(gains, ["gain"]).collect()}
    assert len(got) == len(rows)
    for k, _, v in rows:
        if v is None:
            assert got[k]["gain_p"] is None
            continue
        share = (null >= v).mean()
        assert got[k]["gain_p"] == pytest.approx(max(share, 1 / (len(null) + 1)))
        assert got[k]["gain_rank"] == pytest.approx(1 - share)
        assert got[k]["gain_effect"] == pytest.approx((v - null.mean()) / null.std(ddof=1))


def test_too_few_series_without_a_break_give_nulls(spark):
    gains = spark.createDataFrame([(k, k % 2, float(k)) for k in range(10)], "series_id long, label int, gain double")
    assert all(r["gain_p"] is None and r["bonferroni_p"] is None for r in features.null_tests(gains, ["gain"]).collect())
