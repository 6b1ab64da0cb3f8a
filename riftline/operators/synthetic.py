"""Series drawn from autoregressions of order one, the same again after a lost task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.operators.datasets import uniform
from riftline.operators.lagged import fits


def normal(*key: Column) -> Column:
    """A standard normal number that is a function of the key."""
    return F.sqrt(-2 * F.log(1 - uniform(*key, F.lit("r")))) * F.cos(2 * math.pi * uniform(*key, F.lit("a")))


def ar1_paths(models: DataFrame, seed: int = 42) -> DataFrame:
    """series_id, t, value of one path for each row (series_id, n, mean, slope, sigma), begun in its stationary distribution.

    Slopes are held within 0.999.  A path is a fold over shocks that are functions of id, position and seed.
    """
    m = models.withColumn("slope", F.greatest(F.least("slope", F.lit(0.999)), F.lit(-0.999)))
    shock = lambda i: normal(F.col("series_id"), i, F.lit(seed)) * F.col("sigma")
    begin = shock(F.lit(-1)) / F.sqrt(1 - F.col("slope") ** 2)

    def step(s: Column, i: Column) -> Column:
        return F.transform(F.array(F.col("slope") * s["x"] + shock(i)), lambda x: F.struct(x.alias("x"), F.concat(s["path"], F.array(x)).alias("path")))[0]

    start = F.struct(begin.alias("x"), F.array(begin).alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(2)).cast("int") - 1), start, step)["path"]
    rows = m.select("series_id", "n", "mean", F.posexplode(path).alias("t", "x")).where("t < n")
    return rows.select("series_id", F.col("t").cast("long").alias("t"), (F.col("x") + F.col("mean")).alias("value"))


def like_first_period(series: DataFrame, seed: int = 42) -> DataFrame:
    """For each series a path of its whole length from the autoregression of its first period, with the same boundary."""
    f = fits(series, (1,))
    slope, n = F.get("beta_0", 0), F.col("n_0")
    sigma = F.sqrt(F.when(n > 2, F.col("rss_0") / (n - 2)))
    models = f.where("n_0 > 2").select("series_id", slope.alias("slope"), sigma.alias("sigma"), (F.col("intercept_0") / (1 - F.greatest(F.least(slope, F.lit(0.999)), F.lit(-0.999)))).alias("mean"))
    sizes = series.groupBy("series_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("period") == 0, 1)).alias("b"))
    paths = ar1_paths(models.join(sizes, "series_id"), seed)
    return paths.join(sizes.select("series_id", "b"), "series_id").select("series_id", "t", "value", (F.col("t") >= F.col("b")).cast("int").alias("period"))
