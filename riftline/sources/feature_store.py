"""Features of series kept between runs, by extractor, parameters and the series' own content.

A series' key is made of all its rows, whatever their order, so a stored row is used only for the very values it was computed
from: a changed series, or another parameter, misses.  Only what is missing is computed, and appended; rows
that the store holds already are never written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_keys(series: DataFrame) -> DataFrame:
    """series_id, content: number of rows and two order-free sums of row hashes, as text."""
    columns = [F.col(c) for c in ("t", "value", "period")]
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    parts = [F.count("*"), F.bit_xor(one), F.sum(F.shiftright(one, 20)), F.bit_xor(two), F.sum(F.shiftright(two, 20))]
    return series.groupBy("series_id").agg(F.concat_ws(":", *[p.cast("string") for p in parts]).alias("content"))


def place(path: str, extractor: str, parameters: dict) -> str:
    """The folder of an extractor with its parameters, in order of their names."""
    named = ",".join(f"{k}={parameters[k]!r}" for k in sorted(parameters))
    return f"{path}/{extractor}/{hashed(named)}"


def hashed(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:16]


def stored_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException:  # nothing there yet
        return None


def cached(series: DataFrame, path: str, extractor: str, function: Callable[..., DataFrame], **parameters) -> DataFrame:
    """One row a series as ``function(series, **parameters)`` gives it, from the store where it has that very series."""
    spark, folder = series.sparkSession, place(path, extractor, parameters)
    keys, held = content_keys(series), stored_rows(spark, folder)
    missing = keys if held is None else keys.join(held.select("series_id", "content"), ["series_id", "content"], "left_anti")
    fresh = function(series.join(missing.select("series_id"), "series_id", "left_semi"), **parameters).join(missing, "series_id")
    fresh.write.mode("append").parquet(folder)
    whole = spark.read.parquet(folder)
    return whole.join(keys, ["series_id", "content"], "left_semi").drop("content")


def save_summary(row: DataFrame, path: str) -> None:
    """A table of few rows as lines of JSON in one file."""
    row.coalesce(1).write.mode("overwrite").json(path)
