"""Canonical series tables: series_id, t (from 0 in each series), value, period (0 before the boundary, 1 after).

Observations without a value are dropped before they are numbered, so positions and boundaries count real values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOUNDARY = "2024-01-22"
VECTOR_BOUNDARY = 44


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def from_events(events: DataFrame, key: str) -> DataFrame:
    """Series of an event table: one for each value of ``key``, in order of time and event, cut at BOUNDARY."""
    order = Window.partitionBy("series_id").orderBy("ts", "event_id")
    rows = events.where(present(F.col("value"))).select(F.col(key).alias("series_id"), "ts", "event_id", F.col("value").cast("double").alias("value"))
    after = (F.col("ts") >= F.lit(BOUNDARY).cast("timestamp_ntz")).cast("int")
    return rows.withColumn("t", (F.row_number().over(order) - 1).cast("long")).select("series_id", "t", "value", after.alias("period"))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series."""
    return from_events(table(spark, sf_dir, "events"), "user_id")


def type_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few long series."""
    return from_events(table(spark, sf_dir, "events"), "event_type")


def vector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each embedding vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series_id"), F.posexplode("embedding").alias("t", "value"))
    return v.where(present(F.col("value"))).select("series_id", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"), (F.col("t") >= VECTOR_BOUNDARY).cast("int").alias("period"))


def planted_break(series: DataFrame, shift: float = 25.0, scale: float = 1.0) -> DataFrame:
    """Labelled series: every third one (by id) is shifted and scaled after its boundary."""
    hit = F.col("series_id") % 3 == 0
    value = F.when(hit & (F.col("period") == 1), F.col("value") * scale + shift).otherwise(F.col("value"))
    return series.select("series_id", "t", value.alias("value"), "period", hit.alias("has_break"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """A stored long table with columns id, time, value, period in the canonical form."""
    rows = spark.read.parquet(path).where(present(F.col("value")))
    order = Window.partitionBy("id").orderBy("time")
    return rows.select(F.col("id").alias("series_id"), (F.row_number().over(order) - 1).cast("long").alias("t"), F.col("value").cast("double").alias("value"), F.col("period").cast("int").alias("period"))


def with_labels(series: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds has_break (null where there is no label) by an outer join on series_id."""
    return series.join(labels.select("series_id", "has_break"), "series_id", "left")


def to_arrays(series: DataFrame) -> DataFrame:
    """One row per series: values before and after in order of t, boundary (length where there is no after) and length."""
    side = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("period") == p, F.struct("t", "value")))), lambda x: x["value"])
    return series.groupBy("series_id").agg(side(0).alias("before"), side(1).alias("after"), F.coalesce(F.min(F.when(F.col("period") == 1, F.col("t"))), F.count("*")).alias("boundary"), F.count("*").alias("length"))


def from_arrays(arrays: DataFrame) -> DataFrame:
    """The long form of to_arrays."""
    both = arrays.select("series_id", F.size("before").alias("k"), F.posexplode(F.concat("before", "after")).alias("t", "value"))
    return both.select("series_id", F.col("t").cast("long").alias("t"), "value", (F.col("t") >= F.col("k")).cast("int").alias("period"))
