"""Streaming forms: scoring of complete series as files arrive, and an online CUSUM with state per series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def score_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Scores each batch of complete series found in new files of ``source`` and appends (series_id, score) to ``sink``.

    A batch's output goes to a folder named by its number and is replaced if the batch is run again, so every
    series is scored exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "n long, mean double, squares double, low double, high double"
OUTPUT = "series_id string, t long, up double, down double, alarm boolean"


def online_cusum(stream: DataFrame, warm_up: int = 20, drift: float = 0.5, level: float = 5.0) -> DataFrame:
    """Two-sided CUSUM of each series' values as they arrive: running sums of standardised deviations above ``drift``.

    The first ``warm_up`` values set mean and spread; an alarm is raised when a sum passes ``level``.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, squares, low, high = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        rows = []
        for frame in frames:
            for t, x in sorted(zip(frame["t"], frame["value"], strict=True)):
                if n < warm_up:
                    n += 1
                    step = x - mean
                    mean += step / n
                    squares += step * (x - mean)
                else:
                    z = (x - mean) / (np.sqrt(squares / (n - 1)) or 1.0)
                    high, low = max(0.0, high + z - drift), max(0.0, low - z - drift)
                rows.append((key[0], t, high, low, max(high, low) > level))
        state.update((n, mean, squares, low, high))
        yield pd.DataFrame(rows, columns=["series_id", "t", "up", "down", "alarm"])

    keyed = stream.select(F.col("series_id").cast("string").alias("series_id"), "t", "value")
    return keyed.groupBy("series_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
