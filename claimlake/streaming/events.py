"""Streaming extensions: arriving score rows, deduplication within a watermark, windowed counts, running averages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: str | StructType, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """Files that arrive in a folder, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(folder)


def once(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within ``late``."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windows(rows: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, mean) of tumbling windows; rows later than the watermark are dropped."""
    w = rows.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("window.start").alias("start"), key, "n", "mean")


def running_ema(rows: DataFrame, key: str, time: str, value: str, alpha: float) -> DataFrame:
    """(key, ema) after each micro-batch: the average begins with the first value and keeps one number a key as state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v = state.get[0] if state.exists else None
        batch = pd.concat(list(frames))
        for x in batch.sort_values(time, kind="stable")[value]:
            v = float(x) if v is None else alpha * float(x) + (1 - alpha) * v
        state.update((v,))
        yield pd.DataFrame({key: [k[0]], "ema": [v]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ema double", "ema double", "update", GroupStateTimeout.NoTimeout)
