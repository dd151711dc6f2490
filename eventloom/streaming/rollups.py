from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.operators.rollups import HOURLY_KEYS, hourly_measures
from eventloom.streaming.settings import event_time


def hourly_stream(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Hourly partial rows, sent when the watermark passes the hour. ``merge_hourly``
    turns them into the rollup."""
    keys = [name for name in HOURLY_KEYS if name != "hour"]
    return (
        event_time(events, cfg)
        .groupBy(F.window("timestamp", "1 hour"), *keys)
        .agg(*hourly_measures())
        .withColumn("hour", F.col("window.start"))
        .drop("window")
    )
