from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.text import is_set
from eventloom.streaming.settings import event_time


def _lane() -> F.Column:
    # events without an id are never duplicates and must not share a state
    return F.when(is_set("event_id"), F.concat(F.lit("i"), F.col("event_id"))).otherwise(
        F.concat(F.lit("n"), F.col("seq").cast("string"))
    )


def dedup_stream(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """First event of each id while the watermark remembers it. The built-in operator:
    the memory is the watermark delay, set it to the duplicate window or more, and rows
    behind the watermark are dropped. Where none may be lost, use ``dedup_batches``."""
    timed = event_time(events, cfg).withColumn("lane_key", _lane())
    return timed.dropDuplicatesWithinWatermark(["lane_key"]).drop("lane_key")
