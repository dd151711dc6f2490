from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.workspace import prepare_session


def streaming_session(spark: SparkSession) -> SparkSession:
    """Settings the stateful queries rely on."""
    prepare_session(spark)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    # a heavy session key is merged in each task before it is shuffled
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return spark


def event_time(events: DataFrame, cfg: EngineConfig, ts: str = "timestamp") -> DataFrame:
    """Events with the watermark; zone-less times are taken as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, cfg.watermark)


@contextmanager
def timers_by_clock(spark: SparkSession) -> Iterator[None]:
    """For starting a keyed stream (``identity_keyed``, ``sweep_stream``) over what is there
    now: timers run with the batches that have rows. Without this such a stream has always
    one more empty batch to run and never ends."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
