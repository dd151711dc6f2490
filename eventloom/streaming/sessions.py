from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.keys import new_session_id
from eventloom.operators.sessions import OPENING, counters, finalize, page_seen, session_key
from eventloom.streaming.settings import event_time


def sessionize_stream(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Session rows, each sent once, when the watermark has passed its timeout."""
    missing = {name: F.lit(None).cast("string") for name in OPENING if name not in events.columns}
    keyed = event_time(events, cfg).withColumns({**missing, "_key": session_key(cfg, events.columns)})
    gap = F.session_window("timestamp", f"{cfg.session_timeout_s} seconds")
    merged = keyed.groupBy("app_code", "_key", gap).agg(
        F.min("timestamp").alias("start_time"),
        # the window's own end lies a gap after the last event
        F.max("timestamp").alias("end_time"),
        *[column.alias(name) for name, column in counters().items()],
        F.min(F.struct(F.col("timestamp").alias("_at"), "seq", *OPENING)).alias("_opening"),
        F.max(F.when(page_seen(), F.struct(F.col("timestamp").alias("_at"), "seq", "page_url"))).alias("_viewed"),
    )
    owner = F.concat_ws(":", F.col("app_code"), F.col("_key"))
    return finalize(merged.withColumn("_session", new_session_id(owner, F.col("start_time"))), cfg)
