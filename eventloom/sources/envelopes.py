"""Batches of events as clients post them, one JSON envelope per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.schemas import ENVELOPE


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes with an ``arrival`` number: file order position, unique per read."""
    return (
        spark.read.schema(ENVELOPE).json(path).withColumn("arrival", F.monotonically_increasing_id())
    )


def stream_envelopes(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", max_files).json(path)


def _size_ok(cfg: EngineConfig) -> Column:
    return F.coalesce(F.size("events").between(1, cfg.max_events_per_envelope), F.lit(False))


def reject_envelopes(envelopes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Envelopes without events or with too many: refused as a whole."""
    return envelopes.where(~_size_ok(cfg))


def explode_envelopes(envelopes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One raw event per row with its ``app_code``, and ``seq`` where the envelopes
    carry an arrival number."""
    app = F.coalesce("clientId", F.lit(cfg.default_client)).alias("app_code")
    numbered = "arrival" in envelopes.columns
    taken = envelopes.where(_size_ok(cfg)).select(
        app, *(["arrival"] if numbered else []), F.posexplode("events").alias("_pos", "_event")
    )
    seq = [(F.col("arrival") * (cfg.max_events_per_envelope + 1) + F.col("_pos")).alias("seq")] if numbered else []
    return taken.select("app_code", *seq, "_event.*")
