from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.times import epoch_ms, plus_seconds


def new_session_id(session_key: Column, start: Column) -> Column:
    """'sess_' and 32 hex digits, the same again when the job is run again."""
    seed = F.concat_ws(":", session_key, epoch_ms(start).cast("string"))
    return F.concat(F.lit("sess_"), F.substring(F.sha2(seed, 256), 1, 32))


def partition_key(user_id: Column, anonymous_id: Column, session_id: Column | None = None) -> Column:
    """User, else visitor, else (when given) session, else 'unknown'."""
    parts = [user_id, anonymous_id] + ([session_id] if session_id is not None else [])
    return F.coalesce(*parts, F.lit("unknown"))


def text_hash(text: Column) -> Column:
    """The 32-bit hash of a text that JVM programs use: 31 times the hash so far plus the
    next UTF-16 unit, as a number of 0 to 2^32 - 1."""
    wrap = F.lit(2**32)
    points = F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.ascii(F.substr(text, k, F.lit(1))).cast("long"))
    points = F.when(F.length(text) > 0, points).otherwise(F.array().cast("array<bigint>"))

    def step(so_far: Column, point: Column) -> Column:
        over = point - 65_536
        pair = (so_far * 31 + 55_296 + F.floor(over / 1_024)) % wrap * 31 + 56_320 + over % 1_024
        return F.when(point > 65_535, pair).otherwise(so_far * 31 + point) % wrap

    return F.aggregate(points, F.lit(0).cast("long"), step)


def partition_of(key: Column, partitions: int) -> Column:
    """Partition number: the text's hash without its sign bit; empty and null keys go to
    partition 0."""
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(0)).otherwise(
        (text_hash(key) % F.lit(2**31) % F.lit(partitions)).cast("int")
    )


def route_topic(event_type: Column, cfg: EngineConfig) -> Column:
    return F.when(
        event_type.isin("session_start", "session_end"), F.lit(cfg.sessions_topic)
    ).otherwise(F.lit(cfg.events_topic))


def next_retry_at(event_id: Column, retry_count: Column, now: Column, jitter: float) -> Column:
    """now + 2^min(retry, 10) seconds, moved by up to half of ``jitter`` either way.

    The random part comes from the event id and the retry number, so a rerun of
    the job plans the same retry.
    """
    delay = F.pow(F.lit(2.0), F.least(retry_count, F.lit(10)))
    unit = F.pmod(F.xxhash64(event_id, retry_count), F.lit(1_000_000)) / F.lit(1_000_000.0)
    moved = (delay * F.lit(jitter) * (unit - F.lit(0.5))).cast("long")
    return plus_seconds(now, delay.cast("long") + moved)
