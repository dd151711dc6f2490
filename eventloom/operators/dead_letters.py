"""Dead-letter tables: store, fetch, retry, give up.

A dead-letter table is a plain DataFrame with the columns of
``schemas.DEAD_LETTERS``; each step returns the new table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import EngineConfig
from eventloom.functions.keys import next_retry_at
from eventloom.functions.text import has_text, is_set
from eventloom.functions.times import plus_seconds
from eventloom.operators.collapse import replace_latest
from eventloom.operators.skew import lookup_join
from eventloom.schemas import DEAD_LETTER_COLUMNS, EVENTS


def entry_key() -> Column:
    """Within a reason, entries are told apart by event id; without one, by payload."""
    return F.when(is_set("event_id"), F.col("event_id")).otherwise(
        F.concat(F.lit("#"), F.sha2("event_json", 256))
    )


def dead_letters(
    events: DataFrame, reason: Column, now: Column, payload_columns: Sequence[str] | None = None
) -> DataFrame:
    """New entries for rejected events, due at once. The payload is the event as JSON."""
    payload = F.to_json(F.struct(*[F.col(name) for name in payload_columns or events.columns]))
    return events.select(
        "event_id",
        "event_type",
        "user_id",
        payload.alias("event_json"),
        reason.alias("reason"),
        now.alias("failed_at"),
        F.lit(0).alias("retry_count"),
        now.alias("next_retry_at"),
        now.alias("updated_at"),
    )


def store(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Add entries; one with the same reason and event id replaces the old one."""
    both = entries.select(*DEAD_LETTER_COLUMNS).unionByName(new.select(*DEAD_LETTER_COLUMNS))
    keyed = both.withColumn("_entry", entry_key())
    return replace_latest(keyed, ("reason", "_entry"), ("updated_at", "failed_at", "event_json")).drop("_entry")


#: What the copy for the dead-letter topic has among its properties.
DLQ_REASON, DLQ_RECEIVED = "_dlq_reason", "_dlq_original_timestamp"


def _as_map(properties: Column) -> Column:
    """The properties without the notes of ``annotate``; null if they are no object."""
    parsed = F.try_variant_get(F.try_parse_json(properties), "$", "map<string,variant>")
    return F.map_filter(parsed, lambda key, _: ~key.isin(DLQ_REASON, DLQ_RECEIVED))


def without_notes(properties: Column) -> Column:
    """The properties as they were before ``annotate``."""
    kept = _as_map(properties)
    return F.when(F.size(kept) > 0, F.to_json(kept))


def annotate(events: DataFrame, reason: str, now: Column) -> DataFrame:
    """Copy of the events for the dead-letter topic: reason and first receipt go into
    the properties, received_at starts anew, the event id is the key."""
    extra = F.to_json(
        F.struct(
            F.lit(reason).alias(DLQ_REASON),
            F.date_format(F.coalesce("received_at", now), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(DLQ_RECEIVED),
        )
    )
    as_map = "map<string,variant>"
    merged = F.map_concat(
        F.coalesce(
            _as_map(F.col("properties")),
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")),
        ),
        F.variant_get(F.parse_json(extra), "$", as_map),
    )
    return events.withColumn("properties", F.to_json(merged)).withColumn("received_at", now)


def alive(entries: DataFrame, cfg: EngineConfig, now: Column) -> DataFrame:
    """Entries whose time to live, renewed by each retry, has not run out and whose
    payload can be read."""
    return entries.where(
        (F.col("updated_at") > plus_seconds(now, -cfg.dlq_ttl_s))
        & has_text("event_json")
        & F.try_parse_json("event_json").isNotNull()
    )


def _due(now: Column) -> Column:
    return F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)


def due(entries: DataFrame, cfg: EngineConfig, now: Column) -> DataFrame:
    """All entries that may be replayed now: neither in back-off nor exhausted."""
    return entries.where(_due(now) & (F.col("retry_count") < cfg.dlq_max_retry))


def fetch_due(entries: DataFrame, cfg: EngineConfig, now: Column) -> DataFrame:
    """The oldest entries that are due, at most one batch."""
    return due(entries, cfg, now).orderBy("failed_at", "reason", "event_id", "event_json").limit(cfg.dlq_batch_size)


def split_exhausted(entries: DataFrame, cfg: EngineConfig, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entries to move to the dead table, entries that stay)."""
    exhausted = _due(now) & (F.col("retry_count") >= cfg.dlq_max_retry)
    return entries.where(exhausted), entries.where(~exhausted)


def update_retries(entries: DataFrame, outcomes: DataFrame, cfg: EngineConfig, now: Column) -> DataFrame:
    """Dead-letter table after a replay: successes leave, failures wait longer.

    ``outcomes`` holds (reason, entry_key, success); other entries are unchanged.
    """
    keyed = entries.withColumn("entry_key", entry_key())
    joined = keyed.join(outcomes.select("reason", "entry_key", "success"), ["reason", "entry_key"], "left")
    failed = F.coalesce(~F.col("success"), F.lit(False))
    retries = F.col("retry_count") + 1
    return joined.where(~F.coalesce(F.col("success"), F.lit(False))).select(
        "event_id",
        "event_type",
        "user_id",
        "event_json",
        "reason",
        "failed_at",
        F.when(failed, retries).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(failed, next_retry_at(F.col("event_id"), retries, now, cfg.dlq_jitter))
        .otherwise(F.col("next_retry_at"))
        .alias("next_retry_at"),
        F.when(failed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


#: The event as a payload holds it; consent is no column of the events table.
PAYLOAD = T.StructType([*EVENTS.fields, T.StructField("consent", T.BooleanType())])


def payloads(entries: DataFrame) -> DataFrame:
    """Entries with their event parsed into ``event``; unreadable payloads give null."""
    return entries.withColumn("event", F.from_json("event_json", PAYLOAD))


def already_written(batch: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id) of a fetched batch, with parsed payloads, that the events table holds.

    The events table is only read for the times that occur in the batch, and not
    shuffled if the ids of the batch fit a broadcast.
    """
    rows = batch.where(is_set("event_id"))
    if "timestamp" in events.columns:
        micros = F.unix_micros("event.timestamp")
        first, last = rows.agg(F.min(micros), F.max(micros)).first()
        if first is not None:
            first, last = F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))
            events = events.where(F.col("timestamp").between(first, last))
            if "event_date" in events.columns:
                events = events.where(F.col("event_date").between(F.to_date(first), F.to_date(last)))
    ids = rows.select("event_id").distinct()
    return lookup_join(events.select("event_id"), ids, ["event_id"], "left_semi").distinct()
