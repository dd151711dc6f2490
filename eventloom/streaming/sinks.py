"""Delivery of micro-batches.

A batch may be delivered again after a failure. Tables, dead letters and folder topics
keep each batch in folders of its own, named by its number, and overwrite them, so a
repeat changes nothing. Kafka gets the records again, with the same keys and event ids.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.config import EngineConfig
from eventloom.operators.dead_letters import annotate, dead_letters
from eventloom.sources.dead_letters import BATCHES, add_entries
from eventloom.sources.tables import numbered_batch, write_events
from eventloom.sources.topics import FolderTopics, KafkaTopics, write_dead_letter_topic, write_event_stream

log = logging.getLogger(__name__)

#: Takes a batch and its number. False says that the batch was not delivered but put aside
#: (as dead letters); nothing may then be remembered of it as if it had been.
Sink = Callable[[DataFrame, int], bool | None]


def events_table_sink(path: str, now: Column | None = None, kind: str = "stream") -> Sink:
    def write(batch: DataFrame, batch_id: int) -> None:
        write_events(batch, path, F.current_timestamp() if now is None else now, numbered_batch(kind, batch_id))

    return write


def topic_sink(topics: KafkaTopics | FolderTopics, cfg: EngineConfig, kind: str = "stream") -> Sink:
    def write(batch: DataFrame, batch_id: int) -> None:
        write_event_stream(batch, topics, cfg, numbered_batch(kind, batch_id))

    return write


def write_entries(entries: DataFrame, path: str, batch_id: int, kind: str = BATCHES) -> None:
    """Add dead-letter entries to the stored table that replays read."""
    add_entries(entries, path, batch_id, kind)


def entries_sink(path: str) -> Sink:
    """For batches that are dead-letter entries already."""
    return lambda batch, batch_id: write_entries(batch, path, batch_id)


def dead_letter_sink(path: str, reason: str, now: Column | None = None) -> Sink:
    """For batches of events that went nowhere."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if now is None else now
        write_entries(dead_letters(batch, F.lit(reason), at), path, batch_id)

    return write


def dead_letter_topic_sink(topics: KafkaTopics | FolderTopics, reason: str, cfg: EngineConfig) -> Sink:
    def write(batch: DataFrame, batch_id: int) -> None:
        annotated = annotate(batch, reason, F.current_timestamp())
        write_dead_letter_topic(annotated, topics, cfg, numbered_batch("dead", batch_id))

    return write


def collect_with_fallback(cfg: EngineConfig, topic: Sink, table: Sink, dead: Sink) -> Sink:
    """Topic first, the table if that fails, dead letters if both fail.

    Without the asynchronous path the table is the only sink, and its failure goes
    to the caller. Only this function writes dead letters for a batch.
    """

    def deliver(batch: DataFrame, batch_id: int) -> bool:
        if not cfg.async_topic:
            return table(batch, batch_id) is not False
        try:
            return topic(batch, batch_id) is not False
        except Exception:
            log.warning("topic write of batch %s failed, writing to the table", batch_id, exc_info=True)
        try:
            return table(batch, batch_id) is not False
        except Exception:
            log.error("table write of batch %s failed, storing dead letters", batch_id, exc_info=True)
            dead(batch, batch_id)
            return False

    return deliver


def failure_to_dead_letters(write: Sink, dead: Sink, undo: Callable[[SparkSession, int], None] | None = None) -> Sink:
    """If the write of a batch fails, all of its events go to the dead letters; before,
    ``undo`` takes back what was written of it. An empty batch does nothing."""

    def deliver(batch: DataFrame, batch_id: int) -> bool:
        if batch.isEmpty():
            return True
        try:
            return write(batch, batch_id) is not False
        except Exception:
            log.error("write of batch %s failed", batch_id, exc_info=True)
        if undo is not None:
            undo(batch.sparkSession, batch_id)
        dead(batch, batch_id)
        return False

    return deliver


def run_available(rows: DataFrame, sink: Sink, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Process what is there now, batch by batch, then stop."""
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_parquet(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a streaming DataFrame over what is there now and read back what it sent."""
    query = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def batches_to_parquet(path: str) -> Sink:
    """A folder per batch; a repeat overwrites its own."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
