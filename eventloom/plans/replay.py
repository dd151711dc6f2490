"""Replay of dead letters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.times import age_expired
from eventloom.operators import validate as V
from eventloom.operators.dead_letters import (
    alive,
    already_written,
    entry_key,
    fetch_due,
    payloads,
    split_exhausted,
    store,
    update_retries,
)
from eventloom.operators.enrich import sink_defaults
from eventloom.plans.ingest import Earlier, Ingested, ingest_flat
from eventloom.plans.state import LATEST, IngestState
from eventloom.schemas import DEAD_LETTERS, EVENTS
from eventloom.sources.dead_letters import drop_added, read_entries
from eventloom.sources.snapshots import newest_version, read_snapshot, write_snapshot
from eventloom.sources.tables import BATCH, EVENT_DAY, numbered_batch, read_table, write_events
from eventloom.workspace import write_through

REPLAYED = "replayed"
ALREADY_PROCESSED = "already_processed"
FAILED = "failed"


@dataclass(frozen=True)
class Replay:
    """What a replay of one batch gives."""

    outcomes: DataFrame
    """(reason, entry_key, event_id, retry_count, replay_outcome, success) of the batch."""
    done: Ingested
    """The events of the batch, through the whole chain."""
    staying: DataFrame
    exhausted: DataFrame
    """Entries for the dead table."""
    cfg: EngineConfig
    now: Column

    @cached_property
    def events(self) -> DataFrame:
        """Rows to add to the events table."""
        return sink_defaults(self.done.events)

    @cached_property
    def waiting(self) -> DataFrame:
        """Dead-letter table after this run."""
        return update_retries(self.staying, self.outcomes, self.cfg, self.now)


def replay_dead_letters(
    entries: DataFrame,
    events: DataFrame,
    contracts: DataFrame,
    cfg: EngineConfig,
    now: Column,
    earlier: Earlier = Earlier(),
) -> Replay:
    """Replay one batch. What the events table holds is done; the rest goes the way of
    new events: required fields, identify, contracts, duplicates, consent and privacy,
    identity, sessions. An event that fails waits longer. One id fetched under two
    reasons is written once.
    """
    readable = alive(entries, cfg, now)
    exhausted, staying = split_exhausted(readable, cfg, now)
    batch = write_through(
        payloads(fetch_due(staying, cfg, now)).withColumn("seq", F.monotonically_increasing_id()), "batch"
    )
    known = already_written(batch, events).withColumn("_done", F.lit(True))
    flat = batch.select(
        "seq", "reason", "retry_count", entry_key().alias("entry_key"), F.col("event_id").alias("_entry_id"), "event.*"
    )
    # as many rows as the batch has, see already_written
    flat = flat.join(F.broadcast(known), "event_id", "left")
    given = F.coalesce(F.col("timestamp"), now)
    again = flat.where("_done is null").withColumns(
        {
            "valid": V.has_required_fields(F.col("event_id"), F.col("event_type"), F.col("timestamp")),
            "sent_at": F.col("timestamp"),
            "timestamp": given,
            "received_at": now,
            "custom": F.col("properties"),
        }
    )
    done = ingest_flat(again.drop("properties", "_done"), contracts, cfg, now, earlier)
    decided = done.classified.select(
        "reason",
        "entry_key",
        F.col("_entry_id").alias("event_id"),
        "retry_count",
        # a duplicate is the same event under another reason
        F.when(F.col("outcome").isin(V.ACCEPTED, V.IDENTIFIED, V.DUPLICATE), F.lit(REPLAYED))
        .otherwise(F.lit(FAILED))
        .alias("replay_outcome"),
    )
    skipped = flat.where("_done").select(
        "reason", "entry_key", F.col("_entry_id").alias("event_id"), "retry_count", F.lit(ALREADY_PROCESSED).alias("replay_outcome")
    )
    outcomes = decided.unionByName(skipped).withColumn("success", F.col("replay_outcome") != FAILED)
    return Replay(outcomes, done, staying, exhausted, cfg, now)


def run_replay(
    spark: SparkSession,
    dlq: str,
    dead: str,
    table: str,
    contracts: DataFrame,
    cfg: EngineConfig,
    now: Column,
    state: str | None = None,
) -> DataFrame:
    """One replay over the stored tables; returns the outcomes of the batch.

    The number of the run is the version of the dead-letter table it makes. Everything
    is written under that number, the dead-letter table last: if the job dies before,
    the next run has the same number and replaces what was written. ``state`` is the
    folder of the ingest state, whose links and open sessions the events then find.
    """
    base = newest_version(spark, dlq)
    entries, added = read_entries(spark, dlq, base)
    run = 0 if base is None else base + 1
    remembered = IngestState(state, cfg, now) if state else None
    earlier = Earlier()
    if remembered:
        every = remembered.before(spark, LATEST)
        earlier = Earlier(None, every.links, every.sessions)
    label = numbered_batch("replay", run)
    # an earlier attempt of this run may have written the batch
    others = read_table(spark, table, EVENTS, EVENT_DAY).where(F.col(BATCH) != label)
    replay = replay_dead_letters(entries, others, contracts, cfg, now, earlier)
    outcomes = write_through(replay.outcomes, "outcomes")
    write_events(write_through(replay.events, "replayed"), table, now, label)
    if remembered:
        remembered.add_replay(replay.done, run)
    gone_base = newest_version(spark, dead)
    gone = store(read_snapshot(spark, dead, DEAD_LETTERS, gone_base), replay.exhausted)
    gone = gone.where(~age_expired(F.col("failed_at"), cfg.dlq_dead_ttl_s, now))
    write_snapshot(write_through(gone, "dead"), dead, gone_base)
    waiting = update_retries(replay.staying, outcomes, cfg, now)
    write_snapshot(write_through(waiting, "waiting"), dlq, base)
    drop_added(spark, dlq, added)
    return outcomes
