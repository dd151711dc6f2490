"""The events topic into the events table, and raw envelopes into the engine.

Both run batch by batch with the batch operators. There is no watermark: a late event is
an event, and what earlier batches have to remember is remembered by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.text import is_set
from eventloom.functions.times import age_expired
from eventloom.operators.dead_letters import DLQ_REASON, DLQ_RECEIVED, dead_letters, without_notes
from eventloom.operators.dedup import accepted_ids, mark_duplicates
from eventloom.plans.ingest import ingest
from eventloom.plans.state import IngestState
from eventloom.schemas import SEEN_IDS
from eventloom.sources.dead_letters import TOPIC
from eventloom.sources.envelopes import explode_envelopes
from eventloom.sources.state import BatchState
from eventloom.sources.tables import drop_batch, numbered_batch
from eventloom.sources.topics import FolderTopics, KafkaTopics, parse_records, read_records, split_unreadable
from eventloom.streaming.settings import streaming_session
from eventloom.streaming.sinks import (
    Sink,
    dead_letter_topic_sink,
    events_table_sink,
    failure_to_dead_letters,
    run_available,
    write_entries,
)
from eventloom.workspace import dropping_scratch, write_through

UNREADABLE = "unreadable_record"
WRITE_FAILED = "table_write_failed"
#: Kind of the batches that the load writes.
STREAM = "stream"


def load_from_stream(
    spark: SparkSession,
    topics: KafkaTopics | FolderTopics,
    table: str,
    checkpoint: str,
    cfg: EngineConfig,
    dead: str,
    now: Column | None = None,
    write: Sink | None = None,
):
    """Events topic to events table. Duplicates fall by the rule of the batch operator,
    within a batch and across batches; events without an id are never duplicates.
    Records that are no events go to the dead letters ``dead`` with their text. A batch
    that can't be written goes to the dead-letter topic, and none of it stays in the
    table; its ids are not remembered, so its events are new when they are sent again.

    ``write`` takes the place of the sink that writes the table.
    """
    streaming_session(spark)
    now = F.current_timestamp() if now is None else now

    def undo(spark: SparkSession, batch_id: int) -> None:
        drop_batch(spark, table, numbered_batch(STREAM, batch_id))

    deliver = failure_to_dead_letters(
        write or events_table_sink(table, now, STREAM), dead_letter_topic_sink(topics, WRITE_FAILED, cfg), undo
    )
    remembered = BatchState(
        f"{checkpoint}-seen",
        SEEN_IDS,
        lambda rows: rows.where(~age_expired(F.col("arrived_at"), cfg.seen_ttl_s, now)),
    )

    def run(records: DataFrame, batch_id: int) -> None:
        with dropping_scratch(spark):
            # a number for every record of the batch, also for equal ones
            parsed = parse_records(records.select("value")).withColumn("seq", F.monotonically_increasing_id())
            numbered, broken = split_unreadable(write_through(parsed, "records"))
            write_entries(unreadable_entries(broken, now), dead, batch_id)
            marked = mark_duplicates(numbered, cfg, seen=remembered.before(spark, batch_id))
            fresh = write_through(marked.where(~F.col("is_duplicate")).drop("is_duplicate", "seq"), "fresh")
            remembered.propose(accepted_ids(fresh).withColumn("arrived_at", now), batch_id)
            if deliver(fresh, batch_id) is False:
                remembered.discard(spark, batch_id)
            else:
                remembered.confirm(spark, batch_id)

    return run_available(read_records(spark, topics, cfg), run, checkpoint)


def unreadable_entries(records: DataFrame, now: Column, payload: tuple[str, ...] = ("value",)) -> DataFrame:
    """Dead-letter entries of records that are no events, with their text."""
    nothing = F.lit(None).cast("string")
    refused = records.select(nothing.alias("event_id"), nothing.alias("event_type"), nothing.alias("user_id"), *payload)
    return dead_letters(refused, F.lit(UNREADABLE), now, payload)


def load_dead_letters(
    spark: SparkSession,
    topics: KafkaTopics | FolderTopics,
    dead: str,
    checkpoint: str,
    cfg: EngineConfig,
    now: Column | None = None,
):
    """Dead-letter topic to the stored dead letters, from which they are replayed.

    A record is the event as it was, with the reason and the time of its first receipt
    among its properties; both leave the properties again and become the entry's. Entries
    with an event id are one per reason, as in the table. Those without are told apart by
    their place in the topic: partition and offset, or number and row of the batch where
    the topic has none. A batch that is read again replaces its entries.
    """
    streaming_session(spark)
    now = F.current_timestamp() if now is None else now

    def run(records: DataFrame, batch_id: int) -> None:
        with dropping_scratch(spark):
            numbered = records.withColumn("seq", F.monotonically_increasing_id())
            places = ("partition", "offset") if "offset" in numbered.columns else (F.lit(batch_id), "seq")
            placed = numbered.select("value", F.concat_ws(":", *places).alias("_place"))
            events, broken = split_unreadable(write_through(parse_records(placed), "records"))
            entries = topic_entries(events, now).unionByName(unreadable_entries(broken, now, ("value", "_place")))
            write_entries(entries, dead, batch_id, TOPIC)

    return run_available(topics.stream(spark, cfg.dead_letter_topic), run, checkpoint)


def topic_entries(events: DataFrame, now: Column) -> DataFrame:
    """Dead-letter entries of annotated events."""
    reason, received = (F.get_json_object("properties", f"$.{name}") for name in (DLQ_REASON, DLQ_RECEIVED))
    noted = events.withColumns({"_reason": reason, "_received": F.try_to_timestamp(received)})
    event = noted.withColumns({"properties": without_notes(F.col("properties")), "received_at": F.coalesce("_received", "received_at")})
    payload = [name for name in events.columns if name != "_place"]
    # only where nothing else tells two entries apart
    unnamed = event.withColumn("_place", F.when(~is_set("event_id"), F.col("_place")))
    return dead_letters(unnamed, F.coalesce("_reason", F.lit(WRITE_FAILED)), now, [*payload, "_place"])


def ingest_batches(
    contracts: DataFrame, state: str, deliver: Sink, dead: Sink, cfg: EngineConfig, now: Column | None = None
) -> Sink:
    """Micro-batch form of the whole ingest, for ``foreachBatch`` on envelopes.

    Accepted ids, identity links and open sessions live below ``state``; batch n reads
    what batches before it left, so a repeated batch starts from the same state.
    """
    now = F.current_timestamp() if now is None else now
    remembered = IngestState(state, cfg, now)

    def run(envelopes: DataFrame, batch_id: int) -> None:
        spark = envelopes.sparkSession
        with dropping_scratch(spark):
            numbered = write_through(envelopes.withColumn("arrival", F.monotonically_increasing_id()), "envelopes")
            done = ingest(explode_envelopes(numbered, cfg), contracts, cfg, now, remembered.before(spark, batch_id))
            written = deliver(done.events, batch_id) is not False
            dead(done.dead, batch_id)
            remembered.add(done, batch_id, written)

    return run
