"""Event topics: Kafka where its connector is on the class path, else folders of JSON
lines with one folder per topic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import EngineConfig
from eventloom.functions.keys import partition_key, partition_of, route_topic
from eventloom.functions.times import partition_day
from eventloom.schemas import EVENTS
from eventloom.sources.tables import new_batch
from eventloom.workspace import setting


#: Topics that a task writes at once without sorting; with more it sorts the rest.
OPEN_TOPICS = 16
#: A compressed file is read by one task.
FILE_RECORDS = 250_000


@dataclass(frozen=True)
class KafkaTopics:
    bootstrap_servers: str
    max_offsets_per_trigger: int = 10_000_000

    def stream(self, spark: SparkSession, topic: str) -> DataFrame:
        """Committed records only, from the earliest on."""
        records = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", self.bootstrap_servers)
            .option("subscribe", topic)
            .option("startingOffsets", "earliest")
            .option("kafka.isolation.level", "read_committed")
            .option("maxOffsetsPerTrigger", self.max_offsets_per_trigger)
            .load()
        )
        return records.select(F.col("value").cast("string").alias("value"), "partition", "offset")

    def write(self, records: DataFrame, batch: str) -> None:
        """Written again, a batch is sent again: consumers drop events by their id."""
        (
            records.write.format("kafka")
            .option("kafka.bootstrap.servers", self.bootstrap_servers)
            .option("kafka.acks", "all")
            .option("kafka.enable.idempotence", "true")
            .option("kafka.compression.type", "lz4")
            .save()
        )


@dataclass(frozen=True)
class FolderTopics:
    root: str
    max_files_per_trigger: int = 1_000

    def stream(self, spark: SparkSession, topic: str) -> DataFrame:
        return (
            spark.readStream.schema("key string, value string")
            .option("maxFilesPerTrigger", self.max_files_per_trigger)
            .json(f"{self.root}/topic={topic}")
            .select("value")
        )

    def write(self, records: DataFrame, batch: str) -> None:
        """Written again, a batch replaces its files. Topics are few: a task keeps a file of
        each open, for sorting its records by topic would hold or spill all of them."""
        labelled = records.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("compression", "gzip")
        labelled = labelled.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_RECORDS)
        with setting(records.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_TOPICS)):
            labelled.partitionBy("topic", "batch").json(self.root)


_CORRUPT = "_corrupt_record"


def parse_records(records: DataFrame) -> DataFrame:
    """The columns of the event in ``value``, the other columns, and ``_readable``; ``value``
    stays where it is no event. Write the rows before they are split: a filter on what
    comes out of the text would parse it again."""
    schema = T.StructType([*EVENTS.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = records.withColumn("_event", F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT}))
    readable = F.col("_event").isNotNull() & F.col(f"_event.{_CORRUPT}").isNull()
    others = [name for name in records.columns if name != "value"]
    return parsed.select(
        *[F.col(f"_event.{name}").alias(name) for name in EVENTS.fieldNames()],
        F.when(~readable, F.col("value")).alias("value"),
        readable.alias("_readable"),
        *others,
    )


def split_unreadable(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events as flat rows, records whose ``value`` is no event) of parsed records; other
    columns stay."""
    others = [name for name in parsed.columns if name not in (*EVENTS.fieldNames(), "value", "_readable")]
    events = parsed.where("_readable").select(*EVENTS.fieldNames(), *others)
    return events, parsed.where("not _readable").select("value", *others)


def read_records(spark: SparkSession, topics: KafkaTopics | FolderTopics, cfg: EngineConfig) -> DataFrame:
    """The events topic as it is, text in ``value``."""
    return topics.stream(spark, cfg.events_topic)


def read_event_stream(spark: SparkSession, topics: KafkaTopics | FolderTopics, cfg: EngineConfig) -> DataFrame:
    """Events of the events topic as flat rows. A record that is no event is a row too,
    with its text in ``unreadable`` and nothing else; in events that column is null."""
    schema = T.StructType([*EVENTS.fields, T.StructField(_CORRUPT, T.StringType())])
    event = F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT})
    rows = read_records(spark, topics, cfg).select("value", event.alias("_event"))
    broken = F.col("_event").isNull() | F.col(f"_event.{_CORRUPT}").isNotNull()
    fields = [F.when(~broken, F.col(f"_event.{name}")).alias(name) for name in EVENTS.fieldNames()]
    return rows.select(*fields, F.when(broken, F.coalesce("value", F.lit(""))).alias("unreadable"))


def to_records(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(topic, key, partition, value): all events of one user share a partition."""
    key = partition_key(F.col("user_id"), F.col("anonymous_id"))
    return events.select(
        route_topic(F.col("event_type"), cfg).alias("topic"),
        key.alias("key"),
        partition_of(key, cfg.events_partitions).alias("partition"),
        F.to_json(F.struct(*events.columns)).alias("value"),
    )


def write_event_stream(
    events: DataFrame, topics: KafkaTopics | FolderTopics, cfg: EngineConfig, batch: str | None = None
) -> None:
    """Publish a batch. The broker places rows by key."""
    topics.write(to_records(events, cfg).select("topic", "key", "value"), batch or new_batch())


def write_dead_letter_topic(
    annotated: DataFrame, topics: KafkaTopics | FolderTopics, cfg: EngineConfig, batch: str | None = None
) -> None:
    records = annotated.select(
        F.lit(cfg.dead_letter_topic).alias("topic"),
        F.col("event_id").alias("key"),
        F.to_json(F.struct(*annotated.columns)).alias("value"),
    )
    topics.write(records, batch or new_batch())


def ordered_by_user(events: DataFrame, partitions: int, ts: str = "timestamp") -> DataFrame:
    """The layout of a topic for batch work: a user's events of a day in one partition, in
    order. Events without any id have no order to keep and are spread by event id.
    """
    known = F.coalesce("user_id", "anonymous_id")
    key = F.coalesce(F.concat(F.lit("k"), known), F.concat(F.lit("e"), F.col("event_id")))
    keyed = events.withColumns({"_key": key, "_day": partition_day(F.col(ts))})
    return (
        keyed.repartition(partitions, "_key", "_day")
        .sortWithinPartitions("_key", ts, "event_id")
        .drop("_key", "_day")
    )
