"""The hourly rollup as a stream sends it, and the hours that late events change.

The stream sends an hour once, when its watermark passes it; events that come later are
not in what it sent. They are in the events table, whose day and batch folders say where:
the correction looks at the times in batches that it has not seen, keeps the hours that
the stream has closed, and computes those anew from the table in which more events lie
than were sent. A corrected hour takes the place of what the stream sent.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import EngineConfig
from eventloom.functions.times import start_of_hour
from eventloom.operators.rollups import hourly_partials, merge_hourly
from eventloom.schemas import EVENTS
from eventloom.sources.state import delete, exists, finished, read_note, write_note
from eventloom.sources.tables import COMPACTED, BatchNames, batches_of, read_events
from eventloom.streaming.rollups import hourly_stream
from eventloom.workspace import write_through


def send_hours(events: DataFrame, target: str, checkpoint: str, cfg: EngineConfig) -> None:
    """Run the hourly stream over what is there; note how far its watermark has come."""
    spark = events.sparkSession
    writer = hourly_stream(events, cfg).writeStream.format("parquet").outputMode("append").option("path", f"{target}/sent")
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    marks = [(progress.get("eventTime") or {}).get("watermark") for progress in query.recentProgress]
    reached = max((datetime.fromisoformat(mark) for mark in marks if mark), default=None)
    if reached is not None:
        millis = max(int(reached.timestamp() * 1000), _closed_until(spark, target))
        write_note(spark, f"{target}/watermark", [str(millis)])


def _closed_until(spark: SparkSession, target: str) -> int:
    """Hours that end by then (milliseconds) have been sent; before the first run, none."""
    noted = exists(spark, f"{target}/watermark/_SUCCESS")
    return int(read_note(spark, f"{target}/watermark")[0]) if noted else -(2**62)


def _sent(spark: SparkSession, target: str) -> DataFrame:
    schema = hourly_partials(spark.createDataFrame([], EVENTS)).schema
    return spark.read.schema(schema).parquet(f"{target}/sent")


def _corrected(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(partial rows of corrected hours, the hours with the run that corrected them last)."""
    schema = hourly_partials(spark.createDataFrame([], EVENTS)).schema
    schema = T.StructType([*schema.fields, T.StructField("run", T.LongType())])
    runs = finished(spark, target, "corrected-")
    if not runs:
        empty = spark.createDataFrame([], schema)
        return empty.drop("run"), empty.select("hour", "run")
    rows = spark.read.schema(schema).parquet(*[f"{target}/corrected-{run}" for run in runs])
    latest = rows.groupBy("hour").agg(F.max("run").alias("run"))
    return rows.join(latest, ["hour", "run"], "left_semi").drop("run"), latest


def correct_hours(spark: SparkSession, events: str, target: str) -> list[datetime]:
    """Compute anew the hours that late events have changed; returns them."""
    runs = finished(spark, target, "seen-")
    run = max(runs, default=-1) + 1
    known = BatchNames(read_note(spark, f"{target}/seen-{run - 1}") if runs else [])
    new = [b for b in batches_of(spark, events) if b not in known and not b.startswith(COMPACTED)]
    if not new:
        return []
    until = _closed_until(spark, target)
    ends = F.unix_millis("hour") + 3_600_000
    touched = read_events(spark, events, batches=new).select(start_of_hour(F.col("timestamp")).alias("hour")).distinct()
    # a bounded list, one row per hour: it prunes the days that are read
    hours = [row.hour for row in write_through(touched.where(ends <= until), "touched").orderBy("hour").collect()]
    changed: list[datetime] = []
    rows = spark.createDataFrame([], hourly_partials(spark.createDataFrame([], EVENTS)).schema)
    if hours:
        days = sorted({hour.date() for hour in hours})
        stored = read_events(spark, events, since=str(days[0]), until=f"{days[-1]} 23:59:59.999999", days=days)
        stored = stored.where(start_of_hour(F.col("timestamp")).isin(hours))
        have = stored.groupBy(start_of_hour(F.col("timestamp")).alias("hour")).agg(F.count("*").alias("have"))
        corrected, of = _corrected(spark, target)
        shown = _sent(spark, target).where(F.col("hour").isin(hours)).join(of, "hour", "left_anti").unionByName(corrected)
        shown = shown.groupBy("hour").agg(F.sum("event_count").alias("shown"))
        off = have.join(shown, "hour", "left").where(~F.col("have").eqNullSafe(F.col("shown")))
        changed = [row.hour for row in off.orderBy("hour").collect()]
        if changed:
            rows = hourly_partials(stored.where(start_of_hour(F.col("timestamp")).isin(changed)))
    if changed:
        rows.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{target}/corrected-{run}")
    # the note makes the run count; without it the run is done again
    known.add(new)
    write_note(spark, f"{target}/seen-{run}", known.lines())
    for earlier in runs:
        delete(spark, f"{target}/seen-{earlier}")
    return changed


def read_hourly(spark: SparkSession, target: str) -> DataFrame:
    """The hourly rollup: what was sent, with corrected hours in place of sent ones."""
    corrected, of = _corrected(spark, target)
    return merge_hourly(_sent(spark, target).join(of, "hour", "left_anti").unionByName(corrected))
