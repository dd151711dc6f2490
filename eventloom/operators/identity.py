"""Visitor-to-user links and their use on anonymous events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.text import has_text
from eventloom.functions.times import plus_seconds
from eventloom.operators.skew import hour_of
from eventloom.workspace import write_through


def link_rows(events: DataFrame, allowed: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """(anonymous_id, user_id, linked_at, seq) of every event that carries both ids."""
    both = has_text("anonymous_id") & has_text("user_id")
    if allowed is not None:
        both = both & allowed
    return events.where(both).select("anonymous_id", "user_id", F.col(ts).alias("linked_at"), "seq")


def latest_link(links: DataFrame) -> DataFrame:
    """One row per visitor: the last link wins."""
    return (
        links.groupBy("anonymous_id")
        .agg(F.max(F.struct("linked_at", "seq", "user_id")).alias("_last"))
        .select("anonymous_id", "_last.user_id", "_last.linked_at")
    )


def upsert_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Identity table after a batch of links; a new link replaces and renews the old."""
    columns = ["anonymous_id", "user_id", "linked_at"]
    both = stored.select(*columns, F.lit(0).cast("long").alias("seq")).unionByName(new.select(*columns, "seq"))
    return latest_link(both)


def live_links(links: DataFrame, cfg: EngineConfig, now: Column) -> DataFrame:
    """Links that have not run out at ``now``."""
    return links.where(F.col("linked_at") > plus_seconds(now, -cfg.identity_ttl_days * 86_400))


#: Rows of a visitor's hour that one task puts in order; hours with more are cut.
HOUR_ROWS = 20_000


def slice_hours(rows: DataFrame, ts: str, limit: int = HOUR_ROWS) -> DataFrame:
    """Add ``_slice``: 0, or in hours of a visitor with more than ``limit`` rows the number
    of a range of (time, seq). Ranges are those of a range partitioning, so they are about
    even, however many rows share a second. Where no hour is that heavy, nothing moves."""
    # rows without a visitor have a lane each
    groups = rows.where(F.col("_lane").startswith("v")).groupBy("_lane", "_hour").agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    heavy = write_through(groups, "heavy-hours")
    total = heavy.agg(F.sum("_rows")).first()[0]
    if total is None:
        return rows.withColumn("_slice", F.lit(0))
    keys = heavy.select("_lane", "_hour")
    ranges = -(-2 * total // limit)
    cut = rows.join(keys, ["_lane", "_hour"], "left_semi").repartitionByRange(ranges, "_lane", ts, "seq")
    # the number of the partition is kept with its rows: a repeated task would find it again
    cut = write_through(cut.withColumn("_slice", F.spark_partition_id()), "hour-slices")
    return rows.join(keys, ["_lane", "_hour"], "left_anti").withColumn("_slice", F.lit(0)).unionByName(cut)


def resolve_identity(
    events: DataFrame,
    cfg: EngineConfig,
    allowed: Column | None = None,
    ts: str = "timestamp",
    stored: DataFrame | None = None,
    hour_rows: int = HOUR_ROWS,
) -> DataFrame:
    """Fill a missing user from the visitor's latest link at or before the event.

    An event with both ids is itself a link, for itself and everything after it in
    (time, seq) order; each link lives for the configured days. Rows for which
    ``allowed`` is false neither link nor are filled. ``stored`` are links of earlier
    batches (anonymous_id, user_id, linked_at). Adds ``identity_linked`` and
    ``identity_resolved``.
    """
    if not cfg.identity_enabled:
        return events.withColumn("identity_linked", F.lit(False)).withColumn("identity_resolved", F.lit(False))
    may = allowed if allowed is not None else F.lit(True)
    visitor = has_text("anonymous_id")
    # Rows without a visitor id need no history. Each gets a group of its own, so
    # they do not meet in one task.
    lane = F.when(visitor, F.concat(F.lit("v"), F.col("anonymous_id"))).otherwise(
        F.concat(F.lit("n"), F.col("seq").cast("string"))
    )
    prepared = events.withColumns(
        {"_lane": lane, "identity_linked": visitor & has_text("user_id") & may, "_may": may}
    )
    if stored is not None:
        before = stored.select(
            "anonymous_id",
            "user_id",
            F.col("linked_at").alias(ts),
            F.concat(F.lit("v"), F.col("anonymous_id")).alias("_lane"),
            F.lit(-1).cast("long").alias("seq"),
            F.lit(True).alias("identity_linked"),
            F.lit(True).alias("_stored"),
        )
        prepared = prepared.withColumn("_stored", F.lit(False)).unionByName(before, allowMissingColumns=True)
    # A window never spans more than an hour of a visitor, or a slice of a heavy hour. What
    # it inherits is the last link of an earlier one: one narrow row per hour and slice.
    sliced = slice_hours(prepared.withColumn("_hour", hour_of(F.unix_millis(F.col(ts)))), ts, hour_rows)
    link = F.when(F.col("identity_linked"), F.struct(F.col(ts).alias("at"), F.col("user_id").alias("user")))
    running = W.partitionBy("_lane", "_hour", "_slice").orderBy(ts, "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = sliced.withColumn("_link", F.last(link, ignorenulls=True).over(running))
    last = F.when(F.col("identity_linked"), F.struct(F.col(ts).alias("at"), F.col("seq"), F.col("user_id").alias("user")))
    ends = sliced.where(visitor).groupBy("_lane", "_hour", "_slice").agg(F.max(last).alias("_end"))
    earlier = W.partitionBy("_lane").orderBy("_hour", "_slice").rowsBetween(W.unboundedPreceding, -1)
    inherited = ends.select("_lane", "_hour", "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    inherited = inherited.where("_carry is not null").select(
        "_lane", "_hour", "_slice", F.struct(F.col("_carry.at").alias("at"), F.col("_carry.user").alias("user")).alias("_carry")
    )
    filled = filled.join(inherited, ["_lane", "_hour", "_slice"], "left").withColumn("_link", F.coalesce("_link", "_carry"))
    filled = filled.drop("_carry")
    if stored is not None:
        filled = filled.where(~F.col("_stored")).drop("_stored")
    alive = F.col(ts) < plus_seconds(F.col("_link.at"), cfg.identity_ttl_days * 86_400)
    resolves = F.coalesce(visitor & ~has_text("user_id") & F.col("_may") & alive, F.lit(False))
    return (
        filled.withColumn("identity_resolved", resolves)
        .withColumn("user_id", F.when(resolves, F.col("_link.user")).otherwise(F.col("user_id")))
        .drop("_lane", "_link", "_may", "_hour", "_slice")
    )
