"""The two rollups, and the merge of partial rollups.

All measures are partial aggregates, so a heavy key is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.times import partition_day, start_of_hour

HOURLY_KEYS = ("hour", "user_id", "anonymous_id", "session_id", "spmb", "spmd", "event_type")
DAILY_KEYS = ("date", "user_id", "anonymous_id", "platform", "utm_source", "utm_medium", "utm_campaign")


def _of_type(name: str) -> Column:
    return F.count_if(F.col("event_type") == name)


def hourly_measures() -> list[Column]:
    return [
        F.count("*").alias("event_count"),
        _of_type("click").alias("click_count"),
        _of_type("exposure").alias("exposure_count"),
        _of_type("page_view").alias("page_view_count"),
        # sum and count instead of the mean, so that partial rows can be merged
        F.sum("stay_duration").alias("stay_sum"),
        F.count("stay_duration").alias("stay_count"),
        F.max("scroll_depth").alias("max_scroll_depth"),
    ]


def _finish_hourly(partial: DataFrame) -> DataFrame:
    mean = F.when(F.col("stay_count") > 0, F.col("stay_sum") / F.col("stay_count"))
    return partial.withColumn("avg_stay_duration", mean).select(
        *HOURLY_KEYS,
        "event_count",
        "click_count",
        "exposure_count",
        "page_view_count",
        "avg_stay_duration",
        "max_scroll_depth",
    )


def hourly_partials(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    keyed = events.withColumn("hour", start_of_hour(F.col(ts)))
    return keyed.groupBy(*HOURLY_KEYS).agg(*hourly_measures())


def events_hourly(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    return _finish_hourly(hourly_partials(events, ts))


def merge_hourly(partials: DataFrame) -> DataFrame:
    """Partial hourly rows of several batches to one row per key."""
    merged = partials.groupBy(*HOURLY_KEYS).agg(
        *[
            F.sum(name).alias(name)
            for name in (
                "event_count",
                "click_count",
                "exposure_count",
                "page_view_count",
                "stay_sum",
                "stay_count",
            )
        ],
        F.max("max_scroll_depth").alias("max_scroll_depth"),
    )
    return _finish_hourly(merged)


def daily_partials(sessions: DataFrame) -> DataFrame:
    keyed = sessions.withColumn("date", partition_day(F.col("start_time")))
    return keyed.groupBy(*DAILY_KEYS).agg(
        F.count("*").alias("session_count"),
        F.sum("page_views").alias("total_page_views"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("exposures").alias("total_exposures"),
        F.sum("duration").alias("total_duration"),
        F.count("duration").alias("duration_count"),
        F.sum("is_bounce").alias("bounce_count"),
        F.max("scroll_depth_max").alias("max_scroll_depth"),
    )


_DAILY_SUMS = (
    "session_count",
    "total_page_views",
    "total_clicks",
    "total_exposures",
    "total_duration",
    "duration_count",
    "bounce_count",
)


def _finish_daily(partial: DataFrame) -> DataFrame:
    mean = F.when(F.col("duration_count") > 0, F.col("total_duration") / F.col("duration_count"))
    return partial.withColumn("avg_duration", mean).select(
        *DAILY_KEYS,
        "session_count",
        "total_page_views",
        "total_clicks",
        "total_exposures",
        "total_duration",
        "avg_duration",
        "bounce_count",
        "max_scroll_depth",
    )


def daily_changes(changes: DataFrame) -> DataFrame:
    """What session rows that came (``sign`` 1) or went (-1) add to the sums of each key,
    the largest scroll depth that came (``_came``), and that went (``_went``)."""
    sign = F.col("sign")
    return (
        changes.withColumn("date", partition_day(F.col("start_time")))
        .groupBy(*DAILY_KEYS)
        .agg(
            F.sum(sign).alias("session_count"),
            F.sum(sign * F.col("page_views")).alias("total_page_views"),
            F.sum(sign * F.col("clicks")).alias("total_clicks"),
            F.sum(sign * F.col("exposures")).alias("total_exposures"),
            F.sum(sign * F.col("duration")).alias("total_duration"),
            F.sum(F.when(F.col("duration").isNotNull(), sign)).alias("duration_count"),
            F.sum(sign * F.col("is_bounce")).alias("bounce_count"),
            F.max(F.when(sign > 0, F.col("scroll_depth_max"))).alias("_came"),
            F.max(F.when(sign < 0, F.col("scroll_depth_max"))).alias("_went"),
        )
    )


def apply_daily_changes(partials: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial daily rows after ``daily_changes``; keys without sessions go. ``_stale``
    says that the largest scroll depth went and has to be found again."""
    was = partials.select(*DAILY_KEYS, *_DAILY_SUMS, F.col("max_scroll_depth").alias("_was"))
    both = was.unionByName(changes, allowMissingColumns=True).groupBy(*DAILY_KEYS).agg(
        *[F.sum(name).alias(name) for name in _DAILY_SUMS],
        *[F.max(name).alias(name) for name in ("_was", "_came", "_went")],
    )
    left = F.greatest("_was", "_came")
    stale = F.col("_went").isNotNull() & (F.col("_went") >= left)
    kept = both.where("session_count > 0").withColumns({"max_scroll_depth": left, "_stale": F.coalesce(stale, F.lit(False))})
    return kept.drop("_was", "_came", "_went")


def finish_daily(partials: DataFrame) -> DataFrame:
    """The rollup of partial rows that are one per key already."""
    return _finish_daily(partials)


def sessions_daily(sessions: DataFrame) -> DataFrame:
    """Run it over collapsed sessions (``replace_latest``): a repeated row counts twice."""
    return _finish_daily(daily_partials(sessions))


def merge_daily(partials: DataFrame) -> DataFrame:
    merged = partials.groupBy(*DAILY_KEYS).agg(
        *[F.sum(name).alias(name) for name in _DAILY_SUMS],
        F.max("max_scroll_depth").alias("max_scroll_depth"),
    )
    return _finish_daily(merged)
