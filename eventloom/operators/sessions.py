"""Sessions by inactivity gap.

Time is cut into spans as long as the gap. Two events of one span are less than a
gap apart, so they are always in one session: a span can be reduced to one row by
a plain aggregate, before any ordering and before the shuffle. Only these rows,
of which a key has a bounded number per day, are put in order to find the breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.keys import new_session_id
from eventloom.functions.text import has_text, is_set
from eventloom.functions.times import age_expired, sweep_due, trunc_second
from eventloom.schemas import OPEN_SESSIONS, SESSION_COLUMNS, SESSIONS
from eventloom.workspace import write_through

# The hashes come first among the keys: sorts compare one number instead of strings
# that mostly start alike. The keys themselves keep the grouping exact.
_ENTITY = ("_entity", "app_code", "_key")
_SPAN = ("_spot", *_ENTITY, "_span")
# Taken from the event that opens the session.
OPENING = (
    "user_id",
    "anonymous_id",
    "page_url",
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "device_type",
    "os",
)


def _with_seq(events: DataFrame) -> DataFrame:
    """Stored events have no arrival number; a hash of the id breaks ties then."""
    return events if "seq" in events.columns else events.withColumn("seq", F.xxhash64("event_id"))


def page_seen() -> Column:
    """A page view that names its page."""
    return (F.col("event_type") == "page_view") & is_set("page_url")


def session_key(cfg: EngineConfig, columns: list[str]) -> Column:
    """First usable id of an event; without any, the event is a session by itself."""
    ids = [
        F.when(has_text(name), F.concat(F.lit(f"{name}="), F.col(name)))
        for name in cfg.session_key_columns
        if name in columns
    ]
    return F.coalesce(*ids, F.concat(F.lit("event="), F.col("event_id"), F.lit("/"), F.col("seq").cast("string")))


def _counted(event_type: str) -> Column:
    return F.count_if(F.col("event_type") == event_type)


def counters() -> dict[str, Column]:
    """Counts per session; other event types only prolong it."""
    return {
        "page_views": _counted("page_view"),
        "clicks": _counted("click"),
        "exposures": _counted("exposure"),
        "scroll_depth_max": F.coalesce(
            F.greatest(F.lit(0), F.max(F.when(F.col("event_type") == "scroll", F.col("scroll_depth")))), F.lit(0)
        ),
    }


def _with_key(events: DataFrame, cfg: EngineConfig, ts: str) -> DataFrame:
    missing = {name: F.lit(None).cast("string") for name in OPENING if name not in events.columns}
    span = F.floor(F.unix_millis(F.col(ts)) / F.lit(cfg.session_timeout_s * 1000))
    return _with_seq(events).withColumns({**missing, "_key": session_key(cfg, events.columns), "_span": span}).withColumns(
        {"_entity": F.xxhash64("app_code", "_key"), "_spot": F.xxhash64("app_code", "_key", "_span")}
    )


def session_spans(events: DataFrame, cfg: EngineConfig, ts: str = "timestamp") -> DataFrame:
    """One row per key and span, with partial session measures."""
    return (
        _with_key(events, cfg, ts)
        .groupBy(*_SPAN)
        .agg(
            F.min(ts).alias("_start"),
            F.max(ts).alias("_end"),
            *[column.alias(name) for name, column in counters().items()],
            F.min(F.struct(F.col(ts).alias("_at"), "seq", *OPENING)).alias("_opening"),
            F.max(F.when(page_seen(), F.struct(F.col(ts).alias("_at"), "seq", "page_url"))).alias("_viewed"),
        )
    )


def number_sessions(spans: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Add the start of the session each span belongs to, and the session's id.

    Spans of earlier batches carry the id their session got then (``_known``); a
    session with such a span keeps the oldest id, others get a new one.
    """
    ordered = W.partitionBy(*_ENTITY).orderBy("_start", "_end")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    idle = F.unix_millis("_start") - F.unix_millis(F.max("_end").over(before))
    opens = idle.isNull() | (idle > cfg.session_timeout_s * 1000)
    began = spans.withColumn("_opens", opens).withColumn(
        "_session_start", F.last(F.when(F.col("_opens"), F.col("_start")), ignorenulls=True).over(so_far)
    )
    owner = F.concat_ws(":", F.col("app_code"), F.col("_key"))
    new = new_session_id(owner, F.col("_session_start"))
    if "_known" in spans.columns:
        whole = W.partitionBy(*_ENTITY, "_session_start").orderBy("_start", "_end")
        whole = whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        new = F.coalesce(F.first("_known", ignorenulls=True).over(whole), new)
    return began.withColumn("_session", new).drop("_opens")


def session_rows(events: DataFrame, cfg: EngineConfig, ts: str = "timestamp") -> DataFrame:
    """The sessions table from events."""
    spans = number_sessions(session_spans(events, cfg, ts), cfg)
    merged = spans.groupBy(*_ENTITY, "_session_start", "_session").agg(
        F.max("_end").alias("end_time"),
        *[F.sum(name).alias(name) for name in ("page_views", "clicks", "exposures")],
        F.max("scroll_depth_max").alias("scroll_depth_max"),
        F.min("_opening").alias("_opening"),
        F.max("_viewed").alias("_viewed"),
    )
    return finalize(merged.withColumnRenamed("_session_start", "start_time"), cfg)


def finalize(merged: DataFrame, cfg: EngineConfig, *more: str) -> DataFrame:
    """Duration, bounce, first and last page of aggregated sessions; ``more`` columns stay."""
    duration = F.unix_millis("end_time") - F.unix_millis("start_time")
    bounce = (F.col("page_views") <= cfg.bounce_max_page_views) & (duration < cfg.bounce_below_ms)
    first_page = F.col("_opening.page_url")
    final = merged.withColumns(
        {
            "session_id": F.col("_session"),
            "platform": F.lit("web"),
            "duration": duration,
            "is_bounce": bounce.cast("int"),
            "bounce_page": F.when(bounce, first_page),
            "first_page_url": first_page,
            "last_page_url": F.coalesce(F.col("_viewed.page_url"), first_page),
            "last_active_at": F.col("end_time"),
            **{name: F.col(f"_opening.{name}") for name in OPENING if name != "page_url"},
        }
    )
    return final.select(*[F.col(name).cast(SESSIONS[name].dataType).alias(name) for name in SESSION_COLUMNS], *more)


def visits(events: DataFrame, cfg: EngineConfig, ts: str = "timestamp", stored: DataFrame | None = None) -> DataFrame:
    """One row per key and span with the id of its session; ``stored`` are open sessions
    of earlier batches (OPEN_SESSIONS), which go on where the gap allows."""
    spans = (
        _with_key(events, cfg, ts)
        .groupBy(*_SPAN)
        .agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"))
    )
    if stored is None:
        return number_sessions(spans, cfg)
    entities = spans.select(*_ENTITY).distinct()
    open_ = stored.select(
        "app_code",
        F.col("session_key").alias("_key"),
        F.xxhash64("app_code", "session_key").alias("_entity"),
        F.col("start_time").alias("_start"),
        F.col("last_active_at").alias("_end"),
        F.col("session_id").alias("_known"),
    )
    # only of the visitors that this batch has
    open_ = open_.join(write_through(entities, "entities"), list(_ENTITY), "left_semi")
    return number_sessions(spans.unionByName(open_, allowMissingColumns=True), cfg)


def open_sessions(spans: DataFrame, now: Column) -> DataFrame:
    """OPEN_SESSIONS rows of the sessions that numbered spans touch."""
    touched = spans.groupBy("app_code", "_key", "_session").agg(
        F.min("_start").alias("start_time"), F.max("_end").alias("last_active_at"), F.count("_spot").alias("_spans")
    )
    return touched.where("_spans > 0").select(
        "app_code",
        F.col("_key").alias("session_key"),
        F.col("_session").alias("session_id"),
        "start_time",
        "last_active_at",
        now.alias("updated_at"),
    )


def fold_open_sessions(rows: DataFrame, cfg: EngineConfig, now: Column) -> DataFrame:
    """Open sessions of several batches as one table. A session goes when nothing of it
    has arrived for ``session_keep_s``; the times of its events play no part."""
    merged = rows.groupBy("app_code", "session_key", "session_id").agg(
        F.min("start_time").alias("start_time"),
        F.max("last_active_at").alias("last_active_at"),
        F.max("updated_at").alias("updated_at"),
    )
    kept = merged.where(~age_expired(F.col("updated_at"), cfg.session_keep_s, now))
    return kept.select(*OPEN_SESSIONS.fieldNames())


def attach_sessions(
    events: DataFrame,
    cfg: EngineConfig,
    ts: str = "timestamp",
    members: Column | None = None,
    spans: DataFrame | None = None,
) -> DataFrame:
    """Replace the client's session id by the id of the session the event falls in.

    ``members`` limits the rows that make up sessions; ``spans`` are numbered already.
    """
    if spans is None:
        spans = visits(events if members is None else events.where(members), cfg, ts)
    helpers = [name for name in _SPAN if name not in events.columns]
    keyed = _with_key(events, cfg, ts).select(*events.columns, *helpers)
    numbered = spans.where("_span is not null").select(*_SPAN, "_session")
    # a heavy span is a heavy key of the left side only, which adaptive execution splits
    return (
        keyed.join(numbered, list(_SPAN), "left")
        .withColumn("session_id", F.col("_session"))
        .drop(*helpers, "_session")
    )


# -- sessions of stored events, which carry their final id ---------------------------


def session_parts(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Mergeable measures per session id. Plain aggregates: no order, no window."""
    missing = {name: F.lit(None).cast("string") for name in OPENING if name not in events.columns}
    return (
        _with_seq(events)
        .withColumns(missing)
        .where(is_set("session_id"))
        .groupBy("session_id")
        .agg(
            F.max("app_code").alias("app_code"),
            F.min(ts).alias("start_time"),
            F.max(ts).alias("end_time"),
            *[column.alias(name) for name, column in counters().items()],
            F.min(F.struct(F.col(ts).alias("_at"), "seq", *OPENING)).alias("_opening"),
            F.max(F.when(page_seen(), F.struct(F.col(ts).alias("_at"), "seq", "page_url"))).alias("_viewed"),
        )
    )


def merge_parts(parts: DataFrame, *more: Column) -> DataFrame:
    """Parts of several batches as one row per session."""
    return parts.groupBy("session_id").agg(
        F.max("app_code").alias("app_code"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        *[F.sum(name).alias(name) for name in ("page_views", "clicks", "exposures")],
        F.max("scroll_depth_max").alias("scroll_depth_max"),
        F.min("_opening").alias("_opening"),
        F.max("_viewed").alias("_viewed"),
        *more,
    )


def rows_of_parts(parts: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Sessions-table rows of merged parts."""
    return finalize(parts.withColumnRenamed("session_id", "_session"), cfg)


def split_live(sessions: DataFrame, cfg: EngineConfig, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions the sweep may finalize at ``now``, sessions still live)."""
    due = sweep_due(F.col("last_active_at"), cfg.session_timeout_s, now)
    return sessions.where(due), sessions.where(~due)


def session_sink_defaults(sessions: DataFrame) -> DataFrame:
    """Whole seconds, '' for missing text and 0 for missing counts."""

    def column(name: str) -> Column:
        kind = SESSIONS[name].dataType.typeName()
        value = F.col(name)
        if kind == "timestamp":
            return trunc_second(value)
        if kind == "string":
            return F.coalesce(value, F.lit(""))
        return F.coalesce(value, F.lit(0).cast(SESSIONS[name].dataType))

    return sessions.select(*[column(name).alias(name) for name in SESSION_COLUMNS])
