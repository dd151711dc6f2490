"""Raw nested events to flat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.device import device_columns
from eventloom.functions.text import properties_json
from eventloom.functions.times import epoch_ms_to_ts
from eventloom.schemas import EVENT_COLUMNS, EVENTS

# Flat column <- nested field.
COPIED = {
    "event_id": "eventId",
    "event_type": "eventType",
    "user_id": "userId",
    "anonymous_id": "anonymousId",
    "session_id": "session.sessionId",
    "platform": "platform",
    "app_version": "appVersion",
    "sdk_version": "sdkVersion",
    "page_url": "page.url",
    "page_title": "page.title",
    "page_referrer": "page.referrer",
    "screen_width": "device.screenWidth",
    "screen_height": "device.screenHeight",
    "language": "device.language",
    "element_id": "data.elementId",
    "element_type": "data.elementType",
    "element_text": "data.elementText",
    "click_x": "data.clickX",
    "click_y": "data.clickY",
    "scroll_depth": "data.scrollDepth",
    "stay_duration": "data.stayDuration",
    "exposure_duration": "data.exposureDuration",
    "exposure_ratio": "data.exposureRatio",
    "utm_source": "context.utmSource",
    "utm_medium": "context.utmMedium",
    "utm_campaign": "context.utmCampaign",
    "utm_term": "context.utmTerm",
    "utm_content": "context.utmContent",
    "custom": "data.custom",
}


def flatten_enrich(raw: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat events with parsed device columns.

    A missing parent gives null children; without a device the three device columns
    are null, with a device but no agent they are 'unknown'. ``sent_at`` is the time as
    sent, without a default. ``keep`` names further input columns to carry along. Every expression yields null on bad input, so an
    event is never lost here.
    """
    has_device = F.col("device").isNotNull()
    parsed = device_columns(F.col("_agent"))
    return raw.withColumn("_agent", F.lower("device.userAgent")).select(
        *[F.col(source).alias(name) for name, source in COPIED.items()],
        F.coalesce(epoch_ms_to_ts(F.col("timestamp")), now).alias("timestamp"),
        epoch_ms_to_ts(F.col("timestamp")).alias("sent_at"),
        epoch_ms_to_ts(F.col("clientTime")).alias("client_time"),
        now.alias("received_at"),
        *[F.when(has_device, column).alias(name) for name, column in parsed.items()],
        *[F.col(name) for name in keep],
    )


def stamp_app(events: DataFrame, client: Column) -> DataFrame:
    return events.withColumn("app_code", client)


def default_times(events: DataFrame, now: Column) -> DataFrame:
    """client_time falls back to timestamp, timestamp and received_at to ``now``."""
    ts = F.coalesce(F.col("timestamp"), now)

    def given(name: str) -> Column:
        return F.col(name) if name in events.columns else F.lit(None).cast("timestamp")

    return events.withColumns(
        {
            "client_time": F.coalesce(given("client_time"), ts),
            "received_at": F.coalesce(given("received_at"), now),
            "timestamp": ts,
        }
    )


# Only these stay null in the events table.
NULLABLE = ("click_x", "click_y", "scroll_depth", "stay_duration")


def sink_defaults(events: DataFrame) -> DataFrame:
    """The 40 columns of the events table: '' for missing text, 0 for missing screen
    sizes, [] for missing arrays; columns the input lacks get their default too."""
    have = set(events.columns)

    def column(name: str) -> Column:
        kind = EVENTS[name].dataType
        if name == "properties":
            source = "properties" if "properties" in have else "custom"
            return properties_json(F.col(source) if source in have else F.lit(None).cast("string"))
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name in NULLABLE or kind.typeName() == "timestamp":
            return value
        if kind.typeName() == "array":
            return F.coalesce(value, F.array().cast(kind))
        if kind.typeName() == "string":
            return F.coalesce(value, F.lit(""))
        return F.coalesce(value, F.lit(0).cast(kind))

    return events.select(*[column(name).alias(name) for name in EVENT_COLUMNS])
