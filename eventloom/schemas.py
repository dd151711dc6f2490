"""Row types of the inputs and tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, I, L = T.StringType(), T.IntegerType(), T.LongType()
TS, D, B = T.TimestampType(), T.DoubleType(), T.BooleanType()

# One event as clients send it. `custom` keeps the JSON text of the object, so
# numbers such as 2.0 survive unchanged when nothing is masked.
RAW_EVENT = _struct(
    ("eventId", S),
    ("eventType", S),
    ("userId", S),
    ("anonymousId", S),
    ("timestamp", L),
    ("clientTime", L),
    ("platform", S),
    ("appVersion", S),
    ("sdkVersion", S),
    ("consent", B),
    ("page", _struct(("url", S), ("title", S), ("referrer", S))),
    ("session", _struct(("sessionId", S), ("startTime", L))),
    ("device", _struct(("userAgent", S), ("screenWidth", I), ("screenHeight", I), ("language", S))),
    (
        "context",
        _struct(("utmSource", S), ("utmMedium", S), ("utmCampaign", S), ("utmTerm", S), ("utmContent", S)),
    ),
    (
        "data",
        _struct(
            ("scrollDepth", I),
            ("stayDuration", L),
            ("elementId", S),
            ("elementType", S),
            ("elementText", S),
            ("clickX", I),
            ("clickY", I),
            ("exposureDuration", L),
            ("exposureRatio", D),
            ("custom", S),
        ),
    ),
)

ENVELOPE = _struct(("clientId", S), ("events", T.ArrayType(RAW_EVENT)))

# The names and order of the columns of the events table.
EVENTS = _struct(
    ("event_id", S),
    ("event_type", S),
    ("user_id", S),
    ("anonymous_id", S),
    ("session_id", S),
    ("timestamp", TS),
    ("client_time", TS),
    ("received_at", TS),
    ("platform", S),
    ("app_version", S),
    ("sdk_version", S),
    ("page_url", S),
    ("page_title", S),
    ("page_referrer", S),
    ("spma", S),
    ("spmb", S),
    ("spmc", S),
    ("spmd", S),
    ("device_type", S),
    ("os", S),
    ("browser", S),
    ("screen_width", I),
    ("screen_height", I),
    ("language", S),
    ("element_id", S),
    ("element_type", S),
    ("element_text", S),
    ("click_x", I),
    ("click_y", I),
    ("scroll_depth", I),
    ("stay_duration", L),
    ("utm_source", S),
    ("utm_medium", S),
    ("utm_campaign", S),
    ("utm_term", S),
    ("utm_content", S),
    ("exp_ids", T.ArrayType(S)),
    ("variants", T.ArrayType(S)),
    ("properties", S),
    ("app_code", S),
)
EVENT_COLUMNS = tuple(EVENTS.fieldNames())

SESSIONS = _struct(
    ("session_id", S),
    ("user_id", S),
    ("anonymous_id", S),
    ("platform", S),
    ("start_time", TS),
    ("end_time", TS),
    ("duration", L),
    ("page_views", L),
    ("clicks", L),
    ("exposures", L),
    ("scroll_depth_max", I),
    ("is_bounce", I),
    ("bounce_page", S),
    ("first_page_url", S),
    ("last_page_url", S),
    ("utm_source", S),
    ("utm_medium", S),
    ("utm_campaign", S),
    ("device_type", S),
    ("os", S),
    ("last_active_at", TS),
    ("app_code", S),
)
SESSION_COLUMNS = tuple(SESSIONS.fieldNames())

CONTRACT = _struct(
    ("appId", S),
    ("version", L),
    (
        "events",
        T.MapType(S, _struct(("fields", T.ArrayType(_struct(("name", S), ("type", S), ("required", B)))))),
    ),
)

DEAD_LETTERS = _struct(
    ("event_id", S),
    ("event_type", S),
    ("user_id", S),
    ("event_json", S),
    ("reason", S),
    ("failed_at", TS),
    ("retry_count", I),
    ("next_retry_at", TS),
    ("updated_at", TS),
)
DEAD_LETTER_COLUMNS = tuple(DEAD_LETTERS.fieldNames())

IDENTITY_LINKS = _struct(("anonymous_id", S), ("user_id", S), ("linked_at", TS))

# What ingest remembers of sessions that may go on.
OPEN_SESSIONS = _struct(
    ("app_code", S),
    ("session_key", S),
    ("session_id", S),
    ("start_time", TS),
    ("last_active_at", TS),
    ("updated_at", TS),
)

# Accepted ids and when they arrived.
SEEN_IDS = _struct(("event_id", S), ("anchor_ts", TS), ("arrived_at", TS))
