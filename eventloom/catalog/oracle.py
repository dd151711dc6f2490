"""Equivalent SQL for the queries, over the same Parquet tables."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
MID_MONTH = "TIMESTAMP '2024-01-15 12:00:00'"
DLQ_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
DLQ_LATER = "TIMESTAMP '2024-01-20 01:00:00'"

# The rules of tables.derive.
EV = r"""
base AS (
  SELECT event_id AS src, event_type AS src_type, user_id AS uid, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts0
  FROM events),
copies AS (
  SELECT *, 0 AS copy FROM base
  UNION ALL
  SELECT *, 1 AS copy FROM base WHERE src % 10 = 0 AND src_type IN ('view', 'click')),
ev AS (
  SELECT 'evt_' || src AS event_id,
    CASE src_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'click' WHEN 'signup' THEN '$identify'
      WHEN 'purchase' THEN 'purchase' ELSE CASE WHEN src % 2 = 0 THEN 'exposure' ELSE 'scroll' END END AS event_type,
    CASE WHEN copy = 0 AND src_type <> 'signup' AND src % 3 = 0 THEN NULL ELSE 'u' || uid END AS user_id,
    'a' || uid AS anonymous_id,
    'app' || (uid % 3) AS app_code,
    ts0 + to_seconds(CASE WHEN copy = 0 THEN 0 WHEN src % 20 = 0 THEN 400 ELSE 60 END) AS ts,
    (copy = 1 OR src % 7 <> 0) AS consent,
    '/p/' || (k % 10) AS page_url,
    CASE WHEN copy = 0 AND src_type = 'error' AND src % 2 = 1 THEN k END AS scroll_depth,
    CASE WHEN copy = 0 AND src_type = 'view' THEN CAST(floor(value * 1000) AS BIGINT) END AS stay_duration,
    src + copy * 1000000000 AS seq,
    CASE WHEN k % 3 = 0 THEN 'google' WHEN k % 3 = 1 THEN 'mail' END AS utm_source,
    CASE WHEN k % 3 = 0 THEN 'cpc' END AS utm_medium,
    CASE src % 8
      WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36'
      WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0'
      WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0'
      WHEN 3 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 Version/17.0 Safari/605.1.15'
      WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/120.0 Mobile Safari/537.36'
      WHEN 5 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Mobile/15E148 Safari/604.1'
      WHEN 6 THEN 'Opera/9.80 (Android tablet) Presto/2.12 Version/12.16'
    END AS user_agent,
    '{' || CASE WHEN k % 10 = 0 THEN '' ELSE '"orderId":"O' || k || '",' END
      || '"amount":' || CASE WHEN k % 10 = 1 THEN '"' || value || '"' ELSE CAST(value AS VARCHAR) END
      || ',"email":"u' || uid || '@example.com","phone":"1380000' || lpad(CAST(uid % 10000 AS VARCHAR), 4, '0')
      || '","vip":' || CASE WHEN k % 4 = 0 THEN 'null' WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS custom,
    src, k, copy, uid, value
  FROM copies),
behaviour AS (SELECT * FROM ev WHERE event_type <> '$identify')"""

# Device rules and the texts of violations.
DEVICE = """
CASE WHEN ua IS NULL THEN 'unknown'
     WHEN contains(lower(ua), 'mobile') OR contains(lower(ua), 'android') OR contains(lower(ua), 'iphone') THEN 'mobile'
     WHEN contains(lower(ua), 'tablet') OR contains(lower(ua), 'ipad') THEN 'tablet' ELSE 'desktop' END"""
OS = """
CASE WHEN ua IS NULL THEN 'unknown' WHEN contains(lower(ua), 'windows') THEN 'Windows'
     WHEN contains(lower(ua), 'mac os') OR contains(lower(ua), 'darwin') THEN 'macOS'
     WHEN contains(lower(ua), 'linux') THEN 'Linux' WHEN contains(lower(ua), 'android') THEN 'Android'
     WHEN contains(lower(ua), 'ios') OR contains(lower(ua), 'iphone') OR contains(lower(ua), 'ipad') THEN 'iOS'
     ELSE 'unknown' END"""
BROWSER = """
CASE WHEN ua IS NULL THEN 'unknown' WHEN contains(lower(ua), 'edg/') THEN 'Edge'
     WHEN contains(lower(ua), 'chrome/') AND NOT contains(lower(ua), 'chromium/') THEN 'Chrome'
     WHEN contains(lower(ua), 'firefox/') THEN 'Firefox'
     WHEN contains(lower(ua), 'safari/') AND NOT contains(lower(ua), 'chrome/') THEN 'Safari'
     WHEN contains(lower(ua), 'opera/') OR contains(lower(ua), 'opr/') THEN 'Opera' ELSE 'unknown' END"""

# The fixture contracts, as rules. `present` says whether the event has properties.
VIOLATIONS = """
CASE
  WHEN app_code = 'app0' AND event_type NOT IN ('purchase', 'page_view', 'click', 'scroll')
    THEN 'unknown event type (schema drift): ' || event_type
  WHEN app_code = 'app0' AND event_type = 'purchase' THEN concat_ws('; ',
    CASE WHEN NOT present OR k % 10 = 0 THEN 'missing required field: orderId' END,
    CASE WHEN NOT present THEN 'missing required field: amount'
         WHEN k % 10 = 1 THEN 'field ''amount'' expected number but got string' END)
  WHEN app_code = 'app2' AND event_type NOT IN ('purchase', 'scroll', 'page_view', 'click', 'exposure')
    THEN 'unknown event type (schema drift): ' || event_type
  WHEN app_code = 'app2' AND event_type = 'purchase' THEN concat_ws('; ',
    CASE WHEN NOT present THEN 'missing required field: amount'
         WHEN k % 10 = 1 THEN 'field ''amount'' expected Integer but got string'
         WHEN value <> floor(value) THEN 'field ''amount'' expected Integer but got number' END,
    CASE WHEN NOT present THEN 'missing required field: email' END)
  WHEN app_code = 'app2' AND event_type = 'scroll' THEN concat_ws('; ',
    CASE WHEN present THEN 'field ''phone'' expected number but got string' END,
    CASE WHEN NOT present OR k % 4 = 0 THEN 'missing required field: vip' END)
  ELSE '' END"""

# The rules of tables.raw_events, flattened.
RAW = EV + f""",
raw AS (
  SELECT * REPLACE (
      CASE WHEN copy = 0 AND src % 97 = 0 THEN NULL ELSE event_id END AS event_id,
      CASE WHEN copy = 0 AND src % 101 = 0 THEN '' ELSE event_type END AS event_type,
      CASE WHEN event_type = '$identify' AND src % 5 = 0 THEN '  ' ELSE user_id END AS user_id),
    NOT (copy = 0 AND src % 103 = 0) AS has_ts,
    k % 25 <> 24 AS present
  FROM ev),
judged AS (
  SELECT *, {VIOLATIONS} AS violations,
    event_id IS NOT NULL AND event_type <> '' AND has_ts AS valid
  FROM raw),
slots AS (
  SELECT event_id, ts, seq FROM judged WHERE valid AND event_type <> '$identify' AND violations = '')"""


def dedup_walk(slots: str, name: str = "walk") -> str:
    """Recursive walk over the copies of each id: keep one, go to the first copy at
    least 300 s later."""
    return f"""{name}(event_id, ts) AS (
  SELECT event_id, min(ts) FROM {slots} GROUP BY event_id
  UNION ALL
  SELECT s.event_id, min(s.ts) FROM {name} w JOIN {slots} s
    ON s.event_id = w.event_id AND s.ts >= w.ts + to_seconds(300) GROUP BY s.event_id),
{name}_kept AS (
  SELECT w.event_id, w.ts, min(s.seq) AS seq FROM {name} w JOIN {slots} s
    ON s.event_id = w.event_id AND s.ts = w.ts GROUP BY w.event_id, w.ts)"""


OUTCOME = RAW + ",\n" + dedup_walk("slots") + """,
classified AS (
  SELECT j.*,
    CASE WHEN NOT valid THEN 'validation_failed'
         WHEN j.event_type = '$identify' AND trim(user_id) <> '' THEN 'identified'
         WHEN j.event_type = '$identify' THEN 'identify_rejected'
         WHEN violations <> '' THEN 'schema_violation'
         WHEN d.seq IS NULL THEN 'duplicate'
         ELSE 'accepted' END AS outcome
  FROM judged j LEFT JOIN walk_kept d ON j.seq = d.seq)"""


def sessions_sql(source: str, gap_s: int, prefix: str = "s", parent: str = EV) -> str:
    """Numbered events and session rows of one source."""
    return f"""{parent},
{prefix}_lag AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > to_seconds({gap_s}) THEN 1 ELSE 0 END AS opens
  FROM {source} WINDOW w AS (PARTITION BY app_code, anonymous_id ORDER BY ts, seq)),
{prefix}_num AS (
  SELECT *, sum(opens) OVER (PARTITION BY app_code, anonymous_id ORDER BY ts, seq
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no
  FROM {prefix}_lag),
""" + session_rows_sql(
        prefix,
        "'sess_' || substr(sha256(app_code || ':anonymous_id=' || anonymous_id || ':' || epoch_ms(start_time)), 1, 32)",
    )


def session_rows_sql(prefix: str, session_id: str) -> str:
    """Session rows of events that are numbered by session (``no``)."""
    return f"""{prefix}_agg AS (
  SELECT app_code, anonymous_id, no, min(ts) AS start_time, max(ts) AS end_time,
    count(*) FILTER (event_type = 'page_view') AS page_views,
    count(*) FILTER (event_type = 'click') AS clicks,
    count(*) FILTER (event_type = 'exposure') AS exposures,
    CAST(greatest(0, coalesce(max(scroll_depth) FILTER (event_type = 'scroll'), 0)) AS INTEGER) AS scroll_depth_max,
    list(user_id ORDER BY ts, seq)[1] AS user_id,
    list(page_url ORDER BY ts, seq)[1] AS first_page_url,
    list(utm_source ORDER BY ts, seq)[1] AS utm_source,
    list(utm_medium ORDER BY ts, seq)[1] AS utm_medium,
    list(page_url ORDER BY ts DESC, seq DESC) FILTER (event_type = 'page_view')[1] AS last_viewed
  FROM {prefix}_num GROUP BY app_code, anonymous_id, no),
{prefix}_rows AS (
  SELECT {session_id} AS session_id,
    user_id, anonymous_id, 'web' AS platform, start_time, end_time,
    epoch_ms(end_time) - epoch_ms(start_time) AS duration,
    page_views, clicks, exposures, scroll_depth_max,
    CASE WHEN page_views <= 1 AND epoch_ms(end_time) - epoch_ms(start_time) < 10000 THEN 1 ELSE 0 END AS is_bounce,
    CASE WHEN page_views <= 1 AND epoch_ms(end_time) - epoch_ms(start_time) < 10000 THEN first_page_url END AS bounce_page,
    first_page_url, coalesce(last_viewed, first_page_url) AS last_page_url,
    utm_source, utm_medium, CAST(NULL AS VARCHAR) AS utm_campaign,
    CAST(NULL AS VARCHAR) AS device_type, CAST(NULL AS VARCHAR) AS os,
    end_time AS last_active_at, app_code, no
  FROM {prefix}_agg)"""


SESSION_LIST = """session_id, user_id, anonymous_id, platform, start_time, end_time, duration, page_views, clicks,
  exposures, scroll_depth_max, is_bounce, bounce_page, first_page_url, last_page_url, utm_source, utm_medium,
  utm_campaign, device_type, os, last_active_at, app_code"""

STORED_SESSIONS = """SELECT session_id, coalesce(user_id, '') AS user_id, anonymous_id, platform,
  CAST(date_trunc('second', start_time) AS TIMESTAMP) AS start_time, CAST(date_trunc('second', end_time) AS TIMESTAMP) AS end_time,
  duration, page_views, clicks, exposures, scroll_depth_max, is_bounce, coalesce(bounce_page, '') AS bounce_page,
  first_page_url, last_page_url, coalesce(utm_source, '') AS utm_source, coalesce(utm_medium, '') AS utm_medium,
  '' AS utm_campaign, '' AS device_type, '' AS os,
  CAST(date_trunc('second', last_active_at) AS TIMESTAMP) AS last_active_at, app_code FROM s_rows"""

# Sessions that clients name: a visitor and five days.
NAMED_SESSIONS = (
    EV + ",\ns_num AS (SELECT *, epoch_ms(ts) // 432000000 AS no FROM behaviour),\n" + session_rows_sql("s", "anonymous_id || '-' || no")
)

DAILY = """
SELECT strftime(start_time, '%Y-%m-%d') AS date, user_id, anonymous_id, platform, utm_source, utm_medium, utm_campaign,
  count(*) AS session_count, CAST(sum(page_views) AS BIGINT) AS total_page_views,
  CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(exposures) AS BIGINT) AS total_exposures,
  CAST(sum(duration) AS BIGINT) AS total_duration, round(avg(duration), 6) AS avg_duration,
  CAST(sum(is_bounce) AS BIGINT) AS bounce_count, CAST(max(scroll_depth_max) AS DOUBLE) AS max_scroll_depth
FROM s_rows GROUP BY ALL"""

HOURLY = """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, user_id, anonymous_id, anonymous_id AS session_id, page_url AS spmb,
  page_url || '#' || event_type AS spmd, event_type, count(*) AS event_count,
  count(*) FILTER (event_type = 'click') AS click_count,
  count(*) FILTER (event_type = 'exposure') AS exposure_count,
  count(*) FILTER (event_type = 'page_view') AS page_view_count,
  round(avg(stay_duration), 6) AS avg_stay_duration, CAST(max(scroll_depth) AS DOUBLE) AS max_scroll_depth
FROM behaviour{where} GROUP BY ALL"""

IDENTITY = """,
device AS (SELECT * REPLACE (CASE WHEN k >= 50 THEN user_id || 'b' ELSE user_id END AS user_id) FROM ev),
linked AS (
  SELECT *, last_value(CASE WHEN user_id IS NOT NULL THEN {{'at': ts, 'u': user_id}} END IGNORE NULLS) OVER (
    PARTITION BY anonymous_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS link
  FROM device)
SELECT seq, event_id,
  CASE WHEN user_id IS NULL AND ts < link.at + to_days({days}) THEN link.u ELSE user_id END AS user_id,
  user_id IS NOT NULL AS identity_linked,
  coalesce(user_id IS NULL AND ts < link.at + to_days({days}), FALSE) AS identity_resolved
FROM linked"""

DLQ_NEW = EV + """,
fresh AS (
  SELECT event_id, event_type, user_id,
    CASE WHEN k % 17 = 0 THEN FALSE WHEN k % 19 = 0 THEN FALSE ELSE TRUE END AS readable,
    k % 17 <> 0 AND k % 19 <> 0 AS has_url, page_url,
    CASE k % 3 WHEN 0 THEN 'validation_failed' WHEN 1 THEN 'schema_violation' ELSE 'collection_failed' END AS reason,
    ts AS failed_at, CAST(CASE WHEN copy = 0 THEN k % 12 ELSE 0 END AS INTEGER) AS retry_count,
    ts AS updated_at, k, src, app_code, value
  FROM behaviour),
timed AS (
  SELECT *, CASE WHEN k % 13 <> 0 THEN failed_at + to_seconds(CAST(pow(2, least(retry_count, 10)) AS BIGINT)) END AS next_retry_at
  FROM fresh),
dlq AS (
  SELECT * FROM timed QUALIFY row_number() OVER (PARTITION BY reason, event_id ORDER BY updated_at DESC) = 1),
alive AS (SELECT * FROM dlq WHERE readable AND updated_at + to_days(7) > """ + DLQ_NOW + """),
due AS (SELECT * FROM alive WHERE next_retry_at IS NULL OR next_retry_at <= """ + DLQ_NOW + """)"""

ENTRY = "event_id, reason, failed_at, retry_count, next_retry_at"

REPLAY = DLQ_NEW + f""",
batch AS (
  SELECT * FROM due WHERE retry_count < 10 ORDER BY failed_at, reason, event_id LIMIT 100),
decided AS (
  SELECT b.*, TRUE AS present FROM batch b),
replayed AS (
  SELECT *, CASE WHEN k < 50 THEN 'already_processed'
    WHEN {VIOLATIONS} <> '' THEN 'failed' ELSE 'replayed' END AS replay_outcome
  FROM decided)"""


LIFECYCLE = REPLAY + f""",
after AS (
  SELECT a.* REPLACE (
      CAST(CASE WHEN r.replay_outcome = 'failed' THEN a.retry_count + 1 ELSE a.retry_count END AS INTEGER) AS retry_count,
      CASE WHEN r.replay_outcome = 'failed' THEN {DLQ_NOW} + to_seconds(CAST(pow(2, least(a.retry_count + 1, 10)) AS BIGINT))
           ELSE a.next_retry_at END AS next_retry_at,
      CASE WHEN r.replay_outcome = 'failed' THEN {DLQ_NOW} ELSE a.updated_at END AS updated_at)
  FROM alive a LEFT JOIN replayed r ON r.reason = a.reason AND r.event_id = a.event_id
  WHERE NOT (a.retry_count >= 10 AND (a.next_retry_at IS NULL OR a.next_retry_at <= {DLQ_NOW}))
    AND (r.replay_outcome IS NULL OR r.replay_outcome = 'failed')),
alive2 AS (SELECT * FROM after WHERE updated_at + to_days(7) > {DLQ_LATER}),
due2 AS (SELECT * FROM alive2 WHERE next_retry_at IS NULL OR next_retry_at <= {DLQ_LATER}),
batch2 AS (SELECT *, TRUE AS present FROM due2 WHERE retry_count < 10 ORDER BY failed_at, reason, event_id LIMIT 100),
replayed2 AS (
  SELECT *, CASE WHEN k < 50 OR event_id IN (SELECT event_id FROM replayed WHERE replay_outcome = 'replayed') THEN 'already_processed'
    WHEN {VIOLATIONS} <> '' THEN 'failed' ELSE 'replayed' END AS replay_outcome
  FROM batch2),
waiting AS (
  SELECT a.event_id, a.reason, a.failed_at,
    CAST(CASE WHEN r.replay_outcome = 'failed' THEN a.retry_count + 1 ELSE a.retry_count END AS INTEGER) AS retry_count,
    CASE WHEN r.replay_outcome = 'failed' THEN {DLQ_LATER} + to_seconds(CAST(pow(2, least(a.retry_count + 1, 10)) AS BIGINT))
         ELSE a.next_retry_at END AS next_retry_at
  FROM alive2 a LEFT JOIN replayed2 r ON r.reason = a.reason AND r.event_id = a.event_id
  WHERE NOT (a.retry_count >= 10 AND (a.next_retry_at IS NULL OR a.next_retry_at <= {DLQ_LATER}))
    AND (r.replay_outcome IS NULL OR r.replay_outcome = 'failed')),
gone AS (
  SELECT {ENTRY} FROM due WHERE retry_count >= 10
  UNION ALL SELECT {ENTRY} FROM due2 WHERE retry_count >= 10),
written AS (
  SELECT event_id, event_type, failed_at FROM replayed WHERE replay_outcome = 'replayed'
  UNION SELECT event_id, event_type, failed_at FROM replayed2 WHERE replay_outcome = 'replayed')"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


def _properties(user: str, email: str, phone: str, order: str, amount: str, masked: str, denied: str) -> str:
    return f"""SELECT seq, {user} AS user_id, {email} AS email, {phone} AS phone, {order} AS order_id,
  {amount} AS amount, {masked} AS pii_masked, {denied} AS consent_denied FROM (
  SELECT *, 'u' || uid || '@example.com' AS e, '1380000' || lpad(CAST(uid % 10000 AS VARCHAR), 4, '0') AS p,
    CASE WHEN k % 10 <> 0 THEN 'O' || k END AS o, CAST(value AS VARCHAR) AS a FROM behaviour)"""


def _hash(text: str) -> str:
    return f"'h:' || substr(sha256({text}), 1, 16)"


RAW_DERIVED = RAW + f""",
flat AS (
  SELECT *, CASE WHEN has_ts THEN ts ELSE {NOW} END AS ts1, CASE WHEN k % 7 <> 0 THEN user_agent END AS ua,
    k % 7 <> 0 AS has_device
  FROM raw)"""

# Session ids and identities of the accepted events.
INGESTED = OUTCOME + """,
going AS (
  SELECT * FROM classified WHERE outcome IN ('accepted', 'identified')),
members AS (SELECT * FROM going WHERE outcome = 'accepted')"""

INGEST_EVENTS = _with(
    sessions_sql("members", 1800, parent=INGESTED)
    + """,
identity AS (
  SELECT *, last_value(nullif(trim(user_id), '') IGNORE NULLS) OVER (
    PARTITION BY anonymous_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS who
  FROM going)""",
    """SELECT n.seq, n.event_id, n.event_type, i.who AS user_id, n.anonymous_id, r.session_id, n.ts, n.app_code,
  CASE WHEN n.present THEN n.custom END AS properties
FROM s_num n JOIN s_rows r ON r.app_code = n.app_code AND r.anonymous_id = n.anonymous_id AND r.no = n.no
JOIN identity i ON i.seq = n.seq""",
    True,
)

METRICS_FLAGS = OUTCOME + """,
flags AS (
  SELECT *, outcome IN ('accepted', 'identified') AS goes,
    CASE WHEN NOT consent THEN NULL ELSE nullif(trim(coalesce(user_id, '')), '') END AS open_user
  FROM classified),
linked AS (
  SELECT *, last_value(CASE WHEN open_user IS NOT NULL THEN {'at': ts} END IGNORE NULLS) OVER (
    PARTITION BY anonymous_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS link
  FROM flags WHERE goes)"""

ORACLE: dict[str, str] = {
    "ingest_outcomes": _with(OUTCOME, "SELECT seq, event_id, event_type, app_code, outcome FROM classified", True),
    "ingest_summary": _with(
        OUTCOME,
        """SELECT app_code, count(*) FILTER (outcome IN ('accepted', 'identified')) AS accepted,
  count(*) FILTER (outcome = 'duplicate') AS duplicate,
  count(*) FILTER (outcome IN ('validation_failed', 'identify_rejected', 'schema_violation')) AS rejected,
  count(*) FILTER (outcome IN ('validation_failed', 'schema_violation')) AS dead_lettered
FROM classified GROUP BY app_code""",
        True,
    ),
    "ingest_metrics": _with(
        METRICS_FLAGS,
        """SELECT count(*) FILTER (outcome IN ('accepted', 'identified')) AS accepted,
  count(*) FILTER (outcome = 'duplicate') AS duplicate,
  count(*) FILTER (outcome IN ('validation_failed', 'identify_rejected', 'schema_violation')) AS rejected,
  count(*) FILTER (outcome IN ('validation_failed', 'schema_violation')) AS dlq_stored,
  count(*) FILTER (outcome = 'schema_violation') AS schema_violation,
  count(*) FILTER (outcome = 'accepted' AND consent AND (open_user IS NOT NULL OR present)) AS pii_masked,
  count(*) FILTER (outcome = 'accepted' AND NOT consent) AS consent_denied,
  (SELECT count(*) FROM linked WHERE open_user IS NOT NULL) AS identity_linked,
  (SELECT count(*) FROM linked WHERE open_user IS NULL AND consent AND ts < link.at + to_days(90)) AS identity_resolved
FROM flags""",
        True,
    ),
    "ingest_events": INGEST_EVENTS,
    # with all state remembered, two batches give what one gives
    "ingest_two_batches": INGEST_EVENTS,
    "identity_store": _with(
        INGESTED,
        """SELECT anonymous_id, user_id, ts AS linked_at FROM going WHERE trim(user_id) <> ''
QUALIFY row_number() OVER (PARTITION BY anonymous_id ORDER BY ts DESC, seq DESC) = 1""",
        True,
    ),
    "event_session_join": _with(
        sessions_sql("members", 1800, parent=INGESTED),
        """SELECT n.event_id, n.ts, r.session_id, r.page_views, TRUE AS found
FROM s_num n JOIN s_rows r ON r.app_code = n.app_code AND r.anonymous_id = n.anonymous_id AND r.no = n.no""",
        True,
    ),
    "reject_records": _with(
        RAW,
        f"""SELECT event_id, event_type, user_id, anonymous_id, CASE WHEN has_ts THEN ts ELSE {NOW} END AS ts, {NOW} AS received_at
FROM raw WHERE event_id IS NULL OR event_type = '' OR NOT has_ts""",
    ),
    "enrich_fallback": _with(
        RAW_DERIVED,
        f"""SELECT seq, CASE WHEN seq % 4 < 2 THEN {NOW} ELSE ts1 END AS ts,
  CASE WHEN src % 2 = 0 AND seq % 4 <> 2 THEN ts - INTERVAL 250 MILLISECOND END AS client_time,
  CASE WHEN has_device THEN CASE WHEN seq % 4 = 3 THEN 'desktop' ELSE {DEVICE} END END AS device_type,
  CASE WHEN has_device THEN CASE WHEN seq % 4 = 3 THEN 'unknown' ELSE {OS} END END AS os,
  CASE WHEN has_device THEN CASE WHEN seq % 4 = 3 THEN 'unknown' ELSE {BROWSER} END END AS browser FROM flat""",
    ),
    "ingest_dead_letters": _with(
        OUTCOME,
        f"""SELECT event_id, event_type, user_id, outcome AS reason, 0 AS retry_count, {NOW} AS failed_at,
  {NOW} AS next_retry_at, anonymous_id, app_code, CASE WHEN present THEN custom END AS properties
FROM classified WHERE outcome IN ('validation_failed', 'schema_violation')""",
        True,
    ),
    "envelope_events": _with(
        RAW
        + """,
env AS (SELECT *, (seq % 1000000000) // 40 AS n FROM raw),
named AS (SELECT *, CASE WHEN n % 3 <> 0 THEN 'app' || (n % 3) ELSE 'default' END AS client FROM env)""",
        """SELECT client AS app_code, count(*) FILTER (n % 10 <> 9) AS events,
  count(event_id) FILTER (n % 10 <> 9) AS with_id, count(*) FILTER (n % 10 <> 9) AS numbers,
  CAST(sum(scroll_depth) FILTER (n % 10 <> 9) AS BIGINT) AS scroll_sum,
  count(DISTINCT n) FILTER (n % 10 = 9) AS refused_envelopes
FROM named GROUP BY client""",
    ),
    "enrich_events": _with(
        RAW_DERIVED,
        f"""SELECT coalesce(event_id, '') AS event_id, event_type, coalesce(user_id, '') AS user_id, anonymous_id,
  '' AS session_id, ts1 AS ts,
  CASE WHEN src % 2 = 0 AND has_ts THEN ts - INTERVAL 250 MILLISECOND WHEN src % 2 = 0 THEN ts - INTERVAL 250 MILLISECOND
       ELSE ts1 END AS client_time,
  {NOW} AS received_at, 'web' AS platform, '' AS app_version, '1.2.0' AS sdk_version,
  CASE WHEN k < 90 THEN page_url ELSE '' END AS page_url,
  CASE WHEN has_device THEN {DEVICE} ELSE '' END AS device_type,
  CASE WHEN has_device THEN {OS} ELSE '' END AS os,
  CASE WHEN has_device THEN {BROWSER} ELSE '' END AS browser,
  CASE WHEN has_device AND k % 2 = 0 THEN 1920 ELSE 0 END AS screen_width,
  CASE WHEN has_device AND k % 2 = 0 THEN 1080 ELSE 0 END AS screen_height,
  CASE WHEN has_device THEN 'en' ELSE '' END AS language,
  CAST(CASE WHEN src_click THEN k END AS DOUBLE) AS click_x, CAST(NULL AS DOUBLE) AS click_y,
  CAST(scroll_depth AS DOUBLE) AS scroll_depth, CAST(stay_duration AS DOUBLE) AS stay_duration, coalesce(utm_source, '') AS utm_source, coalesce(utm_medium, '') AS utm_medium,
  '' AS utm_campaign, '' AS spmb, 0 AS n_exp, CASE WHEN present THEN custom ELSE '{{}}' END AS properties,
  app_code, strftime(ts1, '%Y-%m-%d') AS event_date
FROM (SELECT f.*, e.event_type = 'click' AS src_click FROM flat f JOIN ev e ON e.seq = f.seq)""",
    ),
    "device_parse": _with(
        EV,
        f"SELECT seq, {DEVICE} AS device_type, {OS} AS os, {BROWSER} AS browser FROM (SELECT seq, user_agent AS ua FROM ev)",
    ),
    "topic_routing": _with(
        EV,
        """SELECT CASE WHEN k < 10 OR k >= 90 THEN 'sessions' ELSE 'events' END AS topic,
  coalesce(user_id, anonymous_id, 'unknown') AS key, count(*) AS n FROM behaviour GROUP BY ALL""",
    ),
    "partition_key": _with(
        EV
        + """,
keyed AS (SELECT coalesce(user_id, anonymous_id, event_id) AS key FROM behaviour)""",
        """SELECT key, CAST(list_reduce(
    list_prepend(0::BIGINT, list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda h, c: (h * 31 + c) % 4294967296) % 2147483648 % 12 AS INTEGER) AS p, count(*) AS n
FROM keyed GROUP BY ALL""",
    ),
    "validate_contract": _with(
        EV,
        f"""SELECT seq, app_code, event_type, v AS violations,
  CASE WHEN v <> '' THEN 'VIOLATION_ENFORCE' ELSE 'PASS' END AS contract_outcome
FROM (SELECT *, {VIOLATIONS} AS v FROM (SELECT *, TRUE AS present FROM behaviour))""",
    ),
    "contract_outcomes": _with(
        EV,
        f"""SELECT mode, app_code, CASE WHEN mode = 'off' OR v = '' THEN 'PASS'
    WHEN mode = 'monitor' THEN 'VIOLATION_MONITOR' ELSE 'VIOLATION_ENFORCE' END AS contract_outcome, count(*) AS n
FROM (SELECT *, {VIOLATIONS} AS v FROM (SELECT *, TRUE AS present FROM behaviour)),
  (VALUES ('off'), ('monitor'), ('enforce')) AS modes(mode) GROUP BY ALL""",
    ),
    "privacy_hash": _with(
        EV, _properties(_hash("user_id"), _hash("e"), "p", _hash("o"), _hash("a"), "TRUE", "FALSE")
    ),
    "privacy_mask": _with(
        EV,
        _properties("user_id", "left(e, 1) || '***@example.com'", "'***' || right(p, 4)", "o", "a", "TRUE", "FALSE"),
    ),
    "consent_gate": _with(
        EV,
        _properties(
            "CASE WHEN consent THEN user_id END",
            f"CASE WHEN consent THEN {_hash('e')} END",
            f"CASE WHEN consent THEN {_hash('p')} END",
            "o",
            "a",
            "consent",
            "NOT consent",
        ),
    ),
    "dedup_anchored": _with(
        EV + ",\n" + dedup_walk("behaviour"), "SELECT seq, event_id, ts FROM walk_kept", True
    ),
    "anti_seen": _with(
        EV,
        """SELECT l.seq, l.event_id, l.ts FROM behaviour l WHERE copy = 1 AND NOT EXISTS (
  SELECT 1 FROM behaviour s WHERE s.copy = 0 AND s.event_id = l.event_id AND abs(epoch_ms(l.ts) - epoch_ms(s.ts)) < 300000)""",
    ),
    "identity_latest": _with(
        EV,
        """SELECT anonymous_id, user_id, ts AS linked_at FROM (
  SELECT anonymous_id, ts, seq, CASE WHEN k >= 50 THEN user_id || 'b' ELSE user_id END AS user_id FROM ev)
WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY anonymous_id ORDER BY ts DESC, seq DESC) = 1""",
    ),
    "identity_asof": "WITH " + EV + IDENTITY.format(days=90),
    "identity_short_ttl": "WITH " + EV + IDENTITY.format(days=1),
    "sessions": _with(sessions_sql("behaviour", 1800), f"SELECT {SESSION_LIST} FROM s_rows"),
    "sessions_long_gap": _with(sessions_sql("behaviour", 21600), f"SELECT {SESSION_LIST} FROM s_rows"),
    "session_events": _with(
        sessions_sql("behaviour", 21600),
        """SELECT n.seq, n.event_id, r.session_id FROM s_num n
JOIN s_rows r ON r.app_code = n.app_code AND r.anonymous_id = n.anonymous_id AND r.no = n.no""",
    ),
    "live_sessions": _with(
        sessions_sql(f"(SELECT * FROM behaviour WHERE ts <= {MID_MONTH})", 21600),
        f"""SELECT session_id, CASE WHEN last_active_at + to_seconds(21600) <= {MID_MONTH} THEN 'due' ELSE 'live' END AS state
FROM s_rows""",
    ),
    "finalized_sessions": _with(
        sessions_sql("behaviour", 21600),
        f"{STORED_SESSIONS} WHERE last_active_at + to_seconds(21600) <= {NOW}",
    ),
    "replace_latest": _with(
        EV,
        """SELECT anonymous_id, event_type, event_id, user_id, ts, seq, CAST(scroll_depth AS DOUBLE) AS scroll_depth FROM ev
QUALIFY row_number() OVER (PARTITION BY anonymous_id, event_type ORDER BY ts DESC, seq DESC) = 1""",
    ),
    "events_hourly": _with(EV, HOURLY.format(where="")),
    "rollup_merge": _with(EV, HOURLY.format(where="")),
    "sessions_daily": _with(sessions_sql("behaviour", 21600), DAILY),
    "rollup_merge_daily": _with(sessions_sql("behaviour", 21600), DAILY),
    "rate_cap": _with(
        EV,
        """SELECT seq, row_number() OVER (PARTITION BY app_code, date_trunc('hour', ts) ORDER BY seq) > 3 AS over_limit
FROM behaviour""",
    ),
    "backlog_gauges": _with(
        OUTCOME
        + ","
        + DLQ_NEW[len(EV) + 1 :]
        + sessions_sql(f"(SELECT * FROM behaviour WHERE ts <= {MID_MONTH})", 21600, parent=""),
        f"""SELECT 'dlq_size' AS gauge, CAST(count(*) AS DOUBLE) AS value FROM dlq
UNION ALL SELECT 'live_sessions', CAST(count(*) AS DOUBLE) FROM s_rows WHERE last_active_at + to_seconds(21600) > {MID_MONTH}
UNION ALL SELECT 'duplicate_share',
  round(count(*) FILTER (outcome = 'duplicate') / count(*) FILTER (outcome IN ('accepted', 'duplicate')), 6) FROM classified""",
        True,
    ),
    "dlq_store": _with(
        DLQ_NEW,
        f"SELECT {ENTRY}, updated_at, CASE WHEN has_url THEN page_url END AS page_url FROM dlq",
    ),
    "dlq_prune": _with(DLQ_NEW, f"SELECT {ENTRY} FROM alive"),
    "dlq_fetch": _with(
        DLQ_NEW,
        f"SELECT {ENTRY} FROM due WHERE retry_count < 10 ORDER BY failed_at, reason, event_id LIMIT 100",
    ),
    "dlq_dead": _with(DLQ_NEW, f"SELECT {ENTRY} FROM due WHERE retry_count >= 10"),
    "dlq_update": _with(
        DLQ_NEW
        + f""",
judged AS (
  SELECT *, (next_retry_at IS NULL OR next_retry_at <= {DLQ_NOW}) AND retry_count < 10 AS fetched FROM dlq)""",
        f"""SELECT event_id, reason, failed_at, CAST(CASE WHEN fetched THEN retry_count + 1 ELSE retry_count END AS INTEGER) AS retry_count,
  CASE WHEN fetched THEN {DLQ_NOW} + to_seconds(CAST(pow(2, least(retry_count + 1, 10)) AS BIGINT)) ELSE next_retry_at END AS next_retry_at,
  CASE WHEN fetched THEN {DLQ_NOW} ELSE updated_at END AS updated_at
FROM judged WHERE NOT (fetched AND retry_count % 2 = 0)""",
    ),
    "dlq_processed": _with(
        DLQ_NEW,
        """SELECT reason, event_id, event_id IN (SELECT event_id FROM ev WHERE k < 50) AS processed FROM dlq""",
    ),
    "dlq_annotate": _with(
        EV,
        f"""SELECT seq, 'collection_failed' AS dlq_reason,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_ms(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS dlq_original_timestamp,
  'u' || uid || '@example.com' AS email, {NOW} AS received_at FROM behaviour""",
    ),
    "dlq_replay": _with(REPLAY, "SELECT reason, event_id, retry_count, replay_outcome FROM replayed"),
    "dlq_after_replay": _with(
        REPLAY,
        f"""SELECT a.event_id, a.reason, a.failed_at,
  CAST(CASE WHEN r.replay_outcome = 'failed' THEN a.retry_count + 1 ELSE a.retry_count END AS INTEGER) AS retry_count,
  CASE WHEN r.replay_outcome = 'failed' THEN {DLQ_NOW} + to_seconds(CAST(pow(2, least(a.retry_count + 1, 10)) AS BIGINT))
       ELSE a.next_retry_at END AS next_retry_at,
  CASE WHEN r.replay_outcome = 'failed' THEN {DLQ_NOW} ELSE a.updated_at END AS updated_at
FROM alive a LEFT JOIN replayed r ON r.reason = a.reason AND r.event_id = a.event_id
WHERE NOT (a.retry_count >= 10 AND (a.next_retry_at IS NULL OR a.next_retry_at <= {DLQ_NOW}))
  AND (r.replay_outcome IS NULL OR r.replay_outcome = 'failed')""",
    ),
    "dlq_replay_private": _with(
        OUTCOME
        + """,
fetched AS (
  SELECT * FROM classified WHERE outcome = 'schema_violation' ORDER BY event_id LIMIT 100),
opened AS (
  SELECT *, CASE WHEN consent THEN nullif(trim(coalesce(user_id, '')), '') END AS open_user FROM fetched),
linked AS (
  SELECT *, last_value(CASE WHEN open_user IS NOT NULL THEN {'u': open_user} END IGNORE NULLS) OVER (
    PARTITION BY anonymous_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS link
  FROM opened)""",
        f"""SELECT event_id, event_type,
  CASE WHEN consent AND link.u IS NOT NULL THEN {_hash('link.u')} ELSE '' END AS user_id,
  CASE WHEN consent AND present THEN {_hash("'u' || uid || '@example.com'")} END AS email,
  CASE WHEN present THEN CASE WHEN consent THEN '***' || lpad(CAST(uid % 10000 AS VARCHAR), 4, '0')
    ELSE '1380000' || lpad(CAST(uid % 10000 AS VARCHAR), 4, '0') END END AS phone,
  ts, TRUE AS has_session FROM linked""",
        True,
    ),
    "dlq_lifecycle": _with(
        LIFECYCLE,
        f"""SELECT 'waiting' AS state, {ENTRY} FROM waiting
UNION ALL SELECT 'dead', {ENTRY} FROM gone WHERE failed_at + to_days(15) >= {DLQ_LATER}
UNION ALL SELECT 'event', event_id, event_type, failed_at, 0, NULL FROM written
UNION ALL SELECT 'event', event_id, event_type, ts, 0, NULL FROM ev WHERE k < 50""",
    ),
    "retention": _with(EV, f"SELECT seq, event_id, ts FROM ev WHERE ts + to_days(10) >= {NOW}"),
    "layout_roundtrip": _with(
        EV,
        f"""SELECT event_id, event_type, coalesce(user_id, '') AS user_id, ts, ts AS client_time, {NOW} AS received_at,
  page_url, 0 AS screen_width, CAST(scroll_depth AS DOUBLE) AS scroll_depth,
  CAST(stay_duration AS DOUBLE) AS stay_duration, custom AS properties, app_code FROM ev""",
    ),
    "layout_day_range": _with(
        EV,
        """SELECT event_id, ts FROM ev
WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""",
    ),
    "sessions_roundtrip": _with(sessions_sql("behaviour", 21600), STORED_SESSIONS),
    "evolve_schema": _with(
        EV,
        f"SELECT event_id, ts, CASE WHEN ts < {MID_MONTH} THEN '' ELSE app_code END AS app_code FROM ev",
    ),
    "skip_indexes": """SELECT name AS "column", TRUE AS skips, name = 'event_id' AS id_filter
FROM (VALUES ('event_id'), ('user_id'), ('session_id'), ('page_url'), ('spmb'), ('spmd'), ('app_code')) AS names(name)""",
    "cluster_order": _with(
        EV, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM ev GROUP BY ALL"
    ),
    "user_order": _with(
        EV,
        """SELECT coalesce(user_id, anonymous_id) AS key, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n,
  CAST(1 AS BIGINT) AS partitions, CAST(0 AS BIGINT) AS out_of_order FROM behaviour GROUP BY ALL""",
    ),
    "collect_fallback": _with(
        EV,
        """SELECT CASE src % 3 WHEN 0 THEN 'topic' WHEN 1 THEN 'table' ELSE 'dead' END AS place, event_id, CASE WHEN src % 3 = 2 THEN 1 ELSE count(*) END AS n
FROM behaviour GROUP BY event_id, src""",
    ),
    "consume_failure": _with(
        EV,
        """SELECT CASE src % 2 WHEN 0 THEN 'table' ELSE 'dead_topic' END AS place, event_id, count(*) AS n
FROM behaviour GROUP BY event_id, src""",
    ),
    "repeated_delivery": _with(
        EV,
        """SELECT place, event_id, CASE WHEN place = 'dead' THEN 1 ELSE count(*) END AS n
FROM behaviour, (VALUES ('topic'), ('dead_topic'), ('table'), ('dead')) AS p(place) GROUP BY place, event_id""",
    ),
    # A stream has sent what its final watermark, ten minutes before the last event, has passed.
    "stream_dedup": _with(EV, "SELECT DISTINCT event_id, event_type FROM behaviour"),
    "stream_dedup_anchored": _with(
        EV + ",\n" + dedup_walk("behaviour"), "SELECT seq, event_id, ts FROM walk_kept", True
    ),
    "stream_sessions": _with(
        sessions_sql("behaviour", 1800),
        f"""SELECT {SESSION_LIST} FROM s_rows
WHERE end_time + to_seconds(1800) <= (SELECT max(ts) - to_minutes(10) FROM behaviour)""",
    ),
    "stream_hourly": _with(
        EV,
        HOURLY.format(
            where="\nWHERE date_trunc('hour', ts) + to_hours(1) <= (SELECT max(ts) - to_minutes(10) FROM behaviour)"
        ),
    ),
    "stream_identity": "WITH " + EV + IDENTITY.format(days=90),
    "stream_identity_state": "WITH " + EV + IDENTITY.format(days=90),
    "stream_session_sweep": _with(
        sessions_sql("behaviour", 21600),
        f"{STORED_SESSIONS} WHERE last_active_at + to_seconds(21600) <= {NOW}",
    ),
    "stream_rate_cap": _with(
        EV,
        """SELECT seq, row_number() OVER (PARTITION BY app_code, date_trunc('hour', ts) ORDER BY seq) > 3 AS over_limit
FROM behaviour""",
    ),
    "stream_load": _with(
        EV + ",\n" + dedup_walk("behaviour"),
        "SELECT b.event_id, b.event_type, b.ts FROM behaviour b JOIN walk_kept w ON w.seq = b.seq",
        True,
    ),
    "stream_late": _with(
        EV
        + f""",
later AS (SELECT * FROM behaviour WHERE ts >= {MID_MONTH}),
sooner AS (SELECT * FROM behaviour WHERE ts < {MID_MONTH} AND NOT EXISTS (
  SELECT 1 FROM later l WHERE l.event_id = behaviour.event_id AND l.ts < behaviour.ts + to_seconds(300))),
"""
        + dedup_walk("later", "late_walk")
        + ",\n"
        + dedup_walk("sooner", "soon_walk"),
        """SELECT b.event_id, b.event_type, b.ts FROM behaviour b
WHERE b.seq IN (SELECT seq FROM late_walk_kept UNION ALL SELECT seq FROM soon_walk_kept)
UNION ALL SELECT '', event_type, ts FROM behaviour WHERE k = 7
UNION ALL SELECT 'far', 'page_view', TIMESTAMP '2034-01-01 00:00:00'
UNION ALL SELECT '{broken ' || seq, 'unreadable_record', NULL FROM behaviour WHERE k = 8""",
        True,
    ),
    "stream_then_replay_layout": _with(
        EV + ",\n" + dedup_walk("behaviour"),
        """SELECT event_id, ts FROM (
  SELECT event_id, ts FROM walk_kept
  UNION ALL (SELECT 'lost_' || event_id, ts FROM behaviour WHERE event_type = 'purchase' ORDER BY ts, 'lost_' || event_id LIMIT 100))
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'""",
        True,
    ),
    "consume_retry": _with(
        EV + ",\n" + dedup_walk("behaviour"),
        """SELECT place, event_id, count(*) AS n FROM walk_kept, (VALUES ('table'), ('dead_topic')) AS p(place) GROUP BY place, event_id""",
        True,
    ),
    "dlq_topic_roundtrip": _with(
        EV,
        """SELECT DISTINCT 'event' AS state, event_id, event_type FROM behaviour
UNION ALL SELECT 'waiting', '', event_type FROM behaviour WHERE event_type = 'purchase'""",
    ),
    "sessions_day_range": _with(
        NAMED_SESSIONS,
        f"{STORED_SESSIONS} WHERE start_time >= TIMESTAMP '2024-01-08 01:00:00' AND start_time < TIMESTAMP '2024-01-15 00:00:00'",
    ),
    "sessions_daily_upkeep": _with(NAMED_SESSIONS, DAILY.replace("user_id,", "coalesce(user_id, '') AS user_id,").replace(
        "utm_source, utm_medium, utm_campaign", "coalesce(utm_source, '') AS utm_source, coalesce(utm_medium, '') AS utm_medium, '' AS utm_campaign"
    )),
    "stream_hourly_late": _with(
        EV,
        HOURLY.format(
            where="\nWHERE date_trunc('hour', ts) + to_hours(1) <= (SELECT max(ts) - to_minutes(10) FROM behaviour)"
        ).replace("user_id,", "coalesce(user_id, '') AS user_id,", 1),
    ),
}
