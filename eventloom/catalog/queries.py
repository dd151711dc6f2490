"""One query per operator that yields a table. Each reads the whole input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.catalog import tables as I
from eventloom.config import EngineConfig
from eventloom.functions.contracts import contract_outcome
from eventloom.functions.device import device_columns
from eventloom.functions.keys import partition_key, partition_of, route_topic
from eventloom.operators import dead_letters as DL
from eventloom.operators.collapse import replace_latest
from eventloom.operators.contracts import check_contracts
from eventloom.operators.dedup import anti_processed, anti_seen, drop_duplicates
from eventloom.operators.enrich import flatten_enrich
from eventloom.operators.identity import latest_link, link_rows, resolve_identity
from eventloom.operators.privacy import apply_privacy
from eventloom.operators.quality import backlog_gauges, rate_cap
from eventloom.operators.quality import ingest_summary as summary
from eventloom.operators.rollups import (
    daily_partials,
    events_hourly,
    hourly_partials,
    merge_daily,
    merge_hourly,
    sessions_daily,
)
from eventloom.operators.sessions import attach_sessions, open_sessions, session_rows, session_sink_defaults, split_live, visits
from eventloom.operators.validate import reject_record, split_required
from eventloom.plans.finalize import finalize_sessions, read_daily, sweep_sessions, upkeep_daily
from eventloom.plans.hourly import correct_hours, read_hourly, send_hours
from eventloom.plans.ingest import Ingested, classify, ingest
from eventloom.plans.load import load_dead_letters, load_from_stream
from eventloom.plans.replay import replay_dead_letters, run_replay
from eventloom.plans.state import LATEST, IngestState
from eventloom.schemas import DEAD_LETTERS, EVENTS
from eventloom.sources.dead_letters import read_entries
from eventloom.sources.envelopes import explode_envelopes, read_envelopes, reject_envelopes
from eventloom.sources.snapshots import read_snapshot
from eventloom.sources import tables as stored_tables
from eventloom.sources.tables import (
    EVENT_BLOOM,
    EVENT_DAY,
    EVENT_ORDER,
    compact_events,
    event_table_rows,
    expire_days,
    numbered_batch,
    read_events,
    read_sessions,
    retain,
    write_events,
    write_sessions,
)
from eventloom.sources.topics import FolderTopics, ordered_by_user, read_event_stream, write_event_stream
from eventloom.streaming import sinks as S
from eventloom.streaming.batches import dedup_batches, identity_batches, rate_batches
from eventloom.streaming.dedup import dedup_stream
from eventloom.streaming.keyed import identity_keyed, last_versions, sweep_stream
from eventloom.streaming.rollups import hourly_stream
from eventloom.streaming.sessions import sessionize_stream
from eventloom.streaming.settings import streaming_session, timers_by_clock
from eventloom.workspace import scratch_path, write_through

CFG = EngineConfig()
LONG_GAP = EngineConfig(session_timeout_s=6 * 3600)
Query = Callable[[SparkSession, str], DataFrame]

# Fixed instants, so that results do not depend on the day of the run.
NOW = "2024-01-31 00:00:00"
MID_MONTH = "2024-01-15 12:00:00"
DLQ_NOW = "2024-01-20 00:00:00"
DLQ_LATER = "2024-01-20 01:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# Whole numbers that can be missing; as doubles both engines show them alike.
OPTIONAL_NUMBERS = ("click_x", "click_y", "scroll_depth", "stay_duration", "max_scroll_depth")


def plain_columns(df: DataFrame) -> DataFrame:
    """Column types that mean the same on the SQL side: timestamps without zone, days
    as text, optional whole numbers as doubles."""

    def plain(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif field.name in OPTIONAL_NUMBERS:
            column = column.cast("double")
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


# ---------------------------------------------------------------- ingest


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(I.raw_events(spark, sf_dir), I.contracts(spark), I.ENFORCE, at(NOW))


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("seq", "event_id", "event_type", "app_code", "outcome")


def _ingested(spark: SparkSession, sf_dir: str, cfg: EngineConfig = I.ENFORCE):
    return ingest(I.raw_events(spark, sf_dir), I.contracts(spark), cfg, at(NOW))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_classified(spark, sf_dir))


STRICT = I.ENFORCE.with_(require_consent=True, hash_user_id=True, pii_fields=("email",), mask_heuristics=True)


def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, STRICT).metrics()


_INGESTED = ("seq", "event_id", "event_type", "user_id", "anonymous_id", "session_id", "timestamp", "app_code", "properties")


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).events.select(*_INGESTED).withColumnRenamed("timestamp", "ts")


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[list[Ingested], IngestState]:
    """The events before and after an instant in the middle of many visits."""
    raw = I.raw_events(spark, sf_dir)
    state = IngestState(scratch_path(spark, "state"), I.ENFORCE, at(NOW))
    second = F.coalesce(F.col("timestamp") >= F.unix_millis(at(MID_MONTH)), F.lit(False))
    done = []
    for number, part in enumerate((raw.where(~second), raw.where(second))):
        earlier = state.before(spark, number)
        batch = ingest(part, I.contracts(spark), I.ENFORCE, at(NOW), earlier)
        state.add(batch, number)
        done.append(batch)
    return done, state


def ingest_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As in one batch: ids, links and open visits are remembered."""
    (first, second), _ = _two_batches(spark, sf_dir)
    rows = first.events.select(*_INGESTED).unionByName(second.events.select(*_INGESTED))
    return rows.withColumnRenamed("timestamp", "ts")


def identity_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that two batches of ingest left behind."""
    _, state = _two_batches(spark, sf_dir)
    return state.before(spark, LATEST).links.select("anonymous_id", "user_id", "linked_at")


def event_session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored event with its row of the sessions table."""
    path = scratch_path(spark, "joined")
    write_events(_ingested(spark, sf_dir).events, f"{path}/events", at(NOW))
    sweep_sessions(spark, f"{path}/events", f"{path}/sessions", f"{path}/state", CFG, at("2024-03-01 00:00:00"))
    stored = read_sessions(spark, f"{path}/sessions").select("session_id", "page_views", F.lit(True).alias("found"))
    events = read_events(spark, f"{path}/events").select("event_id", F.col("timestamp").alias("ts"), "session_id")
    joined = events.join(stored, "session_id", "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def reject_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, incomplete = split_required(I.raw_events(spark, sf_dir))
    kept = reject_record(incomplete, at(NOW))
    return kept.select("event_id", "event_type", "user_id", "anonymous_id", F.col("timestamp").alias("ts"), "received_at")


def enrich_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and agents that can't be used do not lose the event."""
    raw = I.raw_events(spark, sf_dir)
    odd = F.col("seq") % 4
    broken = raw.withColumns(
        {
            "timestamp": F.when(odd == 0, F.lit(10**18)).when(odd == 1, None).otherwise(F.col("timestamp")),
            "clientTime": F.when(odd == 2, F.lit(-(10**18))).otherwise(F.col("clientTime")),
            "device": F.when(odd == 3, F.col("device").withField("userAgent", F.lit("\u0000???"))).otherwise(F.col("device")),
        }
    )
    flat = flatten_enrich(broken, at(NOW), keep=("seq",))
    return flat.select("seq", F.col("timestamp").alias("ts"), "client_time", "device_type", "os", "browser")


def ingest_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = _ingested(spark, sf_dir).dead
    body = F.from_json("event_json", "anonymous_id string, app_code string, properties string")
    return dead.select(
        "event_id",
        "event_type",
        "user_id",
        "reason",
        "retry_count",
        "failed_at",
        "next_retry_at",
        body["anonymous_id"].alias("anonymous_id"),
        body["app_code"].alias("app_code"),
        body["properties"].alias("properties"),
    )


def envelope_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes written as JSON lines, read back and opened. Some hold no event."""
    raw = I.raw_events(spark, sf_dir)
    event = F.struct(*[c for c in raw.columns if c not in ("app_code", "seq")])
    # envelopes of at most 40 source events; the last digit of the number picks the client
    number = F.floor(F.pmod(F.col("seq"), F.lit(1_000_000_000)) / 40)
    packed = raw.groupBy(number.alias("n")).agg(F.collect_list(event).alias("events"))
    client = F.when(F.col("n") % 3 != 0, F.concat(F.lit("app"), F.col("n") % 3))
    empty = F.col("n") % 10 == 9
    envelopes = packed.select(
        client.alias("clientId"), F.when(empty, F.filter("events", lambda _: F.lit(False))).otherwise(F.col("events")).alias("events")
    )
    path = scratch_path(spark, "envelopes")
    envelopes.write.json(path)
    read = read_envelopes(spark, path)
    opened = explode_envelopes(read, CFG)
    counted = opened.groupBy("app_code").agg(
        F.count("*").alias("events"),
        F.count("eventId").alias("with_id"),
        F.countDistinct("seq").alias("numbers"),
        F.sum("data.scrollDepth").alias("scroll_sum"),
    )
    refused = reject_envelopes(read, CFG).groupBy(F.coalesce("clientId", F.lit(CFG.default_client)).alias("app_code")).agg(
        F.count("*").alias("refused_envelopes")
    )
    return counted.join(refused, "app_code", "left").withColumn(
        "refused_envelopes", F.coalesce("refused_envelopes", F.lit(0))
    )


# ---------------------------------------------------------------- columns


def enrich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_enrich(I.raw_events(spark, sf_dir), at(NOW), keep=("app_code", "seq"))
    stored = event_table_rows(flat.withColumn("properties", F.col("custom")), at(NOW))
    return stored.withColumn("n_exp", F.size("exp_ids")).select(
        "event_id",
        "event_type",
        "user_id",
        "anonymous_id",
        "session_id",
        F.col("timestamp").alias("ts"),
        "client_time",
        "received_at",
        "platform",
        "app_version",
        "sdk_version",
        "page_url",
        "device_type",
        "os",
        "browser",
        "screen_width",
        "screen_height",
        "language",
        "click_x",
        "click_y",
        "scroll_depth",
        "stay_duration",
        "utm_source",
        "utm_medium",
        "utm_campaign",
        "spmb",
        "n_exp",
        "properties",
        "app_code",
        "event_date",
    )


def device_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.all_events(spark, sf_dir).withColumn("agent", F.lower("user_agent"))
    return events.select("seq", *[c.alias(name) for name, c in device_columns(F.col("agent")).items()])


def topic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("k") < 10, "session_start").when(F.col("k") >= 90, "session_end").otherwise(F.col("event_type"))
    return (
        I.behaviour(spark, sf_dir)
        .select(route_topic(marked, CFG).alias("topic"), partition_key(F.col("user_id"), F.col("anonymous_id")).alias("key"))
        .groupBy("topic", "key")
        .agg(F.count("*").alias("n"))
    )


def partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = partition_key(F.col("user_id"), F.col("anonymous_id"), F.col("event_id"))
    return (
        I.behaviour(spark, sf_dir)
        .select(key.alias("key"), partition_of(key, CFG.events_partitions).alias("p"))
        .groupBy("key", "p")
        .agg(F.count("*").alias("n"))
    )


# ---------------------------------------------------------------- contracts, privacy


def validate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_contracts(I.behaviour(spark, sf_dir), I.contracts(spark), I.ENFORCE)
    return checked.select(
        "seq", "app_code", "event_type", F.array_join("violations", "; ").alias("violations"), "contract_outcome"
    )


def contract_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_contracts(I.behaviour(spark, sf_dir), I.contracts(spark), CFG)
    modes = F.array(
        *[
            F.struct(F.lit(mode).alias("mode"), contract_outcome(mode, F.col("violations")).alias("contract_outcome"))
            for mode in ("off", "monitor", "enforce")
        ]
    )
    return (
        checked.select("app_code", F.inline(modes))
        .groupBy("mode", "app_code", "contract_outcome")
        .agg(F.count("*").alias("n"))
    )


def _properties(events: DataFrame) -> DataFrame:
    return events.select(
        "seq",
        "user_id",
        *[
            F.get_json_object("custom", f"$.{name}").alias(alias)
            for name, alias in (("email", "email"), ("phone", "phone"), ("orderId", "order_id"), ("amount", "amount"))
        ],
        "pii_masked",
        "consent_denied",
    )


def privacy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = CFG.with_(hash_user_id=True, pii_fields=("email", "orderId", "amount"))
    return _properties(apply_privacy(I.behaviour(spark, sf_dir), cfg))


def privacy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _properties(apply_privacy(I.behaviour(spark, sf_dir), CFG.with_(mask_heuristics=True)))


def consent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = CFG.with_(require_consent=True, pii_fields=("email", "phone"))
    return _properties(apply_privacy(I.behaviour(spark, sf_dir), cfg))


# ---------------------------------------------------------------- duplicates, identity


def dedup_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_duplicates(I.behaviour(spark, sf_dir), CFG)
    return kept.select("seq", "event_id", F.col("timestamp").alias("ts"))


def anti_seen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.behaviour(spark, sf_dir)
    seen = events.where(F.col("copy") == 0).select("event_id", F.col("timestamp").alias("anchor_ts"))
    later = events.where(F.col("copy") == 1)
    return anti_seen(later, seen, CFG).select("seq", "event_id", F.col("timestamp").alias("ts"))


def identity_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_link(link_rows(I.shared_device(I.all_events(spark, sf_dir))))


def _identity(spark: SparkSession, sf_dir: str, cfg: EngineConfig) -> DataFrame:
    resolved = resolve_identity(I.shared_device(I.all_events(spark, sf_dir)), cfg)
    return resolved.select("seq", "event_id", "user_id", "identity_linked", "identity_resolved")


def identity_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identity(spark, sf_dir, CFG)


def identity_short_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identity(spark, sf_dir, CFG.with_(identity_ttl_days=1))


# ---------------------------------------------------------------- sessions, rollups


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_rows(I.behaviour(spark, sf_dir), CFG)


def sessions_long_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_rows(I.behaviour(spark, sf_dir), LONG_GAP)


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_sessions(I.behaviour(spark, sf_dir), LONG_GAP).select("seq", "event_id", "session_id")


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = I.behaviour(spark, sf_dir).where(F.col("timestamp") <= at(MID_MONTH))
    due, live = split_live(session_rows(so_far, LONG_GAP), LONG_GAP, at(MID_MONTH))
    state = due.select("session_id", F.lit("due").alias("state")).unionByName(
        live.select("session_id", F.lit("live").alias("state"))
    )
    return state


def replace_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.all_events(spark, sf_dir).select(
        "anonymous_id", "event_type", "event_id", "user_id", F.col("timestamp").alias("ts"), "seq", "scroll_depth"
    )
    return replace_latest(rows, ("anonymous_id", "event_type"), ("ts", "seq"))


def _rollup_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.behaviour(spark, sf_dir).withColumns(
        {
            "session_id": F.col("anonymous_id"),
            "spmb": F.col("page_url"),
            "spmd": F.concat_ws("#", "page_url", "event_type"),
        }
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events_hourly(_rollup_input(spark, sf_dir)), "avg_stay_duration")


def rollup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial rows of five batches merged; the same result as in one go."""
    events = _rollup_input(spark, sf_dir)
    parts = events.withColumn("spmd", F.concat_ws("@", "spmd", F.col("src") % 5))
    partial = hourly_partials(parts).withColumn("spmd", F.substring_index("spmd", "@", 1))
    return rounded(merge_hourly(partial), "avg_stay_duration")


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalize_sessions(I.behaviour(spark, sf_dir), LONG_GAP, at("2024-03-01 00:00:00"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sessions_daily(_collapsed(spark, sf_dir)), "avg_duration")


def rollup_merge_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _collapsed(spark, sf_dir)
    batch = F.concat_ws("@", "platform", F.pmod("page_views", F.lit(3)))
    partial = daily_partials(rows.withColumn("platform", batch))
    return rounded(merge_daily(partial.withColumn("platform", F.substring_index("platform", "@", 1))), "avg_duration")


def finalized_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sweeps over a stored table that grows in between. The second reads only what
    is new, so it needs the measures that the first kept of open sessions."""
    events = I.behaviour(spark, sf_dir)
    path = scratch_path(spark, "sweeps")
    tables = f"{path}/events", f"{path}/sessions", f"{path}/state"
    stored = None
    for part, until in ((events.where(F.col("timestamp") <= at(MID_MONTH)), MID_MONTH), (events.where(F.col("timestamp") > at(MID_MONTH)), NOW)):
        spans = write_through(visits(part, LONG_GAP, stored=stored), "visits")
        write_events(attach_sessions(part, LONG_GAP, spans=spans), tables[0], at(NOW))
        stored = write_through(open_sessions(spans, at(until)), "open")
        sweep_sessions(spark, *tables, LONG_GAP, at(until))
    return read_sessions(spark, tables[1])


SWEEPS = ("2024-03-01 00:00:00", "2024-03-02 00:00:00", "2024-03-03 00:00:00")


def _sweeps(spark: SparkSession, sf_dir: str, path: str, after: Callable[[], object] = lambda: None) -> None:
    """Three sweeps, each after a third of the events has come. Sessions have names, a
    visitor and five days, so late thirds prolong finished sessions at either end."""
    cfg = CFG.with_(session_keep_s=90 * 86_400)
    period = F.floor(F.unix_millis("timestamp") / F.lit(432_000_000))
    events = I.behaviour(spark, sf_dir).withColumn("session_id", F.concat_ws("-", "anonymous_id", period))
    for number, moment in enumerate(SWEEPS):
        write_events(events.where(F.col("src") % 3 == number), f"{path}/events", at(NOW), numbered_batch("part", number))
        sweep_sessions(spark, f"{path}/events", f"{path}/sessions", f"{path}/state", cfg, at(moment))
        after()


def sessions_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a week after sweeps that moved sessions to earlier days; only the
    folders of these days are opened."""
    path = scratch_path(spark, "sweeps")
    _sweeps(spark, sf_dir, path)
    return read_sessions(spark, f"{path}/sessions", since="2024-01-08 01:00:00", until="2024-01-15 00:00:00")


def sessions_daily_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rollup kept up over three sweeps: the same as one computation."""
    path = scratch_path(spark, "upkeep")
    _sweeps(spark, sf_dir, path, lambda: upkeep_daily(spark, f"{path}/sessions", f"{path}/state", f"{path}/daily"))
    return rounded(read_daily(spark, f"{path}/daily"), "avg_duration")


# ---------------------------------------------------------------- quality


def rate_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_cap(I.requests(spark, sf_dir), CFG.with_(max_requests_per_second=3)).select("seq", "over_limit")


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = DL.store(spark.createDataFrame([], DEAD_LETTERS), I.dead_letter_entries(spark, sf_dir))
    live = session_rows(I.behaviour(spark, sf_dir).where(F.col("timestamp") <= at(MID_MONTH)), LONG_GAP)
    gauges = backlog_gauges(entries, live, _classified(spark, sf_dir), LONG_GAP, at(MID_MONTH))
    return rounded(gauges, "value")


# ---------------------------------------------------------------- dead letters


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = I.dead_letter_entries(spark, sf_dir)
    resent = F.col("retry_count") == 0
    return DL.store(new.where(~resent), new.where(resent))


_ENTRY = ("event_id", "reason", "failed_at", "retry_count", "next_retry_at")


def dlq_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select(*_ENTRY, "updated_at", F.get_json_object("event_json", "$.page_url").alias("page_url"))


def dlq_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DL.alive(_entries(spark, sf_dir), CFG, at(DLQ_NOW)).select(*_ENTRY)


def dlq_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DL.fetch_due(DL.alive(_entries(spark, sf_dir), CFG, at(DLQ_NOW)), CFG, at(DLQ_NOW)).select(*_ENTRY)


def dlq_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead, _ = DL.split_exhausted(DL.alive(_entries(spark, sf_dir), CFG, at(DLQ_NOW)), CFG, at(DLQ_NOW))
    return dead.select(*_ENTRY)


def dlq_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every due entry replayed; those with an even retry count succeed."""
    entries = _entries(spark, sf_dir)
    due = DL.due(entries, CFG, at(DLQ_NOW))
    outcomes = due.select(
        "reason", DL.entry_key().alias("entry_key"), (F.col("retry_count") % 2 == 0).alias("success")
    )
    return DL.update_retries(entries, outcomes, CFG.with_(dlq_jitter=0.0), at(DLQ_NOW)).select(*_ENTRY, "updated_at")


def _accepted_table(spark: SparkSession, sf_dir: str) -> str:
    """An events table that holds a part of the events."""
    path = scratch_path(spark, "accepted")
    write_events(I.all_events(spark, sf_dir).where(F.col("k") < 50), path, at(NOW))
    return path


def dlq_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, _accepted_table(spark, sf_dir))
    return anti_processed(_entries(spark, sf_dir), events).select("reason", "event_id", "processed")


def dlq_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.behaviour(spark, sf_dir).withColumns({"properties": F.col("custom"), "received_at": F.col("timestamp")})
    sent = DL.annotate(events, "collection_failed", at(NOW))
    return sent.select(
        "seq",
        F.get_json_object("properties", "$._dlq_reason").alias("dlq_reason"),
        F.get_json_object("properties", "$._dlq_original_timestamp").alias("dlq_original_timestamp"),
        F.get_json_object("properties", "$.email").alias("email"),
        "received_at",
    )


def _replay(spark: SparkSession, sf_dir: str):
    table = read_events(spark, _accepted_table(spark, sf_dir))
    entries = write_through(_entries(spark, sf_dir), "entries")
    cfg = I.ENFORCE.with_(dlq_jitter=0.0)
    return replay_dead_letters(entries, table, I.contracts(spark), cfg, at(DLQ_NOW))


def dlq_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir).outcomes.select("reason", "event_id", "retry_count", "replay_outcome")


def dlq_after_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir).waiting.select(*_ENTRY, "updated_at")


def dlq_replay_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused events replayed when contracts are only monitored: they pass consent and
    masking, get a user and a session, and nothing that lacked a time gets one."""
    dead = write_through(_ingested(spark, sf_dir, STRICT).dead, "dead")
    entries = DL.store(spark.createDataFrame([], DEAD_LETTERS), dead)
    cfg = STRICT.with_(contract_mode="monitor")
    nothing = spark.createDataFrame([], EVENTS)
    parts = []
    for reason in ("schema_violation", "validation_failed"):
        run = replay_dead_letters(entries.where(F.col("reason") == reason), nothing, I.contracts(spark), cfg, at(NOW))
        parts.append(run.events)
    return parts[0].unionByName(parts[1]).select(
        "event_id",
        "event_type",
        "user_id",
        F.get_json_object("properties", "$.email").alias("email"),
        F.get_json_object("properties", "$.phone").alias("phone"),
        F.col("timestamp").alias("ts"),
        F.col("session_id").startswith("sess_").alias("has_session"),
    )


def dlq_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries added by two batches, two replays an hour apart, dead ones that run out."""
    path = scratch_path(spark, "lifecycle")
    cfg = I.ENFORCE.with_(dlq_jitter=0.0, dlq_dead_ttl_s=15 * 86_400)
    new = I.dead_letter_entries(spark, sf_dir)
    sink = S.entries_sink(f"{path}/dlq")
    sink(new.where("retry_count > 0"), 0)
    sink(new.where("retry_count = 0"), 1)
    table = _accepted_table(spark, sf_dir)
    for moment in (DLQ_NOW, DLQ_LATER):
        run_replay(spark, f"{path}/dlq", f"{path}/dead", table, I.contracts(spark), cfg, at(moment))
    columns = ("event_id", "reason", "failed_at", "retry_count", "next_retry_at")
    waiting = read_entries(spark, f"{path}/dlq")[0].select(F.lit("waiting").alias("state"), *columns)
    gone = read_snapshot(spark, f"{path}/dead", DEAD_LETTERS).select(F.lit("dead").alias("state"), *columns)
    written = read_events(spark, table).select(
        F.lit("event").alias("state"), "event_id", "event_type", "timestamp", F.lit(0), F.lit(None).cast("timestamp")
    )
    return waiting.unionByName(gone).union(written)


# ---------------------------------------------------------------- tables


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retain(I.all_events(spark, sf_dir), "timestamp", 10 * 86_400, at(NOW))
    return kept.select("seq", "event_id", F.col("timestamp").alias("ts"))


def layout_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events")
    write_events(I.all_events(spark, sf_dir).withColumn("properties", F.col("custom")), path, at(NOW))
    return read_events(spark, path).select(
        "event_id",
        "event_type",
        "user_id",
        F.col("timestamp").alias("ts"),
        "client_time",
        "received_at",
        "page_url",
        "screen_width",
        "scroll_depth",
        "stay_duration",
        "properties",
        "app_code",
    )


def layout_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read of a time range: only its day folders are opened."""
    path = scratch_path(spark, "events")
    write_events(I.all_events(spark, sf_dir), path, at(NOW))
    part = read_events(spark, path, since="2024-01-10 06:00:00", until="2024-01-12 18:00:00")
    return part.select("event_id", F.col("timestamp").alias("ts"))


def sessions_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sessions")
    write_sessions(session_rows(I.behaviour(spark, sf_dir), LONG_GAP), path)
    return read_sessions(spark, path)


def evolve_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the days were written before app_code existed."""
    rows = event_table_rows(I.all_events(spark, sf_dir), at(NOW))
    path = scratch_path(spark, "evolving")
    early = F.col("timestamp") < at(MID_MONTH)
    old = rows.where(early).drop("app_code").withColumn("batch", F.lit("old"))
    old.hint("rebalance", EVENT_DAY).write.partitionBy(EVENT_DAY, "batch").parquet(path)
    write_events(rows.where(~early), path, at(NOW))
    return read_events(spark, path).select("event_id", F.col("timestamp").alias("ts"), "app_code")


def skip_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column that is looked up by value, whether all files can be skipped by it."""
    path = scratch_path(spark, "indexed")
    write_events(I.all_events(spark, sf_dir), path, at(NOW))
    found = stored_tables.skip_indexes(spark, path).where(F.col("column").isin(*EVENT_BLOOM))
    return found.select(
        "column", (F.col("bloom") | F.col("dictionary")).alias("skips"), (F.col("bloom") & (F.col("column") == "event_id")).alias("id_filter")
    )


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compacted table: rows per day, and rows of a file that are out of order."""
    path = scratch_path(spark, "compacted")
    events = I.all_events(spark, sf_dir)
    for number in range(2):
        write_events(events.where(F.col("copy") == number), path, at(NOW), f"part-{number}")
    compact_events(spark, path, "2024-01-01", "2024-12-31", 4)
    stored = spark.read.schema(EVENTS).parquet(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), *EVENT_ORDER
    )
    before = W.partitionBy("file").orderBy("place")
    order = F.struct(*EVENT_ORDER)
    checked = stored.withColumn("off", F.coalesce(order < F.lag(order).over(before), F.lit(False)))
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    return checked.groupBy(day).agg(F.count("*").alias("n"), F.count_if("off").alias("out_of_order"))


def user_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: events, partitions they are in, and events out of order."""
    laid_out = ordered_by_user(I.behaviour(spark, sf_dir), 6).select(
        F.coalesce("user_id", "anonymous_id").alias("key"),
        "timestamp",
        F.spark_partition_id().alias("p"),
        F.monotonically_increasing_id().alias("place"),
    )
    day = F.date_format("timestamp", "yyyy-MM-dd")
    rows = write_through(laid_out, "ordered").withColumn("day", day)
    before = W.partitionBy("key", "day").orderBy("place")
    off = F.coalesce(F.col("timestamp") < F.lag("timestamp").over(before), F.lit(False))
    return rows.withColumn("off", off).groupBy("key", "day").agg(
        F.count("*").alias("n"), F.countDistinct("p").alias("partitions"), F.count_if("off").alias("out_of_order")
    )


# ---------------------------------------------------------------- delivery


def _failing(batch: DataFrame, batch_id: int) -> None:
    raise OSError("down")


def _delivered(spark: SparkSession, path: str, table: str = "table") -> DataFrame:
    """(place, event_id) of what came to a topic, a table and the dead letters."""
    names = {"topic": f"{path}/topics", "table": f"{path}/{table}", "dead": f"{path}/dlq"}
    parts = []
    topic = spark.read.schema("key string, value string, topic string, batch string").json(names["topic"])
    topic_place = F.when(F.col("topic") == CFG.dead_letter_topic, "dead_topic").otherwise("topic")
    parts.append(topic.select(topic_place.alias("place"), F.get_json_object("value", "$.event_id").alias("event_id")))
    parts.append(read_events(spark, names["table"]).select(F.lit("table").alias("place"), "event_id"))
    parts.append(read_entries(spark, names["dead"])[0].select(F.lit("dead").alias("place"), "event_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("place", "event_id").agg(F.count("*").alias("n"))


def collect_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all is well; the topic fails; topic and table fail."""
    path = scratch_path(spark, "fallback")
    topics = FolderTopics(f"{path}/topics")
    rows = event_table_rows(I.behaviour(spark, sf_dir), at(NOW)).drop(EVENT_DAY)
    batch_of = F.substr(F.col("event_id"), F.lit(5)).cast("long") % 3
    topic, table = S.topic_sink(topics, CFG), S.events_table_sink(f"{path}/table", at(NOW))
    dead = S.dead_letter_sink(f"{path}/dlq", "collection_failed", at(NOW))
    for number, sinks in enumerate(((topic, table), (_failing, table), (_failing, _failing))):
        S.collect_with_fallback(CFG, *sinks, dead)(rows.where(batch_of == number), number)
    return _delivered(spark, path)


def consume_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, of which one can't be written; the first is delivered twice."""
    path = scratch_path(spark, "consume")
    topics = FolderTopics(f"{path}/topics")
    rows = event_table_rows(I.behaviour(spark, sf_dir), at(NOW)).drop(EVENT_DAY)
    batch_of = F.substr(F.col("event_id"), F.lit(5)).cast("long") % 2
    dead = S.dead_letter_topic_sink(topics, "table_write_failed", CFG)
    well = S.failure_to_dead_letters(S.events_table_sink(f"{path}/table", at(NOW)), dead)
    for number, deliver in ((0, well), (0, well), (1, S.failure_to_dead_letters(_failing, dead))):
        deliver(rows.where(batch_of == number), number)
    return _delivered(spark, path)


def repeated_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sink gets two batches, the second one twice."""
    path = scratch_path(spark, "repeated")
    topics = FolderTopics(f"{path}/topics")
    rows = event_table_rows(I.behaviour(spark, sf_dir), at(NOW)).drop(EVENT_DAY)
    batch_of = F.substr(F.col("event_id"), F.lit(5)).cast("long") % 2
    sinks = (
        S.topic_sink(topics, CFG),
        S.dead_letter_topic_sink(topics, "why", CFG),
        S.events_table_sink(f"{path}/table", at(NOW)),
        S.dead_letter_sink(f"{path}/dlq", "why", at(NOW)),
    )
    for number in (0, 1, 1):
        for sink in sinks:
            sink(rows.where(batch_of == number), number)
    return _delivered(spark, path)


# ---------------------------------------------------------------- streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    streaming_session(spark)
    events = I.derive(I.stream_source(spark, sf_dir))
    return events.where(F.col("event_type") != "$identify")


def _run(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    return S.to_parquet(rows, f"{path}/rows", f"{path}/checkpoint")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, dedup_stream(_stream(spark, sf_dir), CFG), "dedup").select("event_id", "event_type")


def _run_batches(spark: SparkSession, rows: DataFrame, make, name: str, schema: str) -> DataFrame:
    """A stream through a micro-batch operator: ``make(state, deliver)``."""
    path = scratch_path(spark, name)
    S.run_available(rows, make(f"{path}/state", S.batches_to_parquet(f"{path}/rows")), f"{path}/checkpoint")
    return spark.read.schema(schema).parquet(f"{path}/rows").drop("batch")


def stream_dedup_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).select("event_id", "timestamp", "seq")
    schema = "event_id string, timestamp timestamp, seq long"
    kept = _run_batches(spark, events, lambda state, out: dedup_batches(state, out, CFG, at(NOW)), "anchored", schema)
    return kept.select("seq", "event_id", F.col("timestamp").alias("ts"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sessionize_stream(_stream(spark, sf_dir), CFG), "sessions")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).withColumns(
        {
            "session_id": F.col("anonymous_id"),
            "spmb": F.col("page_url"),
            "spmd": F.concat_ws("#", "page_url", "event_type"),
        }
    )
    return rounded(merge_hourly(_run(spark, hourly_stream(events, CFG), "hourly")), "avg_stay_duration")


def stream_hourly_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three triggers over a topic: first events of the second half of the month, then all
    others of it, then the first half, which the stream is past. Late hours are corrected
    from the events table. The same as the batch rollup of the hours that have ended."""
    streaming_session(spark)
    path = scratch_path(spark, "late-hours")
    topics = FolderTopics(f"{path}/topics")
    rows = event_table_rows(_rollup_input(spark, sf_dir), at(NOW)).drop(EVENT_DAY)
    late, odd = F.col("timestamp") < at(MID_MONTH), F.crc32("event_id") % 2 == 1
    for number, part in enumerate((~late & odd, ~late & ~odd, late)):
        write_event_stream(rows.where(part), topics, CFG)
        write_events(rows.where(part), f"{path}/table", at(NOW), numbered_batch("part", number))
        send_hours(read_event_stream(spark, topics, CFG).where("unreadable is null"), f"{path}/hourly", f"{path}/checkpoint", CFG)
        correct_hours(spark, f"{path}/table", f"{path}/hourly")
    return rounded(read_hourly(spark, f"{path}/hourly"), "avg_stay_duration")


def stream_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    streaming_session(spark)
    events = I.shared_device(I.derive(I.stream_source(spark, sf_dir))).select(
        "seq", "event_id", "user_id", "anonymous_id", "timestamp"
    )
    schema = "seq long, event_id string, user_id string, identity_linked boolean, identity_resolved boolean"
    return _run_batches(spark, events, lambda state, out: identity_batches(state, out, CFG, at(NOW)), "identity", schema)


def _topic_in_parts(spark: SparkSession, rows: DataFrame, path: str, parts: int) -> DataFrame:
    """The rows in so many files, dealt by event id, as a stream of one file per trigger."""
    dealt = rows.repartitionByRange(parts, F.pmod(F.crc32("event_id"), F.lit(parts)))
    dealt.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_identity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triggers: all events with both ids, then all others, each of which is late for
    most of its visitor's links."""
    streaming_session(spark)
    path = scratch_path(spark, "identity-state")
    events = I.shared_device(I.all_events(spark, sf_dir)).select("seq", "event_id", "user_id", "anonymous_id", "timestamp")
    both = F.col("user_id").isNotNull()
    for part in (both, ~both):
        events.where(part).write.mode("append").parquet(f"{path}/topic")
        rows = spark.readStream.schema(events.schema).parquet(f"{path}/topic")
        with timers_by_clock(spark):
            resolved = S.to_parquet(identity_keyed(rows, CFG), f"{path}/rows", f"{path}/checkpoint")
    return resolved.select("seq", "event_id", "user_id", "identity_linked", "identity_resolved")


def stream_session_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four triggers with events of the whole month each, so sessions that were sent grow
    at both ends and join. What stands in the end is what a sweep at NOW finds."""
    streaming_session(spark)
    path = scratch_path(spark, "session-state")
    rows = _topic_in_parts(spark, I.behaviour(spark, sf_dir), f"{path}/topic", 4)
    with timers_by_clock(spark):
        sent = S.to_parquet(sweep_stream(rows, LONG_GAP), f"{path}/rows", f"{path}/checkpoint")
    return session_sink_defaults(split_live(last_versions(sent), LONG_GAP, at(NOW))[0])


def stream_rate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).select(
        "app_code",
        F.date_trunc("hour", "timestamp").alias("timestamp"),
        F.lpad(F.col("seq").cast("string"), 12, "0").alias("event_id"),
        "seq",
    )
    cfg = CFG.with_(max_requests_per_second=3)
    return _run_batches(spark, events, lambda state, out: rate_batches(state, out, cfg), "rate", "seq long, over_limit boolean")


def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published to a topic, loaded from it into the events table."""
    path = scratch_path(spark, "load")
    topics = FolderTopics(f"{path}/topics")
    rows = event_table_rows(I.behaviour(spark, sf_dir), at(NOW)).drop(EVENT_DAY)
    write_event_stream(rows, topics, CFG)
    load_from_stream(spark, topics, f"{path}/table", f"{path}/checkpoint", CFG, f"{path}/dlq", now=at(NOW))
    return read_events(spark, f"{path}/table").select("event_id", "event_type", F.col("timestamp").alias("ts"))


FAR = "2034-01-01 00:00:00"


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of the load: the second half of the events; then the first half, all of
    it late, and an event dated ten years ahead; then the first half again, events
    without an id, and broken records. Loaded events and unreadable records."""
    path = scratch_path(spark, "late")
    topics = FolderTopics(f"{path}/topics")
    events = I.behaviour(spark, sf_dir)
    rows = event_table_rows(events, at(NOW)).drop(EVENT_DAY)
    late = F.col("timestamp") < at(MID_MONTH)
    ahead = spark.range(1).select(
        F.lit("far").alias("event_id"), F.lit("page_view").alias("event_type"), F.lit("a").alias("anonymous_id"), at(FAR).alias("timestamp")
    )
    nameless = event_table_rows(events.where("k = 7"), at(NOW)).drop(EVENT_DAY).withColumn("event_id", F.lit(""))

    def load() -> None:
        load_from_stream(
            spark, topics, f"{path}/table", f"{path}/checkpoint", CFG, dead=f"{path}/dlq", now=at(NOW)
        )

    write_event_stream(rows.where(~late), topics, CFG)
    load()
    write_event_stream(rows.where(late), topics, CFG)
    write_event_stream(event_table_rows(ahead, at(NOW)).drop(EVENT_DAY), topics, CFG)
    load()
    write_event_stream(rows.where(late), topics, CFG)
    write_event_stream(nameless, topics, CFG)
    broken = events.where("k = 8").select(
        F.lit(CFG.events_topic).alias("topic"), F.col("event_id").alias("key"), F.concat(F.lit("{broken "), F.col("seq")).alias("value")
    )
    topics.write(broken, "broken")
    load()
    loaded = read_events(spark, f"{path}/table").select("event_id", "event_type", F.col("timestamp").alias("ts"))
    refused = read_entries(spark, f"{path}/dlq")[0].select(
        F.get_json_object("event_json", "$.value").alias("event_id"), F.col("reason").alias("event_type"), F.lit(None).cast("timestamp").alias("ts")
    )
    return loaded.unionByName(refused)


def _published(spark: SparkSession, sf_dir: str, path: str) -> tuple[FolderTopics, DataFrame]:
    """A topic with all events in it, and the events."""
    topics = FolderTopics(f"{path}/topics")
    rows = event_table_rows(I.behaviour(spark, sf_dir), at(NOW)).drop(EVENT_DAY)
    write_event_stream(rows, topics, CFG)
    return topics, rows


def consume_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events sent three times: the first time the table can't be written, after part
    of the batch is in it; the second time all is well; the third is a repetition. What is
    in the table and in the dead-letter topic."""
    path = scratch_path(spark, "retry")
    topics, rows = _published(spark, sf_dir, path)
    half = S.events_table_sink(f"{path}/table", at(NOW))

    def breaks_off(batch: DataFrame, batch_id: int) -> None:
        half(batch.where(F.col("timestamp") < at(MID_MONTH)), batch_id)
        raise OSError("down")

    for number, write in enumerate((breaks_off, None, None)):
        if number:
            write_event_stream(rows, topics, CFG)
        load_from_stream(spark, topics, f"{path}/table", f"{path}/checkpoint", CFG, f"{path}/dlq", at(NOW), write)
    # the events topic holds every attempt to send
    return _delivered(spark, path).where("place <> 'topic'")


def dlq_topic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that could not be written go to the dead-letter topic, from there to the
    dead letters, and are replayed into the table; events without an id as well."""
    path = scratch_path(spark, "roundtrip")
    topics, rows = _published(spark, sf_dir, path)
    nameless = rows.where("event_type = 'purchase'").withColumn("event_id", F.lit(""))
    write_event_stream(nameless, topics, CFG)
    load_from_stream(spark, topics, f"{path}/table", f"{path}/checkpoint", CFG, f"{path}/dlq", at(NOW), _failing)
    load_dead_letters(spark, topics, f"{path}/dlq", f"{path}/dead-checkpoint", CFG, at(NOW))
    cfg = CFG.with_(contract_mode="off", dlq_batch_size=2**31 - 1)
    run_replay(spark, f"{path}/dlq", f"{path}/dead", f"{path}/table", I.contracts(spark), cfg, at(NOW))
    written = read_events(spark, f"{path}/table").select(F.lit("event").alias("state"), "event_id", "event_type")
    # a replay refuses an event without an id: it waits, each for itself
    waiting = read_entries(spark, f"{path}/dlq")[0].select(F.lit("waiting").alias("state"), "event_id", "event_type")
    return written.unionByName(waiting)


OLDEST_DAY = "2024-01-10"


def stream_then_replay_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table written by a stream, by a replay, and by neither: old days expire."""
    path = scratch_path(spark, "layout")
    topics = FolderTopics(f"{path}/topics")
    events = I.behaviour(spark, sf_dir)
    write_event_stream(event_table_rows(events, at(NOW)).drop(EVENT_DAY), topics, CFG)
    load_from_stream(spark, topics, f"{path}/table", f"{path}/checkpoint", CFG, f"{path}/dlq", now=at(NOW))
    lost = events.where("event_type = 'purchase'").withColumn("event_id", F.concat(F.lit("lost_"), "event_id"))
    payload = ("event_id", "event_type", "user_id", "anonymous_id", "app_code", "timestamp")
    entries = DL.dead_letters(lost, F.lit("collection_failed"), F.col("timestamp"), payload)
    S.entries_sink(f"{path}/dlq")(entries, 0)
    cfg = CFG.with_(contract_mode="off", dlq_ttl_s=90 * 86_400)
    run_replay(spark, f"{path}/dlq", f"{path}/dead", f"{path}/table", I.contracts(spark), cfg, at(NOW))
    expire_days(spark, f"{path}/table", EVENT_DAY, OLDEST_DAY)
    return read_events(spark, f"{path}/table").select("event_id", F.col("timestamp").alias("ts"))


QUERIES: dict[str, Query] = {
    "ingest_outcomes": ingest_outcomes,
    "ingest_summary": ingest_summary,
    "ingest_metrics": ingest_metrics,
    "ingest_events": ingest_events,
    "ingest_two_batches": ingest_two_batches,
    "identity_store": identity_store,
    "event_session_join": event_session_join,
    "ingest_dead_letters": ingest_dead_letters,
    "reject_records": reject_records,
    "enrich_fallback": enrich_fallback,
    "envelope_events": envelope_events,
    "enrich_events": enrich_events,
    "device_parse": device_parse,
    "topic_routing": topic_routing,
    "partition_key": partition_keys,
    "validate_contract": validate_contract,
    "contract_outcomes": contract_outcomes,
    "privacy_hash": privacy_hash,
    "privacy_mask": privacy_mask,
    "consent_gate": consent_gate,
    "dedup_anchored": dedup_anchored,
    "anti_seen": anti_seen_events,
    "identity_latest": identity_latest,
    "identity_asof": identity_asof,
    "identity_short_ttl": identity_short_ttl,
    "sessions": sessions,
    "sessions_long_gap": sessions_long_gap,
    "session_events": session_events,
    "live_sessions": live_sessions,
    "finalized_sessions": finalized_sessions,
    "sessions_day_range": sessions_day_range,
    "sessions_daily_upkeep": sessions_daily_upkeep,
    "replace_latest": replace_latest_rows,
    "events_hourly": hourly,
    "rollup_merge": rollup_merge,
    "sessions_daily": daily,
    "rollup_merge_daily": rollup_merge_daily,
    "rate_cap": rate_capped,
    "backlog_gauges": backlog,
    "dlq_store": dlq_store,
    "dlq_prune": dlq_prune,
    "dlq_fetch": dlq_fetch,
    "dlq_dead": dlq_dead,
    "dlq_update": dlq_update,
    "dlq_processed": dlq_processed,
    "dlq_annotate": dlq_annotate,
    "dlq_replay": dlq_replay,
    "dlq_after_replay": dlq_after_replay,
    "dlq_replay_private": dlq_replay_private,
    "dlq_lifecycle": dlq_lifecycle,
    "retention": retention,
    "layout_roundtrip": layout_roundtrip,
    "layout_day_range": layout_day_range,
    "sessions_roundtrip": sessions_roundtrip,
    "evolve_schema": evolve_schema,
    "skip_indexes": skip_indexes,
    "cluster_order": cluster_order,
    "user_order": user_order,
    "collect_fallback": collect_fallback,
    "consume_failure": consume_failure,
    "repeated_delivery": repeated_delivery,
    "stream_dedup": stream_dedup,
    "stream_dedup_anchored": stream_dedup_anchored,
    "stream_sessions": stream_sessions,
    "stream_hourly": stream_hourly,
    "stream_hourly_late": stream_hourly_late,
    "stream_identity": stream_identity,
    "stream_identity_state": stream_identity_state,
    "stream_session_sweep": stream_session_sweep,
    "stream_rate_cap": stream_rate_cap,
    "stream_load": stream_load,
    "stream_late": stream_late,
    "stream_then_replay_layout": stream_then_replay_layout,
    "consume_retry": consume_retry,
    "dlq_topic_roundtrip": dlq_topic_roundtrip,
}


def catalog() -> dict[str, Query]:
    def prepared(query: Query) -> Query:
        return lambda spark, sf_dir: plain_columns(query(spark, sf_dir))

    return {name: prepared(query) for name, query in QUERIES.items()}
