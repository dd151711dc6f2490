"""Dead letters, quality, sources, sinks and whole jobs."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.catalog.queries import catalog
from eventloom.config import EngineConfig
from eventloom.operators import dead_letters as DL
from eventloom.operators.dedup import drop_duplicates
from eventloom.operators.identity import resolve_identity
from eventloom.operators.quality import observe_metrics, rate_cap
from eventloom.operators.skew import lookup_join
from eventloom.plans.ingest import Earlier, event_table, ingest
from eventloom.plans.load import UNREADABLE, ingest_batches, load_dead_letters, load_from_stream
from eventloom.plans.finalize import finalize_sessions, refresh_daily, refresh_hourly, sweep_sessions, swept_batches
from eventloom.plans.hourly import correct_hours, read_hourly, send_hours
from eventloom.plans.replay import replay_dead_letters, run_replay
from eventloom.schemas import DEAD_LETTERS, EVENTS, RAW_EVENT
from eventloom.sources.contracts import parse_contracts
from eventloom.sources.envelopes import explode_envelopes, read_envelopes, reject_envelopes, stream_envelopes
from eventloom.sources.dead_letters import add_entries, read_entries
from eventloom.sources.snapshots import newest_version, read_snapshot, write_snapshot
from eventloom.sources.state import FOLD_EVERY, BatchState, finished
from eventloom.sources.tables import (
    BatchNames,
    batches_of,
    compact_events,
    expire_days,
    event_table_rows,
    finish_compaction,
    fold_small_batches,
    numbered_batch,
    read_events,
    read_sessions,
    write_events,
    write_sessions,
)
from eventloom.sources.topics import (
    FolderTopics,
    ordered_by_user,
    parse_records,
    read_event_stream,
    split_unreadable,
    to_records,
    write_event_stream,
)
from eventloom.streaming import sinks as S
from eventloom.streaming.settings import streaming_session
from eventloom.workspace import clear_scratch, dropping_scratch, prepare_session, write_through

CFG = EngineConfig()


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def ts(text):
    return F.lit(text).cast("timestamp")


def contracts(spark, text='{"appId":"app","version":1,"events":{"page_view":{"fields":[]},"click":{"fields":[{"name":"x","type":"number","required":true}]}}}'):
    return parse_contracts(spark.createDataFrame([("app", text)], "app_code string, contract_json string"))


def raw(spark, *events):
    lines = spark.createDataFrame([(json.dumps(e), i) for i, e in enumerate(events)], "t string, seq long")
    return lines.select(F.from_json("t", RAW_EVENT).alias("e"), F.lit("app").alias("app_code"), "seq").select("e.*", "app_code", "seq")


def page(event_id, ms=1_700_000_000_000, **more):
    return {"eventId": event_id, "eventType": "page_view", "anonymousId": "anon1", "timestamp": ms, **more}


# ------------------------------------------------------------------ ingest


def outcomes(done):
    return {r.seq: r.outcome for r in done.classified.collect()}


def test_outcomes_in_order(spark):
    prepare_session(spark)
    cfg = CFG.with_(contract_mode="enforce")
    done = ingest(
        raw(
            spark,
            page("e1"),
            page("e1", 1_700_000_000_500),
            {},
            {"eventId": "i1", "eventType": "$identify", "anonymousId": "anon1", "userId": "user1", "timestamp": 1_700_000_001_000},
            {"eventId": "i2", "eventType": "$identify", "anonymousId": "anon1", "timestamp": 1},
            {"eventId": "e2", "eventType": "click", "timestamp": 1_700_000_000_000, "data": {"custom": {"x": "1"}}},
            {"eventId": "e2", "eventType": "click", "timestamp": 1_700_000_000_900, "data": {"custom": {"x": 1}}},
            page("e3", 1_700_000_002_000),
        ),
        contracts(spark),
        cfg,
        now(),
    )
    assert outcomes(done) == {
        0: "accepted", 1: "duplicate", 2: "validation_failed", 3: "identified", 4: "identify_rejected",
        5: "schema_violation", 6: "accepted", 7: "accepted",
    }
    events = {r.event_id: r for r in event_table(done).collect()}
    assert sorted(events) == ["e1", "e2", "e3"]
    assert (events["e1"].user_id, events["e3"].user_id) == ("", "user1")
    assert events["e1"].session_id == events["e3"].session_id != events["e2"].session_id
    (summary,) = done.summary().collect()
    assert (summary.accepted, summary.duplicate, summary.rejected, summary.dead_lettered) == (4, 1, 3, 2)
    metrics = done.metrics().first()
    assert (metrics.accepted, metrics.schema_violation, metrics.identity_linked, metrics.identity_resolved) == (4, 1, 1, 1)
    dead = {r.reason: json.loads(r.event_json) for r in done.dead.collect()}
    assert dead["schema_violation"]["event_id"] == "e2" and sorted(dead) == ["schema_violation", "validation_failed"]


def test_privacy_comes_before_linking(spark):
    cfg = CFG.with_(require_consent=True, hash_user_id=True)
    done = ingest(
        raw(
            spark,
            page("e1", userId="user1", consent=False),
            page("e2", 1_700_000_001_000),
            page("e3", 1_700_000_002_000, userId="user1", consent=True),
            page("e4", 1_700_000_003_000),
            page("e5", 1_700_000_004_000, consent=False),
        ),
        contracts(spark),
        cfg,
        now(),
    )
    users = {r.event_id: r.user_id for r in done.events.collect()}
    assert users["e1"] is None and users["e2"] is None and users["e5"] is None
    assert users["e3"].startswith("h:") and users["e4"] == users["e3"]


def test_seen_ids_and_stored_links(spark):
    prepare_session(spark)
    seen = spark.range(1).select(F.lit("e1").alias("event_id"), F.timestamp_millis(F.lit(1_700_000_000_000)).alias("anchor_ts"))
    links = spark.range(1).select(F.lit("anon1").alias("anonymous_id"), F.lit("u7").alias("user_id"), F.timestamp_millis(F.lit(1_699_999_000_000)).alias("linked_at"))
    done = ingest(
        raw(spark, page("e1", 1_700_000_100_000), page("e1", 1_700_000_300_000), page("e1", 1_700_000_310_000), page("e2")),
        contracts(spark), CFG, now(), Earlier(seen, links),
    )
    assert outcomes(done) == {0: "duplicate", 1: "accepted", 2: "duplicate", 3: "accepted"}
    assert {r.user_id for r in done.events.collect()} == {"u7"}


def test_metrics_can_be_observed(spark):
    done = ingest(raw(spark, page("e1"), page("e1"), {}), contracts(spark), CFG, now())
    flagged = done.classified.withColumns({"identity_linked": F.lit(False), "identity_resolved": F.lit(False)})
    observed, observation = observe_metrics(flagged)
    observed.write.format("noop").mode("overwrite").save()
    assert (observation.get["accepted"], observation.get["duplicate"], observation.get["rejected"]) == (1, 1, 1)


# ------------------------------------------------------------------ dead letters


def entries(spark, *rows):
    """(event_id, reason, failed, retries, next, updated, json)"""
    df = spark.createDataFrame(list(rows), "event_id string, reason string, f string, retry_count int, n string, u string, event_json string")
    return df.select(
        "event_id", F.lit("page_view").alias("event_type"), F.lit(None).cast("string").alias("user_id"), "event_json", "reason",
        F.col("f").cast("timestamp").alias("failed_at"), "retry_count", F.col("n").cast("timestamp").alias("next_retry_at"),
        F.col("u").cast("timestamp").alias("updated_at"),
    ).select(*DEAD_LETTERS.fieldNames())


def body(event_id, event_type="page_view", **more):
    return json.dumps({"event_id": event_id, "event_type": event_type, "timestamp": "2024-05-31T00:00:00.000Z", "app_code": "app", **more})


def test_store_replaces_by_reason_and_id_but_keeps_entries_without_id(spark):
    d = "2024-05-31 00:00:00"
    old = entries(spark, ("a", "r", d, 3, d, d, "{}"), (None, "r", d, 0, d, d, '{"x":1}'))
    new = entries(spark, ("a", "r", NOW_TEXT, 0, d, NOW_TEXT, "{}"), ("a", "q", d, 0, d, d, "{}"), (None, "r", d, 0, d, d, '{"x":2}'))
    got = sorted((str(r.event_id), r.reason, r.retry_count) for r in DL.store(old, new).collect())
    assert got == [("None", "r", 0), ("None", "r", 0), ("a", "q", 0), ("a", "r", 0)]


NOW_TEXT = "2024-06-01 00:00:00"


def test_fetch_skips_back_off_and_moves_exhausted(spark):
    prepare_session(spark)
    d, soon = "2024-05-31 00:00:00", "2024-06-01 00:01:00"
    table = entries(
        spark,
        ("wait", "r", d, 0, soon, d, "{}"),
        ("old", "r", "2024-05-30 00:00:00", 0, None, d, "{}"),
        ("new", "r", d, 0, d, d, "{}"),
        ("done", "r", d, 10, d, d, "{}"),
        ("later", "r", d, 10, soon, d, "{}"),
    )
    assert [r.event_id for r in DL.fetch_due(table, CFG.with_(dlq_batch_size=1), now()).collect()] == ["old"]
    assert sorted(r.event_id for r in DL.fetch_due(table, CFG, now()).collect()) == ["new", "old"]
    dead, staying = DL.split_exhausted(table, CFG, now())
    assert [r.event_id for r in dead.collect()] == ["done"] and staying.count() == 4


def test_alive_needs_time_and_a_readable_payload(spark):
    d = "2024-05-31 00:00:00"
    table = entries(
        spark, ("ok", "r", d, 0, d, d, "{}"), ("old", "r", d, 0, d, "2024-05-25 00:00:00", "{}"),
        ("gone", "r", d, 0, d, d, None), ("bad", "r", d, 0, d, d, "{nope"),
    )
    assert [r.event_id for r in DL.alive(table, CFG, now()).collect()] == ["ok"]


def test_replay(spark):
    prepare_session(spark)
    d = "2024-05-31 00:00:00"
    table = entries(
        spark,
        ("fresh", "collection_failed", d, 0, d, d, body("fresh")),
        ("fresh", "schema_violation", d, 0, d, d, body("fresh")),
        ("known", "collection_failed", d, 0, d, d, body("known")),
        ("bad", "schema_violation", d, 2, d, d, body("bad", "click", properties='{"x":"no"}')),
        (None, "validation_failed", d, 0, d, d, json.dumps({"event_type": "page_view"})),
        ("wait", "collection_failed", d, 1, "2024-06-01 00:10:00", d, body("wait")),
        ("spent", "collection_failed", d, 10, d, d, body("spent")),
    )
    events = spark.createDataFrame([("known",)], "event_id string")
    cfg = CFG.with_(contract_mode="enforce", dlq_jitter=0.0)
    run = replay_dead_letters(table, events, contracts(spark), cfg, now())
    got = sorted((str(r.event_id), r.reason, r.replay_outcome) for r in run.outcomes.collect())
    assert got == [
        ("None", "validation_failed", "failed"), ("bad", "schema_violation", "failed"),
        ("fresh", "collection_failed", "replayed"), ("fresh", "schema_violation", "replayed"),
        ("known", "collection_failed", "already_processed"),
    ]
    assert [r.event_id for r in run.events.collect()] == ["fresh"]
    assert run.events.columns == EVENTS.fieldNames()
    waiting = {r.event_id: (r.retry_count, str(r.next_retry_at)) for r in run.waiting.collect()}
    assert waiting == {"bad": (3, "2024-06-01 00:00:08"), None: (1, "2024-06-01 00:00:02"), "wait": (1, "2024-06-01 00:10:00")}
    assert [r.event_id for r in run.exhausted.collect()] == ["spent"]


def test_replayed_events_go_the_way_of_new_ones(spark):
    """Nothing private, no invented time and no identify event reaches the table."""
    prepare_session(spark)
    strict = CFG.with_(contract_mode="enforce", require_consent=True, hash_user_id=True, pii_fields=("email",), mask_heuristics=True, dlq_jitter=0.0)
    custom = {"email": "bob@example.com", "contact": "al@example.com"}
    click = {"eventType": "click", "anonymousId": "a1", "data": {"custom": json.dumps(custom)}}
    refused = ingest(
        raw(
            spark,
            {"eventId": "yes", "timestamp": 1_700_000_000_000, "userId": "bob", "consent": True, **click},
            {"eventId": "no", "timestamp": 1_700_000_001_000, "userId": "bob", "consent": False, **click},
            {"eventId": "untimed", "userId": "bob", "consent": True, **click},
            {"eventId": "later", "timestamp": 1_700_000_002_000, **click},
            {"eventId": "", "eventType": "$identify", "anonymousId": "a1", "userId": "eve", "timestamp": 1_700_000_000_500},
        ),
        contracts(spark),
        strict,
        now(),
    )
    entries = DL.store(spark.createDataFrame([], DEAD_LETTERS), refused.dead)
    assert entries.count() == 5
    run = replay_dead_letters(entries, spark.createDataFrame([], EVENTS), contracts(spark), strict.with_(contract_mode="monitor"), now())
    rows = {r.event_id: r for r in run.events.collect()}
    assert set(rows) == {"yes", "no", "later"}
    assert rows["yes"].user_id.startswith("h:") and rows["later"].user_id == rows["yes"].user_id and rows["no"].user_id == ""
    assert json.loads(rows["yes"].properties)["contact"] == "a***@example.com"
    assert not any("bob@" in r.properties or "bob" == r.user_id for r in rows.values())
    assert "email" not in json.loads(rows["no"].properties)
    assert len({r.session_id for r in rows.values()}) == 1 and rows["yes"].session_id.startswith("sess_")
    assert {str(r.event_id): r.replay_outcome for r in run.outcomes.collect()} == {
        "yes": "replayed", "no": "replayed", "later": "replayed", "untimed": "failed", "": "failed",
    }


def test_annotate_for_the_dead_letter_topic(spark):
    prepare_session(spark)
    df = spark.createDataFrame([("e", '{"foo":"bar","_dlq_reason":"old"}'), ("f", None)], "event_id string, properties string")
    rows = DL.annotate(df.withColumn("received_at", ts("2024-05-01 10:00:00")), "why", now()).orderBy("event_id").collect()
    first = json.loads(rows[0].properties)
    assert first == {"foo": "bar", "_dlq_reason": "why", "_dlq_original_timestamp": "2024-05-01T10:00:00.000Z"}
    assert json.loads(rows[1].properties)["_dlq_reason"] == "why"
    assert str(rows[0].received_at) == NOW_TEXT


# ------------------------------------------------------------------ heavy keys


def test_lookups_of_any_size(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 300}", 1_000 + i) for i in range(900)] + [(None, 5_000)]
    left = spark.createDataFrame(rows, "k string, n long").repartition(7)
    right = spark.createDataFrame([("hot", "H"), ("k1", "K"), ("zz", "Z")], "k string, v string")
    plain = sorted(map(str, left.join(right, ["k"], "left").collect()))
    assert sorted(map(str, lookup_join(left, right, ["k"]).select("k", "n", "v").collect())) == plain
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(map(str, lookup_join(left, right, ["k"]).select("k", "n", "v").collect())) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_three_thousand_heavy_keys(spark):
    """No task of the duplicate check or the identity window has a whole heavy key's
    rows: work is by (id, time, seq) and by (visitor, hour)."""
    prepare_session(spark)
    rows = spark.range(30_000).select(
        F.concat(F.lit("e"), F.col("id") % 3_000).alias("event_id"),
        F.concat(F.lit("a"), F.col("id") % 3_000).alias("anonymous_id"),
        F.when(F.col("id") % 7 == 0, F.lit("u")).alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("timestamp"),
        F.col("id").alias("seq"),
    )
    kept = drop_duplicates(rows, CFG)
    assert kept.count() == 30_000  # copies of an id are 3 000 s apart
    resolved = resolve_identity(rows, CFG)
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert all("_hour" in line.split("], [")[1] for line in plan.splitlines() if "Window" in line and "_link" in line)
    # a visitor has one event every 50 minutes, and links on the first of every seven
    assert resolved.where("identity_resolved").count() == 30_000 - 4_286 - sum(min(k for k in range(10) if (n + 3_000 * k) % 7 == 0) for n in range(3_000))


@pytest.mark.parametrize("cap", [1, 3, 50])
def test_rate_cap_matches_a_plain_ranking(spark, cap):
    prepare_session(spark)
    rows = [("bot" if i % 3 == 0 else f"c{i % 7}", i // 200, f"r{i:05d}") for i in range(1_500)] + [(None, 0, "n1"), ("", 0, "n2")]
    df = spark.createDataFrame(rows, "app_code string, s long, event_id string").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {r.event_id: r.over_limit for r in rate_cap(df, CFG.with_(max_requests_per_second=cap)).collect()}
    seen, want = {}, {}
    for client, s, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        key = (client or "default", s)
        seen[key] = seen.get(key, 0) + 1
        want[rid] = seen[key] > cap
    assert got == want


# ------------------------------------------------------------------ sources and tables


def envelope(n, client="app", start=0):
    return json.dumps({"clientId": client, "events": [page(f"e{start + i}", 1_700_000_000_000 + i) for i in range(n)]})


def test_envelope_limits(spark, tmp_path):
    lines = [envelope(0), envelope(500), envelope(501), json.dumps({"events": [page("z")]}), json.dumps({"clientId": "x"})]
    (tmp_path / "in.json").write_text("\n".join(lines))
    read = read_envelopes(spark, str(tmp_path))
    opened = explode_envelopes(read, CFG)
    assert opened.count() == 501 == opened.select("seq").distinct().count()
    assert sorted(r.app_code for r in opened.select("app_code").distinct().collect()) == ["app", "default"]
    assert reject_envelopes(read, CFG).count() == 3


def flat(spark, n=50):
    return spark.range(n).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.lit("page_view").alias("event_type"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("u"), F.col("id") % 5)).alias("user_id"),
        F.concat(F.lit("a"), F.col("id") % 5).alias("anonymous_id"), F.lit("app").alias("app_code"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7200).alias("timestamp"),
        F.lit('{"foo":"bar","n":42}').alias("properties"),
    )


def test_events_table(spark, tmp_path):
    prepare_session(spark)
    path = str(tmp_path / "events")
    write_events(flat(spark), path, now())
    rows = read_events(spark, path)
    assert rows.columns == EVENTS.fieldNames() and rows.count() == 50
    assert json.loads(rows.first().properties) == {"foo": "bar", "n": 42}
    day = read_events(spark, path, since="2023-11-15 00:00:00", until="2023-11-16 00:00:00")
    assert day.count() == 12
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().toString()
    assert compact_events(spark, path, "2023-11-15", "2023-11-16", 4) == ["2023-11-15", "2023-11-16"]
    assert read_events(spark, path).count() == 50
    finish_compaction(spark, path)  # nothing left to do
    assert len(batches_of(spark, path)) == 2
    # a batch that is written again replaces itself, also beside the compacted one
    for _ in range(2):
        write_events(flat(spark, 3).withColumn("event_id", F.concat(F.lit("n"), "event_id")), path, now(), "b1")
    assert read_events(spark, path).count() == 53
    assert expire_days(spark, path, "event_date", "2023-11-16") == ["2023-11-14", "2023-11-15"]
    assert read_events(spark, path).count() == 50 - 1 - 12
    assert {r.event_id for r in read_events(spark, path).collect()} == {f"e{i}" for i in range(13, 50)}


def test_reading_opens_only_the_days_asked_for(spark, tmp_path):
    prepare_session(spark)
    path = str(tmp_path / "events")
    write_events(flat(spark), path, now())
    spark.sparkContext.setJobGroup("reading", "")
    day = read_events(spark, path, since="2023-11-15 00:00:00", until="2023-11-16 00:00:00")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("reading")  # no footers
    scan = day._jdf.queryExecution().executedPlan()
    files = [str(f) for f in day.inputFiles()]
    spark.sparkContext._jsc.clearJobGroup()
    assert "event_date" in scan.toString() and len(files) >= 1


def test_a_state_is_the_same_for_a_repeated_batch(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v long").schema
    state = BatchState(str(tmp_path / "state"), schema, lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")))

    def rows(n):
        return spark.createDataFrame([("a", n), (f"b{n}", n)], schema)

    last = 2 * FOLD_EVERY + 3
    for n in range(last):
        state.add(rows(n), n)
        if n % 7 == 0:
            before = state.before(spark, n).count()
            state.add(rows(n), n)
            assert state.before(spark, n).count() == before == (n + 1 if n else 0)
    assert dict(map(tuple, state.before(spark, last).collect())) == {"a": last - 1} | {f"b{n}": n for n in range(last)}
    assert len(finished(spark, state.root, "base-")) == 2
    assert len(finished(spark, state.root, "add-")) < last


def test_snapshots_refuse_a_stale_base(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.createDataFrame([(1,)], "n int")
    assert [write_snapshot(df, root, base) for base in (None, 0, 1, 2, 3)] == [0, 1, 2, 3, 4]
    assert finished(spark, root, "version=") == [2, 3, 4]
    with pytest.raises(RuntimeError):
        write_snapshot(df, root, 3)


def test_topics(spark, tmp_path):
    prepare_session(spark)
    topics = FolderTopics(str(tmp_path / "topics"))
    events = flat(spark).withColumn("event_type", F.when(F.col("event_id") == "e0", "session_start").otherwise("click"))
    write_event_stream(events, topics, CFG)
    read = read_event_stream(spark, topics, CFG)
    got = S.to_parquet(read, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got.count() == 49
    records = to_records(events, CFG)
    assert records.groupBy("key").agg(F.countDistinct("partition").alias("p")).where("p > 1").count() == 0
    key = F.coalesce("user_id", "anonymous_id")
    placed = ordered_by_user(events, 4).withColumn("p", F.spark_partition_id())
    assert placed.count() == 50
    assert placed.groupBy(key, F.to_date("timestamp")).agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0


# ------------------------------------------------------------------ delivery


def failing(batch, batch_id):
    raise OSError("down")


def recording(log, name):
    return lambda batch, batch_id: log.append((name, batch_id, batch.count()))


def test_fallback_order(spark):
    log = []
    batch = flat(spark, 3)
    topic, table, dead = (recording(log, n) for n in ("topic", "table", "dead"))
    S.collect_with_fallback(CFG, topic, table, dead)(batch, 1)
    S.collect_with_fallback(CFG, failing, table, dead)(batch, 2)
    S.collect_with_fallback(CFG, failing, failing, dead)(batch, 3)
    S.collect_with_fallback(CFG.with_(async_topic=False), topic, table, dead)(batch, 4)
    assert log == [("topic", 1, 3), ("table", 2, 3), ("dead", 3, 3), ("table", 4, 3)]
    with pytest.raises(OSError):
        S.collect_with_fallback(CFG.with_(async_topic=False), topic, failing, dead)(batch, 5)


def test_failed_write_goes_to_dead_letters_and_empty_batches_do_nothing(spark):
    log = []
    deliver = S.failure_to_dead_letters(failing, recording(log, "dead"))
    deliver(flat(spark, 3), 1)
    deliver(flat(spark, 0), 2)
    assert log == [("dead", 1, 3)]


def test_dead_letter_sinks_and_repeated_batches(spark, tmp_path):
    prepare_session(spark)
    sink = S.dead_letter_sink(str(tmp_path / "dlq"), "table_write_failed")
    sink(flat(spark, 3), 0)
    sink(flat(spark, 3), 0)
    sink(flat(spark, 4), 1)
    stored, added = read_entries(spark, str(tmp_path / "dlq"))
    assert stored.count() == 4 and added == ["batch-0", "batch-1"]
    topics = FolderTopics(str(tmp_path / "topics"))
    for _ in range(2):
        S.dead_letter_topic_sink(topics, "why", CFG)(flat(spark, 2).withColumn("received_at", now()), 0)
    sent = spark.read.json(str(tmp_path / "topics"))
    assert sent.count() == 2 and sent.first().topic == "events-dlq"


def test_streaming_ingest_keeps_state_between_batches(spark, tmp_path):
    prepare_session(spark)
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()
    login = {"clientId": "app", "events": [page("e0"), page("e1", 1_700_000_001_000, userId="u1")]}
    later = {"clientId": "app", "events": [page("e1", 1_700_000_100_000), page("e1", 1_700_000_301_000), page("e2", 1_700_000_400_000), {}]}
    run = ingest_batches(
        contracts(spark), state, S.events_table_sink(table), S.entries_sink(str(tmp_path / "dlq")),
        CFG.with_(identity_ttl_days=100_000),
    )
    for number, content in enumerate((login, later)):
        (source / f"{number}.json").write_text(json.dumps(content))
        S.run_available(stream_envelopes(spark, str(source)), run, str(tmp_path / "cp"))
    rows = sorted((r.event_id, r.user_id) for r in read_events(spark, table).collect())
    assert rows == [("e0", ""), ("e1", "u1"), ("e1", "u1"), ("e2", "u1")]
    # all within half an hour: one visit, although in two batches
    assert len({r.session_id for r in read_events(spark, table).collect()}) == 1
    assert read_entries(spark, str(tmp_path / "dlq"))[0].count() == 1


@pytest.fixture
def loaded(spark, tmp_path):
    """Run the load over batches of events, one run each; the table and dead letters."""
    prepare_session(spark)
    topics = FolderTopics(str(tmp_path / "topics"))
    paths = {name: str(tmp_path / name) for name in ("table", "cp", "dlq")}

    def load(*batches, moments=None):
        for k, batch in enumerate(batches):
            if isinstance(batch, str):
                lines = spark.createDataFrame([("events", "k", batch)], "topic string, key string, value string")
                topics.write(lines, f"raw{k}")
            else:
                write_event_stream(batch, topics, CFG)
            at = now() if moments is None else moments[k]
            load_from_stream(spark, topics, paths["table"], paths["cp"], CFG, dead=paths["dlq"], now=at)
        return read_events(spark, paths["table"]).collect(), read_entries(spark, paths["dlq"])[0].collect()

    return load


def sent(spark, *rows):
    """(event_id, second)"""
    df = spark.createDataFrame([(i, float(s)) for i, s in rows], "event_id string, s double")
    return df.select(
        "event_id", F.lit("click").alias("event_type"), F.lit(None).cast("string").alias("user_id"), F.lit("a").alias("anonymous_id"),
        F.timestamp_millis(F.lit(1_700_000_000_000) + (F.col("s") * 1000).cast("long")).alias("timestamp"),
    )


def test_failed_batch_is_not_seen(spark, tmp_path):
    """A batch that breaks off leaves no rows and no ids; sent again it is written once."""
    prepare_session(spark)
    topics, at = FolderTopics(str(tmp_path / "topics")), now()
    table, cp, dlq = (str(tmp_path / name) for name in ("table", "cp", "dlq"))
    batch = sent(spark, ("a", 0), ("b", 90_000), ("", 5))

    def breaks_off(rows, batch_id):
        S.events_table_sink(table, at)(rows.where("event_id = 'a'"), batch_id)
        raise OSError("down")

    counts = []
    for write in (breaks_off, None, None):
        write_event_stream(batch, topics, CFG)
        load_from_stream(spark, topics, table, cp, CFG, dlq, at, write)
        counts.append(sorted(r.event_id for r in read_events(spark, table).collect()))
    assert counts == [[], ["", "a", "b"], ["", "", "a", "b"]]
    dead = spark.read.json(str(tmp_path / "topics" / "topic=events-dlq"))
    assert dead.count() == 3
    # back from the topic: entries without an id stay apart, and reading twice adds nothing
    for number in range(2):
        load_dead_letters(spark, topics, dlq, str(tmp_path / f"dead{number}"), CFG, at)
    entries = read_entries(spark, dlq)[0].collect()
    assert sorted(e.event_id for e in entries) == ["", "a", "b"]
    assert {e.reason for e in entries} == {"table_write_failed"}
    assert all("_dlq" not in e.event_json for e in entries)
    topics.write(spark.createDataFrame([("events-dlq", "k", "{broken")], "topic string, key string, value string"), "raw")
    load_dead_letters(spark, topics, dlq, str(tmp_path / "dead0"), CFG, at)
    assert sorted(e.reason for e in read_entries(spark, dlq)[0].collect()) == ["table_write_failed"] * 3 + ["unreadable_record"]


def test_state_in_two_steps(spark, tmp_path):
    prepare_session(spark)
    state = BatchState(str(tmp_path / "s"), T.StructType([T.StructField("n", T.IntegerType())]), lambda rows: rows)
    rows = [spark.createDataFrame([(n,)], "n int") for n in range(20)]

    def known(batch):
        return sorted(r.n for r in state.before(spark, batch).collect())

    state.propose(rows[0], 0)
    assert known(1) == []
    state.confirm(spark, 0)
    state.propose(rows[1], 1)
    state.discard(spark, 1)
    assert known(2) == [0]
    for n in range(2, 17):
        state.add(rows[n], n)
    assert known(17) == [0, *range(2, 17)]
    # an earlier attempt at a batch had succeeded and was folded
    state.discard(spark, 16)
    assert known(17) == [0, *range(2, 16)]


def test_late_events_are_loaded(spark, loaded):
    rows, _ = loaded(sent(spark, ("a", 0), ("b", 90_000)), sent(spark, ("c", 200_000)), sent(spark, ("late", -7_200)))
    assert sorted(r.event_id for r in rows) == ["a", "b", "c", "late"]


def test_events_without_an_id_are_all_loaded(spark, loaded):
    rows, _ = loaded(sent(spark, ("", 0), ("", 0), (None, 0)), sent(spark, ("", 0)))
    assert len(rows) == 4


def test_unreadable_records_are_dead_letters(spark, loaded):
    rows, dead = loaded("{broken", sent(spark, ("a", 0)), '["no event"]')
    assert [r.event_id for r in rows] == ["a"]
    assert sorted(json.loads(r.event_json)["value"] for r in dead) == ['["no event"]', "{broken"]
    assert {r.reason for r in dead} == {UNREADABLE}


def test_records_are_parsed_once(spark, tmp_path):
    """The parsed rows are written; neither events nor broken records go back to the text."""
    texts = ['{"event_id":"a","event_type":"click"}', "{broken", None, "[1]", '{"event_id":"b"}']
    rows = spark.createDataFrame([(text, n) for n, text in enumerate(texts)], "value string, seq long")
    events, broken = split_unreadable(write_through(parse_records(rows)))
    assert sorted((r.event_id, r.seq) for r in events.collect()) == [("a", 0), ("b", 4)]
    assert sorted((r.value or "", r.seq) for r in broken.collect()) == [("", 2), ("[1]", 3), ("{broken", 1)]
    for part in (events, broken):
        assert "from_json" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert parse_records(rows)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_one_event_far_ahead_changes_nothing(spark, loaded):
    rows, _ = loaded(sent(spark, ("a", 0)), sent(spark, ("far", 10 * 365 * 86_400)), sent(spark, ("a", 1), ("a", 301)))
    assert sorted(r.event_id for r in rows) == ["a", "a", "far"]


def test_ids_are_forgotten_by_arrival(spark, loaded):
    moments = [F.timestamp_seconds(F.lit(1_700_000_000 + s)) for s in (0, 100, 100 + CFG.seen_ttl_s + 1)]
    rows, _ = loaded(sent(spark, ("a", 0)), sent(spark, ("a", 1)), sent(spark, ("a", 2)), moments=moments)
    assert len(rows) == 2


def test_scratch_of_a_batch_goes_with_it(spark):
    with dropping_scratch(spark):
        path = write_through(flat(spark, 3), "probe").inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path)


# ------------------------------------------------------------------ jobs over stored tables


def test_replay_job_over_stored_tables(spark, tmp_path):
    prepare_session(spark)
    dlq, dead, table = (str(tmp_path / n) for n in ("dlq", "dead", "events"))
    write_events(flat(spark, 1), table, now())
    d = "2024-05-31 00:00:00"
    first = entries(
        spark,
        ("fresh", "collection_failed", d, 0, d, d, body("fresh")),
        ("bad", "schema_violation", d, 0, d, d, body("bad", "ghost")),
        ("spent", "collection_failed", d, 10, d, d, body("spent")),
    )
    assert read_snapshot(spark, dlq, DEAD_LETTERS).count() == 0
    add_entries(first, dlq, 0)
    cfg = CFG.with_(contract_mode="enforce", dlq_jitter=0.0)
    got = run_replay(spark, dlq, dead, table, contracts(spark), cfg, now())
    assert {r.event_id: r.replay_outcome for r in got.collect()} == {"fresh": "replayed", "bad": "failed"}
    assert sorted(r.event_id for r in read_events(spark, table).collect()) == ["e0", "fresh"]
    assert [r.event_id for r in read_snapshot(spark, dead, DEAD_LETTERS).collect()] == ["spent"]
    left, added = read_entries(spark, dlq)
    assert [(r.event_id, r.retry_count) for r in left.collect()] == [("bad", 1)] and added == []
    # the same entries again: found in the table and among the dead, not written twice
    add_entries(first, dlq, 1)
    again = run_replay(spark, dlq, dead, table, contracts(spark), cfg, now())
    assert {r.event_id: r.replay_outcome for r in again.collect()} == {"fresh": "already_processed"}  # bad is in back-off
    assert read_events(spark, table).count() == 2
    assert read_snapshot(spark, dead, DEAD_LETTERS).count() == 1
    # dead letters run out
    run_replay(spark, dlq, dead, table, contracts(spark), cfg.with_(dlq_dead_ttl_s=60), now())
    assert read_snapshot(spark, dead, DEAD_LETTERS).count() == 0 and newest_version(spark, dlq) == 2


def test_rollup_jobs_replace_only_their_days(spark, tmp_path):
    prepare_session(spark)
    events, sessions, hourly, daily = (str(tmp_path / n) for n in ("e", "s", "h", "d"))
    write_events(flat(spark, 40), events, now())
    found = finalize_sessions(read_events(spark, events), CFG, now())
    write_sessions(found, sessions)
    write_sessions(found, sessions)
    days = ("2023-11-14", "2023-11-18")
    for _ in range(2):
        refresh_hourly(spark, events, hourly, *days)
        refresh_hourly(spark, events, hourly, "2023-11-15", "2023-11-15")
        refresh_daily(spark, sessions, daily, *days)
    assert spark.read.parquet(hourly).agg(F.sum("event_count")).first()[0] == 40
    assert spark.read.parquet(daily).agg(F.sum("session_count")).first()[0] == found.count()


def test_scratch_is_removed(spark):
    kept = write_through(flat(spark, 3), "probe")
    path = kept.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) or os.path.exists(path.removeprefix("//"))
    clear_scratch(spark)
    assert not os.path.exists(path) and not os.path.exists(path.removeprefix("//"))


# ------------------------------------------------------------------ many small batches


def test_batch_names_stay_small():
    names = BatchNames([numbered_batch("stream", n) for n in range(5_000)] + ["job-x", numbered_batch("replay", 3)])
    assert names.lines() == ["replay-000000000003..000000000003", "stream-000000000000..000000004999", "job-x"]
    names.add([numbered_batch("stream", n) for n in (5_002, 5_001, 9_000, 5_000)])
    again = BatchNames(names.lines())
    assert numbered_batch("stream", 5_002) in again and numbered_batch("stream", 5_003) not in again
    assert "job-x" in again and numbered_batch("other", 3) not in again
    assert BatchNames([numbered_batch("a", 1), "job-y", ""]).lines() == ["a-000000000001..000000000001", "job-y"]
    again.keep([])
    assert "job-x" not in again and len(again.lines()) == 3


def test_small_batches_are_folded(spark, tmp_path):
    """Sweeps in between read every event once; a day keeps a handful of folders."""
    prepare_session(spark)
    table, sessions, state = (str(tmp_path / name) for name in ("table", "sessions", "state"))
    for number in range(26):
        rows = sent(spark, (f"e{number}", number * 10), (f"f{number}", 90_000)).withColumn("session_id", F.col("event_id"))
        write_events(rows, table, now(), numbered_batch("stream", number))
        if number % 5 == 4:
            sweep_sessions(spark, table, sessions, state, CFG, F.timestamp_seconds(F.lit(1_800_000_000)))
            fold_small_batches(spark, table, swept_batches(spark, state), tier=5, small=2**20)
    folders = [len(os.listdir(tmp_path / "table" / d)) for d in os.listdir(tmp_path / "table") if d.startswith("event_date")]
    assert len(folders) == 2 and max(folders) <= 6
    # the last batch has not been swept
    assert fold_small_batches(spark, table, swept_batches(spark, state), tier=2, small=2**20)
    assert {name.split("-")[0] for name in batches_of(spark, table)} == {"compact", "stream"}
    sweep_sessions(spark, table, sessions, state, CFG, F.timestamp_seconds(F.lit(1_800_000_100)))
    assert read_events(spark, table).count() == 52
    assert read_sessions(spark, sessions).count() == 52
    assert sum(r.page_views + r.clicks for r in read_sessions(spark, sessions).collect()) == 52


def test_late_hours_are_corrected(spark, tmp_path):
    streaming_session(spark)
    topics, table, target = FolderTopics(str(tmp_path / "topics")), str(tmp_path / "table"), str(tmp_path / "hourly")
    columns = {"session_id": F.lit("s"), "spmb": F.lit("b"), "spmd": F.lit("d"), "stay_duration": F.lit(5)}

    def trigger(number, *rows):
        batch = event_table_rows(sent(spark, *rows).withColumns(columns), now()).drop("event_date")
        write_event_stream(batch, topics, CFG)
        write_events(batch, table, now(), numbered_batch("part", number))
        send_hours(read_event_stream(spark, topics, CFG).where("unreadable is null"), target, str(tmp_path / "cp"), CFG)
        return len(correct_hours(spark, table, target))

    def counts():
        return sorted(r.event_count for r in read_hourly(spark, target).collect())

    # hours 0 and 2 are over when the last event comes
    assert trigger(0, ("a", 0), ("b", 1), ("c", 7_200), ("d", 20_000)) == 0
    assert counts() == [1, 2]
    # late for hour 0 and for an hour that had none; on time for the open hour
    assert trigger(1, ("e", 2), ("f", 3_700), ("g", 20_001)) == 2
    assert counts() == [1, 1, 3]
    assert correct_hours(spark, table, target) == []
    # later again for a corrected hour; the open hour ends
    assert trigger(2, ("h", 3), ("i", 40_000)) == 1
    assert counts() == [1, 1, 2, 4]


def test_topics_are_written_without_sorting(spark, tmp_path):
    """No task holds its records to sort them by topic; files are compressed, and the
    session's setting is as before."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, topics = spark.conf.get(name), FolderTopics(str(tmp_path))
    rows = spark.range(40).select(
        F.concat(F.lit("t"), F.col("id") % 3).alias("topic"), F.col("id").cast("string").alias("key"), F.lit("{}").alias("value")
    )
    for _ in range(2):
        topics.write(rows.coalesce(1), "b")
    assert spark.conf.get(name) == before
    found = spark.read.json(str(tmp_path))
    assert found.count() == 40 and found.where("topic = 't1'").count() == 13
    files = found.inputFiles()
    assert len(files) == 3 and all(f.endswith(".json.gz") for f in files)


def test_compaction_writes_more_files_of_a_large_table(spark, tmp_path, monkeypatch):
    from eventloom.sources import tables

    path = str(tmp_path)
    rows = spark.range(2_000).select(
        F.col("id").cast("string").alias("event_id"), F.lit("click").alias("event_type"), F.lit("a").alias("app_code"),
        F.concat(F.lit("u"), F.col("id") % 50).alias("user_id"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id")).alias("timestamp"),
    )
    write_events(rows, path, now())
    monkeypatch.setattr(tables, "FILE", 20_000)
    compact_events(spark, path, "2023-11-14", "2023-11-14", 1)
    assert read_events(spark, path).count() == 2_000
    assert len(spark.read.parquet(path).inputFiles()) > 2


def test_days_of_the_evolving_table_are_not_spread(spark):
    """Its first half is laid out by day like the rest: no task has to sort all days."""
    files = catalog()["evolve_schema"](spark, "/root/testdata/sf0.001").inputFiles()
    old = [f.rsplit("/", 2)[0] for f in files if "batch=old" in f]
    assert len(old) == len(set(old)) > 10
