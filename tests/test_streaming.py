"""Streams over several triggers against the batch operators."""

from __future__ import annotations

import math
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.operators.dedup import drop_duplicates
from eventloom.operators.identity import resolve_identity
from eventloom.operators.rollups import events_hourly, merge_hourly
from eventloom.operators.sessions import OPENING, session_rows
from eventloom.streaming.batches import SLICE_MS, SliceSteps, dedup_batches, identity_batches, rate_batches, serve_instants, thread_slices
from eventloom.streaming.dedup import dedup_stream
from eventloom.streaming.keyed import SessionTimers, identity_keyed, last_versions, sweep_stream
from eventloom.streaming.metrics import IngestCounters, observe_stream
from eventloom.streaming.rollups import hourly_stream
from eventloom.streaming.sessions import sessionize_stream
from eventloom.streaming.settings import streaming_session, timers_by_clock
from eventloom.streaming.sinks import batches_to_parquet, run_available, to_parquet

CFG = EngineConfig()
T0 = 1_700_000_000_000
FAR = 10**9


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Events of two hours in three files in time order, and one event much later that
    moves the watermark past everything before it."""
    streaming_session(spark)
    rng = random.Random(5)
    rows, ms = [], 0
    for seq in range(240):
        ms += rng.choice((0, 700, 20_000, 60_000, 120_000))
        kind = rng.choice(("page_view", "page_view", "click", "scroll", "exposure"))
        user = f"u{rng.randrange(4)}" if rng.random() < 0.2 else None
        rows.append((rng.choice((f"e{seq}", f"e{rng.randrange(20)}", "")), kind, user, f"a{rng.randrange(6)}", seq, ms))
    rows.append(("end", "custom", None, "z", FAR, ms + 30 * 86_400_000))
    folder = str(tmp_path_factory.mktemp("stream"))
    df = (
        spark.createDataFrame(rows, "event_id string, event_type string, user_id string, anonymous_id string, seq long, ms long")
        .withColumns(
            {
                "timestamp": F.timestamp_millis(F.lit(T0) + F.col("ms")),
                "app_code": F.concat(F.lit("app"), F.col("seq") % 2),
                "page_url": F.concat(F.lit("/p"), F.col("seq") % 3),
                "scroll_depth": (F.col("seq") % 100).cast("int"),
                "stay_duration": F.when(F.col("seq") % 3 == 0, F.col("seq")),
                "session_id": F.lit(None).cast("string"),
                "spmb": F.lit("b"),
                "spmd": F.lit(None).cast("string"),
            }
        )
        .drop("ms")
    )
    for low, high in ((0, 80), (80, 160), (160, 240), (FAR, FAR + 1)):
        df.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture
def batch(spark, history):
    return spark.read.parquet(history)


@pytest.fixture
def run(spark, history, tmp_path, batch):
    def over(operator):
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(history)
        return to_parquet(operator(stream), str(tmp_path / "rows"), str(tmp_path / "checkpoint"))

    return over


@pytest.fixture
def run_batches(spark, history, tmp_path, batch):
    def over(make):
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(history)
        run_available(stream, make(str(tmp_path / "state"), batches_to_parquet(str(tmp_path / "rows"))), str(tmp_path / "checkpoint"))
        return spark.read.parquet(str(tmp_path / "rows"))

    return over


def now():
    return F.timestamp_millis(F.lit(T0))


def rows(df):
    return sorted(map(str, df.collect()))


def test_anchored_duplicates(run_batches, batch):
    got = run_batches(lambda state, out: dedup_batches(state, out, CFG, now()))
    assert rows(got.select("seq")) == rows(drop_duplicates(batch, CFG).select("seq"))


def test_built_in_duplicates_keep_every_id_and_all_without(run, batch):
    got = run(lambda s: dedup_stream(s, CFG))
    assert rows(got.where("event_id = ''").select("seq")) == rows(batch.where("event_id = ''").select("seq"))
    assert rows(got.select("event_id").distinct()) == rows(batch.select("event_id").distinct())
    assert got.count() < batch.count()


def test_identity(run_batches, batch):
    columns = ["seq", "user_id", "identity_linked", "identity_resolved"]
    got = run_batches(lambda state, out: identity_batches(state, out, CFG, now()))
    want = resolve_identity(batch, CFG)
    assert rows(got.select(columns)) == rows(want.select(columns))
    assert want.where("identity_resolved").count() > 20


def test_closed_sessions(run, batch):
    got = run(lambda s: sessionize_stream(s, CFG))
    want = session_rows(batch, CFG).where("anonymous_id <> 'z'")
    assert rows(got) == rows(want)


def test_closed_hours(run, batch):
    got = merge_hourly(run(lambda s: hourly_stream(s, CFG)))
    want = events_hourly(batch).where("anonymous_id <> 'z'")
    assert rows(got) == rows(want)


def test_token_bucket(run_batches, batch):
    cfg = CFG.with_(max_requests_per_second=1)
    got = {r.seq: r.over_limit for r in run_batches(lambda state, out: rate_batches(state, out, cfg)).collect()}
    order = batch.select("app_code", "seq", "event_id", F.unix_millis("timestamp").alias("ms")).collect()
    # the order of service: trigger, time, id
    trigger = lambda seq: (seq >= 80) + (seq >= 160) + (seq >= FAR)
    buckets, want = {}, {}
    for r in sorted(order, key=lambda r: (trigger(r.seq), r.ms, r.event_id)):
        tokens, last = buckets.get(r.app_code, (1_000, r.ms))
        tokens = min(1_000, tokens + max(0, r.ms - last))
        over = tokens < 1_000
        buckets[r.app_code] = (tokens - (0 if over else 1_000), max(last, r.ms))
        want.setdefault((r.app_code, r.ms, r.event_id), []).append(over)
    # requests with one id at one instant are interchangeable
    have = {}
    for r in order:
        have.setdefault((r.app_code, r.ms, r.event_id), []).append(got[r.seq])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(got.values()) and not all(got.values())


def test_one_client_with_a_third_of_the_requests(spark, tmp_path):
    """Served from one count per instant, as a plain bucket would."""
    rng = random.Random(9)
    requests = [("bot" if i % 3 else f"c{i % 50}", rng.randrange(40_000), f"r{i:05d}") for i in range(9_000)]
    df = spark.createDataFrame(requests, "app_code string, ms long, event_id string")
    df = df.withColumn("timestamp", F.timestamp_millis(F.lit(T0) + F.col("ms")))
    cfg = CFG.with_(max_requests_per_second=20)
    run = rate_batches(str(tmp_path / "state"), batches_to_parquet(str(tmp_path / "rows")), cfg)
    for number in range(2):
        run(df.where(f"floor(ms / 20000) = {number}"), number)
    got = {r.event_id: r.over_limit for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    tokens, last, want = {}, {}, {}
    for client, ms, rid in sorted(requests, key=lambda r: (r[1], r[2])):
        have = min(20_000, tokens.get(client, 20_000) + (ms - last.get(client, ms)) * 20)
        want[rid] = have < 1_000
        tokens[client], last[client] = have - (0 if want[rid] else 1_000), ms
    assert got == want and any(want.values())


def test_counters_add_up_over_triggers(spark, run, batch):
    counters = IngestCounters()
    spark.streams.addListener(counters)
    flags = ("pii_masked", "consent_denied", "identity_linked", "identity_resolved")

    def judged(stream):
        outcome = F.when(F.col("event_type") == "click", "duplicate").otherwise("accepted")
        no = {name: F.lit(False) for name in flags}
        none = F.array().cast("array<string>")
        return observe_stream(stream.withColumns({"outcome": outcome, "violations": none, **no})).select("seq")

    run(judged)
    clicks = batch.where("event_type = 'click'").count()
    for _ in range(50):
        if counters.totals["accepted"] + counters.totals["duplicate"] == 241:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    assert (counters.totals["duplicate"], counters.totals["accepted"]) == (clicks, 241 - clicks)


def through_bucket(instants, per_second, tokens, at):
    """[(ms, n)] one by one: (granted, tokens left)."""
    granted = []
    for ms, n in instants:
        tokens = min(per_second * 1000, tokens + max(0, ms - at) * per_second)
        at = max(at, ms)
        granted.append(min(n, tokens // 1000))
        tokens -= 1000 * granted[-1]
    return granted, tokens


@pytest.mark.parametrize("per_second", [1, 3, 7, 125, 700, 1000, 10_000])
def test_steps_of_a_slice(per_second):
    """What a slice does to a bucket, for any bucket."""
    rng = random.Random(per_second)
    for _ in range(30):
        ms, instants = 0, []
        for _ in range(rng.randrange(1, 40)):
            ms += rng.choice([1, 2, 5, 30, 333, 900])
            instants.append((ms, rng.choice([1, 1, 2, per_second // 2 + 1, 3 * per_second])))
        steps, before = SliceSteps(per_second), instants[0][0]
        for ms, n in instants:
            steps.add(ms - before, n)
            before = ms
        unit = math.gcd(per_second, 1000)
        for tokens in {0, per_second * 1000, *(rng.randrange(per_second * 1000 // unit + 1) * unit for _ in range(50))}:
            want = through_bucket(instants, per_second, tokens, instants[0][0])[1]
            assert SliceSteps.left(steps.pack(), per_second, tokens) == want


def test_one_busy_client(spark, tmp_path):
    """A million instants of one client in two batches, the second partly late: the same
    as one by one, and no task goes through more than a slice of it at a time."""
    streaming_session(spark)
    cfg, n = CFG.with_(max_requests_per_second=700), 1_000_000
    base = 1_700_000_000_000

    def batch(since, until, shift):
        ms = F.lit(base) + F.col("id") + F.floor(F.col("id") / 50_000) * 700 - shift
        return spark.range(since, until, numPartitions=8).select(
            F.lit("busy").alias("app_code"), F.timestamp_millis(ms).alias("timestamp"), F.lpad(F.col("id").cast("string"), 9, "0").alias("event_id"), F.col("id").alias("seq")
        )

    out = str(tmp_path / "rows")
    run = rate_batches(str(tmp_path / "state"), batches_to_parquet(out), cfg)
    parts = [(0, 600_000, 0), (600_000, n, 20_000)]
    for number, part in enumerate(parts):
        run(batch(*part), number)
    instants = [(base + k + k // 50_000 * 700 - shift, 1) for since, until, shift in parts for k in range(since, until)]
    granted, _ = through_bucket(instants, 700, 700_000, instants[0][0])
    got = spark.read.schema("seq long, over_limit boolean, batch int").parquet(out)
    assert got.count() == n
    assert got.where("not over_limit").count() == sum(granted)
    over = {r.seq for r in got.where("over_limit and seq % 97 = 0").collect()}
    assert over == {k for k in range(0, n, 97) if not granted[k]}
    assert SLICE_MS < 20_000


def test_buckets_of_slices():
    """A bucket passes from slice to slice, full after a second without requests."""
    steps = SliceSteps(2)
    for _ in range(3):
        steps.add(100, 1)
    rows = [("a", -1, 0, 0, 300, None), ("a", 0, 400, 500, -1, steps.pack()), ("a", 1, 900, 950, -1, None), ("a", 5, 9_000, 9_000, -1, None), ("b", 0, 5, 5, -1, None)]
    assert list(thread_slices(iter(rows), 2)) == [("a", 0, 0, 300), ("a", 1, 500, 700), ("a", 5, 950, 2_000), ("b", 0, 5, 2_000)]
    served = [("a", 0, 0, -1, 300), ("a", 0, 400, 1, -1), ("a", 0, 500, 1, -1)]
    assert list(serve_instants(iter(served), 2)) == [("a", 0, 400, 1, -1), ("a", 0, 500, 0, -1), ("a", 0, 500, -1, 300)]


def in_triggers(spark, df, path, parts, operator, cfg):
    """The operator over a stream that gets the parts one trigger after the other."""
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(f"{path}/topic")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/topic")
        with timers_by_clock(spark):
            out = to_parquet(operator(stream, cfg), f"{path}/rows", f"{path}/checkpoint")
    return out


def test_keyed_identity_knows_the_link_of_a_late_event(spark, tmp_path, batch):
    """First all links, then events that are late for most of them; rows without a visitor
    or a time, and a link that ran out."""
    odd = [
        ("x1", "click", None, None, 900, T0), ("x2", "click", None, "a1", 901, None), ("x3", "click", "u9", "b", 902, T0),
        ("x4", "click", None, "b", 903, T0 + 90 * 86_400_000 - 1), ("x5", "click", None, "b", 904, T0 + 90 * 86_400_000),
        ("x6", "click", "u8", "b", 899, T0), ("x7", "click", None, "b", 901, T0),
    ]
    more = spark.createDataFrame(odd, "event_id string, event_type string, user_id string, anonymous_id string, seq long, ms long")
    more = more.withColumn("timestamp", F.timestamp_millis("ms")).drop("ms")
    df = batch.select(*more.columns).unionByName(more)
    linked = F.col("user_id").isNotNull()
    got = in_triggers(spark, df, str(tmp_path), (linked, ~linked), identity_keyed, CFG)
    want = resolve_identity(df.where("timestamp is not null"), CFG)
    columns = ["seq", "event_id", "user_id", "identity_linked", "identity_resolved"]
    assert rows(got.where("timestamp is not null").select(columns)) == rows(want.select(columns))
    assert got.where("timestamp is null").select("user_id", "identity_resolved").collect() == [(None, False)]
    users = {r.event_id: r.user_id for r in got.where("seq > 898").collect()}
    assert (users["x4"], users["x5"], users["x7"]) == ("u9", None, "u8")


def test_keyed_sweep_withdraws_what_late_events_join(spark, tmp_path, batch):
    thirds = [F.col("seq") % 3 == k for k in (1, 2, 0)]
    sent = in_triggers(spark, batch, str(tmp_path), thirds, sweep_stream, CFG)
    assert rows(last_versions(sent)) == rows(session_rows(batch, CFG))
    assert sent.where("withdrawn").count() > 0 and sent.where("version > 1 and not withdrawn").count() > 0


def test_keyed_sweep_keeps_open_sessions_and_forgets(spark, tmp_path):
    """A session that may go on is not sent; one that was forgotten is a new one."""
    at = F.current_timestamp() - F.expr("interval 40 minutes")
    df = spark.range(4).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.lit("click").alias("event_type"), F.lit("app").alias("app_code"),
        F.when(F.col("id") < 2, F.lit("old")).otherwise(F.lit("new")).alias("anonymous_id"), F.lit(0).alias("scroll_depth"),
        F.when(F.col("id") < 2, at).otherwise(F.current_timestamp()).alias("timestamp"), F.col("id").alias("seq"),
    )
    df.write.parquet(str(tmp_path / "all"))
    df = spark.read.parquet(str(tmp_path / "all"))
    parts = (F.col("seq").isin(0, 2), F.col("seq").isin(1, 3))
    sent = in_triggers(spark, df, str(tmp_path / "kept"), parts, sweep_stream, CFG)
    assert [(r.anonymous_id, r.clicks) for r in last_versions(sent).collect()] == [("old", 2)]
    sent = in_triggers(spark, df, str(tmp_path / "gone"), parts, sweep_stream, CFG.with_(session_keep_s=-3600))
    assert [(r.anonymous_id, r.clicks) for r in sent.orderBy("version").collect()] == [("old", 1), ("old", 1)]


class _Value:
    """A value of the state store that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class _Handle:
    """What one key sees of the state store."""

    def __init__(self):
        self.state, self.timers = _Value(), set()

    def getValueState(self, *_):
        return self.state

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Clock(SimpleNamespace):
    def getCurrentProcessingTimeInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_keyed_sweep_reads_a_key_once_for_all_its_sessions():
    """However many sessions a key has, one timer sends all that are due."""
    hour, n = 3_600_000, 300
    sweep, handle = SessionTimers(1_800, 86_400), _Handle()
    sweep.init(handle)
    named = {name: None for name in OPENING} | {"seq": 0, "_kind": "click", "_scroll": None, "_seen": False}
    events = [named | {"_at": k * hour * 1000} for k in range(n)]
    now = _Clock(ms=(n + 1) * hour)
    assert list(sweep.handleInputRows(("app", "a"), iter(events), now)) == []
    (timer,) = handle.timers
    assert timer == hour // 2
    sent = list(sweep.handleExpiredTimer(("app", "a"), now, _Clock(ms=timer)))
    handle.timers.remove(timer)  # as Spark does with a timer that has come
    assert [(r._start, r.clicks, r.version) for r in sent] == [(k * hour * 1000, 1, k + 1) for k in range(n)]
    assert handle.state.calls == 3 and len(handle.timers) == 1
    joining = [named | {"_at": hour * 500}]
    gone = list(sweep.handleInputRows(("app", "a"), iter(joining), now))
    assert [(r._start, r.version, r.withdrawn) for r in gone] == [(hour * 1000, n + 1, True)]
