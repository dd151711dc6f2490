from __future__ import annotations

import random

from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.operators.collapse import replace_latest
from eventloom.operators.rollups import (
    daily_partials,
    events_hourly,
    hourly_partials,
    merge_daily,
    merge_hourly,
    sessions_daily,
)
from eventloom.operators.sessions import (
    attach_sessions,
    fold_open_sessions,
    open_sessions,
    session_rows,
    session_sink_defaults,
    split_live,
    visits,
)
from eventloom.plans.finalize import read_daily, sweep_sessions, swept_batches, upkeep_daily
from eventloom.sources.tables import compact_events, read_events, read_sessions, write_events
from eventloom.workspace import write_through

CFG = EngineConfig()
SCHEMA = (
    "event_id string, event_type string, user_id string, anonymous_id string, app_code string, session_id string,"
    " page_url string, scroll_depth int, s double, seq long"
)


def event(seq, s, kind="page_view", anon="a", user=None, app="app", session=None, url="/p", depth=None):
    return (f"e{seq}", kind, user, anon, app, session, url, depth, float(s), seq)


def events(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("timestamp", F.timestamp_millis(F.lit(1_700_000_000_000) + F.round(F.col("s") * 1000).cast("long")))


def test_a_gap_of_exactly_the_timeout_does_not_split(spark):
    rows = session_rows(events(spark, [event(0, 0), event(1, 1800), event(2, 3600.001)]), CFG).orderBy("start_time")
    assert [(r.page_views, r.duration) for r in rows.collect()] == [(2, 1_800_000), (1, 0)]


def test_counters_pages_and_scroll(spark):
    rows = [
        event(0, 0, "custom", url="/home"),
        event(1, 10, "page_view", url="/p"),
        event(2, 20, "click", url="/q"),
        event(3, 30, "scroll", depth=30),
        event(4, 40, "scroll", depth=10),
        event(5, 50, "exposure", depth=99),
        event(6, 60, "page_view", url=None),
        event(7, 70, "custom", url="/last"),
    ]
    (row,) = session_rows(events(spark, rows), CFG).collect()
    assert (row.page_views, row.clicks, row.exposures, row.scroll_depth_max) == (2, 1, 1, 30)
    assert (row.first_page_url, row.last_page_url, row.duration, row.platform) == ("/home", "/p", 70_000, "web")
    assert row.session_id.startswith("sess_") and len(row.session_id) == 37


def test_bounce(spark):
    rows = [event(0, 0, url="/home", anon="short"), event(1, 2, "click", anon="short")]
    rows += [event(2, 0, anon="long"), event(3, 10, "click", anon="long")]
    rows += [event(4 + i, i, anon="many") for i in range(3)]
    got = {r.anonymous_id: (r.is_bounce, r.bounce_page) for r in session_rows(events(spark, rows), CFG).collect()}
    assert got == {"short": (1, "/home"), "long": (0, None), "many": (0, None)}


def test_login_does_not_split_and_opening_event_names_the_user(spark):
    rows = [event(0, 0), event(1, 10, user="u1"), event(2, 20, user="u1")]
    (row,) = session_rows(events(spark, rows), CFG).collect()
    assert (row.user_id, row.anonymous_id, row.page_views) == (None, "a", 3)


def test_keys_client_session_app_and_none(spark):
    rows = [
        event(0, 0, session="s1"), event(1, 1, session="s2"), event(2, 2, session="s1", app="other"),
        event(3, 3, anon=None, user="u"), event(4, 4, anon=None, user="u"),
        event(5, 5, anon=None), event(6, 6, anon=None),
    ]
    assert session_rows(events(spark, rows), CFG).count() == 6


def plain_sessions(rows, timeout):
    """Sessions per visitor by a plain walk."""
    out = {}
    for key, ms in sorted((r[3], round(r[8] * 1000)) for r in rows):
        runs = out.setdefault(key, [])
        if not runs or ms - runs[-1][1] > timeout * 1000:
            runs.append([ms, ms, 0])
        runs[-1][1] = ms
        runs[-1][2] += 1
    return sorted((key, end - start, n) for key, runs in out.items() for start, end, n in runs)


def test_random_histories_match_a_plain_walk(spark):
    rng = random.Random(11)
    rows, seq = [], 0
    for visitor in range(15):
        t = rng.uniform(0, 9_000)
        for _ in range(80):
            t += rng.choice((0.0, 1.0, 600.0, 1_799.999, 1_800.0, 1_800.001, 5_000.0))
            rows.append(event(seq, round(t, 3), anon=f"v{visitor if visitor > 4 else 0}"))
            seq += 1
    df = events(spark, rows)
    sessions = session_rows(df, CFG)
    got = sorted((r.anonymous_id, r.duration, r.page_views) for r in sessions.collect())
    assert got == plain_sessions(rows, 1_800)
    attached = attach_sessions(df, CFG).groupBy("session_id").agg(F.count("*").alias("n"))
    by_event = {r.session_id: r.n for r in attached.collect()}
    assert by_event == {r.session_id: r.page_views for r in sessions.collect()}


def test_live_and_due(spark):
    rows = session_rows(events(spark, [event(0, 0, anon="old"), event(1, 200, anon="new")]), CFG)
    due, live = split_live(rows, CFG, F.timestamp_seconds(F.lit(1_700_000_000 + 1_800)))
    assert [r.anonymous_id for r in due.collect()] == ["old"]
    assert [r.anonymous_id for r in live.collect()] == ["new"]


def test_replace_latest(spark):
    versions = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("l", 1, None)], "k string, v int, x string")
    assert sorted(map(tuple, replace_latest(versions, ["k"], ["v"]).collect())) == [("k", 3, "c"), ("l", 1, None)]


def test_open_sessions_go_on_in_the_next_batch(spark):
    """However a history is cut into batches, visits get the ids of one batch."""
    rng = random.Random(4)
    rows = [event(seq, rng.randrange(40_000), anon=f"v{seq % 7}") for seq in range(300)]
    df = events(spark, rows).cache()
    want = {r.seq: r.session_id for r in attach_sessions(df, CFG).collect()}
    now = F.timestamp_seconds(F.lit(1_700_100_000))
    ordered = [r.seq for r in df.orderBy("timestamp", "seq").collect()]
    stored, got = None, {}
    for part in (ordered[:100], ordered[100:101], ordered[101:]):
        batch = df.where(F.col("seq").isin(part))
        spans = write_through(visits(batch, CFG, stored=stored), "visits")
        got |= {r.seq: r.session_id for r in attach_sessions(batch, CFG, spans=spans).collect()}
        new = open_sessions(spans, now)
        both = new if stored is None else stored.unionByName(new)
        stored = write_through(fold_open_sessions(both, CFG, now), "open")
    assert got == want
    # a late event joins the visit it lies in; nothing is remembered for ever
    late = events(spark, [event(999, 5, anon="v0")])
    spans = visits(late, CFG, stored=stored)
    near = min(abs(s - 5) for s in (r[8] for r in rows if r[3] == "v0"))
    assert near > 1_800 or attach_sessions(late, CFG, spans=spans).first().session_id in set(want.values())
    assert fold_open_sessions(stored, CFG, F.timestamp_seconds(F.lit(1_700_200_000))).count() == 0


def test_sweeps_read_what_is_new(spark, tmp_path):
    path = str(tmp_path)
    tables = f"{path}/events", f"{path}/sessions", f"{path}/state"

    def later(seconds):
        return F.timestamp_seconds(F.lit(1_700_000_000 + seconds))

    def add(batch, *rows):
        write_events(events(spark, list(rows)).withColumn("session_id", F.col("anonymous_id")), tables[0], later(0), batch)

    def sessions():
        return {r.session_id: (r.page_views, r.duration) for r in read_sessions(spark, tables[1]).collect()}

    add("a", event(0, 0, anon="s1"), event(1, 100, anon="s1"), event(2, 2_000, anon="s2"))
    assert sweep_sessions(spark, *tables, CFG, later(2_100)).count() == 1
    assert sessions() == {"s1": (2, 100_000)}
    assert sweep_sessions(spark, *tables, CFG, later(2_200)).count() == 0
    # s2 goes on, and a late event changes the finished s1
    add("b", event(3, 2_500, anon="s2"), event(4, 50, anon="s1"))
    assert sweep_sessions(spark, *tables, CFG, later(5_000)).count() == 2
    assert sessions() == {"s1": (3, 100_000), "s2": (2, 500_000)}
    # a compacted table gives nothing new
    compact_events(spark, tables[0], "2023-11-14", "2023-11-14", 2, swept_batches(spark, tables[2]))
    assert read_events(spark, tables[0]).count() == 5
    assert sweep_sessions(spark, *tables, CFG, later(9_000)).count() == 0
    assert sessions() == {"s1": (3, 100_000), "s2": (2, 500_000)}


def test_moved_sessions_and_their_rollup(spark, tmp_path):
    """A late event moves a session to the day before: each day can be read by itself, and
    the rollup takes the old row back, the largest scroll depth included."""
    path = str(tmp_path)
    tables = f"{path}/events", f"{path}/sessions", f"{path}/state"
    daily = f"{path}/daily"

    def later(seconds):
        return F.timestamp_seconds(F.lit(1_700_000_000 + seconds))

    def add(batch, *rows):
        write_events(events(spark, list(rows)), tables[0], later(0), batch)

    def ids(since, until):
        return sorted(r.session_id for r in read_sessions(spark, tables[1], since, until).collect())

    def rollup(first="", last="9999-12-31"):
        rows = read_daily(spark, daily, first, last).collect()
        return sorted((str(r.date)[8:], r.anonymous_id, r.session_count, r.total_page_views, r.max_scroll_depth) for r in rows)

    add(
        "a", event(0, 0, anon="v", session="s1"), event(1, 10, "scroll", anon="v", session="s1", depth=90),
        event(2, 20, "scroll", anon="v", session="s2", depth=30), event(3, -200_000, anon="v", session="s0"),
    )
    sweep_sessions(spark, *tables, CFG, later(5_000))
    assert upkeep_daily(spark, tables[1], tables[2], daily) == ["2023-11-12", "2023-11-14"]
    assert upkeep_daily(spark, tables[1], tables[2], daily) == []
    assert rollup() == [("12", "v", 1, 1, 0), ("14", "v", 2, 1, 90)]
    add("b", event(4, -90_000, anon="v", session="s1"))
    sweep_sessions(spark, *tables, CFG, later(6_000))
    assert ids("2023-11-14", "2023-11-15") == ["s2"] and ids("2023-11-13", "2023-11-14") == ["s1"]
    assert ids(None, None) == ["s0", "s1", "s2"]
    plan = read_sessions(spark, tables[1], "2023-11-13", "2023-11-14")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(start_date" in plan
    assert upkeep_daily(spark, tables[1], tables[2], daily) == ["2023-11-13", "2023-11-14"]
    assert rollup() == [("12", "v", 1, 1, 0), ("13", "v", 1, 2, 90), ("14", "v", 1, 0, 30)]
    assert rollup("2023-11-13", "2023-11-13") == [("13", "v", 1, 2, 90)]
    # the other session leaves the day too; two sweeps are taken up at once
    add("c", event(5, -90_000, anon="v", session="s2"))
    sweep_sessions(spark, *tables, CFG, later(7_000))
    sweep_sessions(spark, *tables, CFG, later(8_000))
    assert upkeep_daily(spark, tables[1], tables[2], daily) == ["2023-11-13", "2023-11-14"]
    assert rollup() == [("12", "v", 1, 1, 0), ("13", "v", 2, 3, 90)]
    whole = sessions_daily(read_sessions(spark, tables[1])).select(read_daily(spark, daily).columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, read_daily(spark, daily).collect()))


def test_sink_defaults(spark):
    (row,) = session_sink_defaults(session_rows(events(spark, [event(0, 0.75, anon=None, user="u")]), CFG)).collect()
    assert (row.anonymous_id, row.utm_source, row.device_type) == ("", "", "")
    assert row.start_time.microsecond == 0


def test_rollups_merge_to_the_same_rows(spark):
    rows = [event(i, i * 37, "page_view" if i % 2 else "click", anon=f"v{i % 4}") for i in range(200)]
    df = events(spark, rows).withColumns(
        {"spmb": F.lit("b"), "spmd": F.lit(None).cast("string"), "stay_duration": F.when(F.col("seq") % 3 != 0, F.col("seq"))}
    )
    whole = sorted(map(tuple, events_hourly(df).collect()), key=str)
    parts = hourly_partials(df.where("seq < 77")).unionByName(hourly_partials(df.where("seq >= 77")))
    assert sorted(map(tuple, merge_hourly(parts).collect()), key=str) == whole
    sessions = session_rows(df, CFG)
    whole = sorted(map(tuple, sessions_daily(sessions).collect()), key=str)
    parts = daily_partials(sessions.where("clicks % 2 = 0")).unionByName(daily_partials(sessions.where("clicks % 2 = 1")))
    assert sorted(map(tuple, merge_daily(parts).collect()), key=str) == whole


def test_hourly_mean_skips_nulls(spark):
    df = events(spark, [event(0, 0), event(1, 1), event(2, 2)]).withColumns(
        {"spmb": F.lit(""), "spmd": F.lit(""), "stay_duration": F.when(F.col("seq") > 0, F.col("seq") * 10)}
    )
    (row,) = events_hourly(df.withColumn("event_id", F.lit("x"))).collect()
    assert (row.event_count, row.page_view_count, row.avg_stay_duration) == (3, 3, 15.0)
