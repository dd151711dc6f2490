from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.operators.dedup import accepted_ids, anti_processed, anti_seen, drop_duplicates, mark_duplicates

CFG = EngineConfig()
BASE = 1_700_000_000


def events(spark, rows):
    """(id, seconds, seq) to events."""
    df = spark.createDataFrame(rows, "event_id string, s double, seq long")
    return df.withColumn("timestamp", F.timestamp_millis(F.lit(BASE * 1000) + F.round(F.col("s") * 1000).cast("long")))


def fold(rows, window_s):
    """What must be kept, told in ten lines."""
    kept, last = [], {}
    for event_id, s, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        ms = round(s * 1000)
        if not event_id:
            kept.append(seq)
        elif event_id not in last or ms - last[event_id] >= window_s * 1000:
            last[event_id] = ms
            kept.append(seq)
    return sorted(kept)


def kept(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_window_runs_from_the_accepted_copy(spark):
    rows = [("e", float(s), i) for i, s in enumerate((0, 100, 299, 301, 400, 700))]
    assert kept(drop_duplicates(events(spark, rows), CFG)) == [0, 3, 5]


def test_missing_ids_are_never_duplicates(spark):
    rows = [(None, 0.0, 0), (None, 0.0, 1), ("", 0.0, 2), ("", 1.0, 3), ("a", 0.0, 4)]
    assert kept(drop_duplicates(events(spark, rows), CFG)) == [0, 1, 2, 3, 4]


def test_equal_times_keep_the_lowest_seq(spark):
    rows = [("a", 5.0, 9), ("a", 5.0, 3), ("a", 5.0, 4)]
    assert kept(drop_duplicates(events(spark, rows), CFG)) == [3]


def test_rows_without_a_slot_neither_block_nor_fall(spark):
    rows = [("a", 0.0, 0), ("a", 10.0, 1), ("a", 20.0, 2)]
    marked = mark_duplicates(events(spark, rows), CFG, slot=F.col("seq") > 0)
    assert {r.seq: r.is_duplicate for r in marked.collect()} == {0: False, 1: False, 2: True}


@pytest.mark.parametrize("fold_limit", [1_000, 1])
def test_long_lived_ids_match_the_fold(spark, fold_limit):
    rng = random.Random(7)
    rows, seq = [], 0
    for number in range(12):
        t = rng.uniform(0, 4_000)
        for _ in range(rng.choice((1, 2, 40, 200))):
            # dense stretches, gaps around the window and long pauses over block borders
            t += rng.choice((0.0, 0.5, 17.0, 120.0, 299.999, 300.0, 300.001, 1_000.0, 9_000.0))
            rows.append((f"id{number}", round(t, 3), seq))
            seq += 1
    got = kept(drop_duplicates(events(spark, rows), CFG, fold_limit=fold_limit))
    assert got == fold(rows, 300)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", ""]), st.integers(0, 5_000)), min_size=1, max_size=40))
def test_any_history_matches_the_fold(spark, history):
    rows = [(event_id, float(s), i) for i, (event_id, s) in enumerate(history)]
    assert kept(drop_duplicates(events(spark, rows), CFG, fold_limit=3)) == fold(rows, 300)


def test_one_id_with_a_third_of_the_rows(spark):
    rows = [("0", i * 0.25, i) for i in range(3_000)] + [(f"x{i}", float(i), 10_000 + i) for i in range(6_000)]
    got = kept(drop_duplicates(events(spark, rows), CFG, fold_limit=100))
    assert got == fold(rows, 300)


def test_seen_ids_block_for_the_window(spark):
    seen = events(spark, [("a", 0.0, 0), ("a", 50.0, 1), ("b", 0.0, 2)])
    rows = [("a", 300.0, 10), ("a", 350.0, 11), ("b", 299.9, 12), ("c", 0.0, 13), (None, 0.0, 14), ("", 0.0, 15)]
    # late copies: blocked within the window before an accepted one, free further back
    rows += [("b", -299.9, 16), ("b", -300.0, 17), ("b", 599.9, 18)]
    got = anti_seen(events(spark, rows), accepted_ids(seen), CFG)
    assert kept(got) == [11, 13, 14, 15, 17, 18]


def test_only_seen_ids_that_come_again_are_spread(spark, monkeypatch):
    written = {}

    def counted(df, name="step"):
        written[name] = df.count()
        return df

    monkeypatch.setattr("eventloom.operators.dedup.write_through", counted)
    seen = accepted_ids(events(spark, [(f"s{i}", 0.0, i) for i in range(200)] + [("a", 0.0, 300)]))
    rows = [("a", 10.0, 0), ("a", 400.0, 1), ("b", 0.0, 2), (None, 0.0, 3)]
    assert kept(drop_duplicates(events(spark, rows), CFG, seen=seen)) == [1, 2, 3]
    assert written["anchors"] == 3


def test_a_first_batch_is_not_checked_against_nothing(spark, monkeypatch):
    written = []
    monkeypatch.setattr("eventloom.operators.dedup.write_through", lambda df, name="step": written.append(name) or df)
    seen = accepted_ids(events(spark, [("a", 0.0, 0)])).limit(0)
    rows = [("a", 10.0, 0), ("a", 11.0, 1), ("b", 0.0, 2)]
    assert kept(drop_duplicates(events(spark, rows), CFG, seen=seen)) == [0, 2]
    assert "anchors" not in written


def test_blocked_copies_open_no_window(spark):
    seen = accepted_ids(events(spark, [("a", 0.0, 0)]))
    rows = [("a", 200.0, 1), ("a", 310.0, 2), ("a", 320.0, 3), ("", 0.0, 4)]
    marked = mark_duplicates(events(spark, rows), CFG, seen=seen)
    assert {r.seq: r.is_duplicate for r in marked.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_processed_means_present_in_the_events_table(spark):
    table = events(spark, [("a", 0.0, 0), ("a", 1.0, 1)])
    entries = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", None)], "reason string, event_id string")
    got = {r.event_id: r.processed for r in anti_processed(entries, table).collect()}
    assert got == {"a": True, "b": False, None: False}
