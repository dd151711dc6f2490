from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.operators.identity import latest_link, link_rows, live_links, resolve_identity, slice_hours, upsert_links

CFG = EngineConfig()
DAY = 86_400


def events(spark, rows):
    df = spark.createDataFrame(rows, "anonymous_id string, user_id string, s long, seq long")
    return df.withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))


def users(df):
    return {r.seq: r.user_id for r in df.collect()}


def test_links_fill_later_anonymous_events(spark):
    rows = [
        ("anon1", None, 0, 0),
        ("anon1", "user9", 10, 1),
        ("anon1", None, 20, 2),
        ("anon1", "  ", 25, 3),
        ("anon1", "user10", 30, 4),
        ("anon1", None, 40, 5),
        ("anon2", None, 50, 6),
        (None, None, 60, 7),
        (" ", "user1", 70, 8),
        (" ", None, 80, 9),
    ]
    got = users(resolve_identity(events(spark, rows), CFG))
    assert got == {
        0: None, 1: "user9", 2: "user9", 3: "user9", 4: "user10",
        5: "user10", 6: None, 7: None, 8: "user1", 9: None,
    }


def test_a_link_counts_for_itself_and_by_seq_at_equal_times(spark):
    rows = [("a", None, 5, 1), ("a", "u", 5, 2), ("a", None, 5, 3)]
    assert users(resolve_identity(events(spark, rows), CFG)) == {1: None, 2: "u", 3: "u"}


def test_links_expire_and_are_renewed(spark):
    cfg = CFG.with_(identity_ttl_days=2)
    rows = [("a", "u", 0, 0), ("a", None, 2 * DAY - 1, 1), ("a", None, 2 * DAY, 2)]
    rows += [("b", "u", 0, 3), ("b", "u", DAY, 4), ("b", None, 3 * DAY - 1, 5)]
    got = users(resolve_identity(events(spark, rows), cfg))
    assert (got[1], got[2], got[5]) == ("u", None, "u")


def test_heavy_hour_is_cut(spark):
    """300 000 rows of one visitor and hour, half of them of one instant: no task orders
    more than a tenth, and what a slice inherits is right."""
    rows = spark.range(300_000).select(
        F.lit("a").alias("anonymous_id"),
        F.when(F.col("id") % 1_000 == 7, F.concat(F.lit("u"), F.col("id"))).alias("user_id"),
        F.timestamp_millis(F.lit(1_700_000_000_000) + F.least(F.col("id"), F.lit(150_000)) * 4).alias("timestamp"),
        F.col("id").alias("seq"),
    )
    light = events(spark, [("b", "v", 0, 400_000), ("b", None, 1, 400_001), ("a", None, 4_000, 400_002)])
    both = rows.unionByName(light.select(rows.columns)).repartition(8)
    lanes = both.withColumns({"_lane": F.concat(F.lit("v"), "anonymous_id"), "_hour": F.date_trunc("hour", "timestamp")})
    sizes = slice_hours(lanes, "timestamp").groupBy("_lane", "_hour", "_slice").count().collect()
    assert sum(r["count"] for r in sizes) == 300_003 and max(r["count"] for r in sizes) <= 30_000
    got = resolve_identity(both, CFG)
    link = F.when(F.col("seq") >= 7, F.concat(F.lit("u"), F.floor((F.col("seq") - 7) / 1_000) * 1_000 + 7))
    wrong = got.where("anonymous_id = 'a' and seq < 300000").where(~F.col("user_id").eqNullSafe(link))
    assert got.count() == 300_003 and wrong.count() == 0
    assert users(got.where("seq >= 400000")) == {400_000: "v", 400_001: "v", 400_002: "u299007"}


def test_disabled_and_not_allowed(spark):
    rows = [("a", "u", 0, 0), ("a", None, 1, 1)]
    assert users(resolve_identity(events(spark, rows), CFG.with_(identity_enabled=False)))[1] is None
    assert users(resolve_identity(events(spark, rows), CFG, allowed=F.col("seq") > 0))[1] is None
    flags = resolve_identity(events(spark, rows), CFG).orderBy("seq").collect()
    assert [(r.identity_linked, r.identity_resolved) for r in flags] == [(True, False), (False, True)]


def test_ttl_is_at_least_a_day():
    assert EngineConfig(identity_ttl_days=0).identity_ttl_days == 1


def plain_users(rows):
    """The rule as a walk over each visitor's events."""
    last, out = {}, {}
    for anon, user, second, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        if user:
            last[anon] = user
        out[seq] = user or last.get(anon)
    return out


@pytest.mark.parametrize("span", [7_000, 400_000])
def test_hours_inherit_the_last_link(spark, span):
    rng = random.Random(3)
    rows = []
    for seq in range(3_000):
        anon = "bot" if seq % 3 == 0 else f"v{rng.randrange(200)}"
        user = f"u{rng.randrange(5)}" if rng.random() < 0.05 else None
        rows.append((anon, user, rng.randrange(span), seq))
    assert users(resolve_identity(events(spark, rows), CFG)) == plain_users(rows)


def test_links_of_earlier_batches(spark):
    stored = spark.createDataFrame([("a", "u", 1_699_999_000)], "anonymous_id string, user_id string, s long").select(
        "anonymous_id", "user_id", F.timestamp_seconds("s").alias("linked_at")
    )
    got = resolve_identity(events(spark, [("a", None, 0, 0), ("b", None, 0, 1)]), CFG, stored=stored)
    assert users(got) == {0: "u", 1: None}
    assert "_stored" not in got.columns


def test_identity_table(spark):
    links = link_rows(events(spark, [("anon1", "user1", 0, 0), ("anon1", "user2", 5, 1), ("anon2", " ", 1, 2), (None, "x", 1, 3)]))
    table = latest_link(links)
    assert [(r.anonymous_id, r.user_id) for r in table.collect()] == [("anon1", "user2")]
    newer = link_rows(events(spark, [("anon1", "user3", 9, 7), ("anon3", "user4", 9, 8)]))
    merged = upsert_links(table, newer)
    assert {r.anonymous_id: r.user_id for r in merged.collect()} == {"anon1": "user3", "anon3": "user4"}
    late = F.timestamp_seconds(F.lit(1_700_000_009 + 90 * DAY))
    assert live_links(merged, CFG, late).count() == 0
