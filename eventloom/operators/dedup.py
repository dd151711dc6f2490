"""Removal of retransmissions.

An accepted event blocks further copies of its id for the window, counted from the
accepted copy and not renewed by blocked ones. So the copies of an id are walked in
time order: keep one, skip to the first copy at least a window later, and so on.

Only (id, time, seq) is shuffled, to find the copies that fall. They are usually few;
the events are then checked against them by one join on (id, time, seq), which is
unique, so that no id is heavy in it. ``seq`` numbers the rows: it breaks ties and must
be unique among the copies of an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.text import is_set
from eventloom.operators.skew import lookup_join
from eventloom.workspace import ship_package, write_through

# Ids with at most this many copies are folded as one array in one expression; more
# would be an array without bound, so others go block by block.
FOLD_LIMIT = 1_000
# A block of an id holds at most this many windows, so at most as many distinct
# instants as it has milliseconds.
WINDOWS_PER_BLOCK = 12
_FREE = -(2**62)


def mark_duplicates(
    events: DataFrame,
    cfg: EngineConfig,
    slot: Column | None = None,
    ts: str = "timestamp",
    seq: str = "seq",
    fold_limit: int = FOLD_LIMIT,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Add ``is_duplicate``.

    Rows without an id, and rows for which ``slot`` is false, neither are duplicates
    nor block others. ``seen`` (event_id, anchor_ts) are copies accepted earlier: what
    they block falls first and opens no window. The events are read twice; give written
    ones.
    """
    takes = is_set("event_id") & F.coalesce(slot if slot is not None else F.lit(True), F.lit(False))
    marked = events.withColumns({"_ms": F.unix_millis(F.col(ts)), "_seq": F.col(seq).cast("long")})
    copies = marked.where(takes).select("event_id", "_ms", "_seq")
    fallen = []
    # a first batch has nothing to be checked against
    if seen is not None and not seen.isEmpty():
        copies = write_through(_blocked(copies, seen, cfg), "copies")
        fallen.append(copies.where("_blocked").drop("_blocked"))
        copies = copies.where("not _blocked").drop("_blocked")
    repeats = fallen_copies(copies, cfg, fold_limit)
    if repeats is not None:
        fallen.append(repeats)
    if not fallen:
        return marked.withColumn("is_duplicate", F.lit(False)).drop("_ms", "_seq")
    both = fallen[0] if len(fallen) == 1 else fallen[0].unionByName(fallen[1])
    verdicts = both.withColumn("_fell", F.lit(True))
    checked = lookup_join(marked.withColumn("_takes", takes), verdicts, ["event_id", "_ms", "_seq"])
    fell = F.col("_takes") & F.col("_fell").isNotNull()
    return checked.withColumn("is_duplicate", fell).drop("_ms", "_seq", "_takes", "_fell")


def drop_duplicates(events: DataFrame, cfg: EngineConfig, **options) -> DataFrame:
    return mark_duplicates(events, cfg, **options).where(~F.col("is_duplicate")).drop("is_duplicate")


def fallen_copies(copies: DataFrame, cfg: EngineConfig, fold_limit: int = FOLD_LIMIT) -> DataFrame | None:
    """(event_id, _ms, _seq) of the copies that the rule drops; None if no id repeats."""
    window_ms = cfg.dedup_window_s * 1000
    # a plain aggregate: a heavy id is reduced to one row per task before the shuffle
    repeated = write_through(
        copies.groupBy("event_id")
        .agg(
            F.count("*").alias("_n"),
            F.min(F.struct("_ms", "_seq")).alias("_first"),
            F.max("_ms").alias("_last"),
        )
        .where(F.col("_n") > 1),
        "repeated",
    )
    lives_long = F.col("_last") - F.col("_first._ms") >= window_ms
    many = F.col("_n") > fold_limit
    found = repeated.agg(
        F.count("*").alias("ids"),
        F.count_if(lives_long & ~many).alias("short"),
        F.count_if(lives_long & many).alias("heavy"),
    ).first()
    if not found["ids"]:
        return None
    again = lookup_join(copies, repeated, ["event_id"], "inner", written=True)
    # all copies within one window: the first stays
    quick = again.where(~lives_long & (F.struct("_ms", "_seq") != F.col("_first")))
    parts = [quick.select("event_id", "_ms", "_seq")]
    if not (found["short"] or found["heavy"]):
        return parts[0]
    slow = write_through(again.where(lives_long).select("event_id", many.alias("_many"), "_ms", "_seq"), "copies")
    instants = slow.groupBy("event_id", "_many", "_ms").agg(F.min("_seq").alias("_seq"))
    kept = []
    if found["short"]:
        kept.append(_fold(instants.where(~F.col("_many")), window_ms))
    if found["heavy"]:
        block_ms = window_ms * WINDOWS_PER_BLOCK
        block = F.floor(F.col("_ms") / F.lit(block_ms)).cast("long")
        heavy = instants.where("_many").select("event_id", block.alias("_block"), "_ms", "_seq")
        kept.append(_walk(write_through(heavy, "instants"), window_ms, block_ms))
    stays = kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])
    key = ["event_id", "_ms", "_seq"]
    parts.append(slow.select(*key).join(write_through(stays, "kept"), key, "left_anti"))
    return parts[0].unionByName(parts[1])


def _fold(instants: DataFrame, window_ms: int) -> DataFrame:
    """Ids with a bounded number of instants: one sorted array per id."""
    walk = F.aggregate(
        "_all",
        F.array().cast("array<struct<_ms:bigint,_seq:bigint>>"),
        lambda kept, x: F.when(
            (F.size(kept) == 0) | (x["_ms"] - F.element_at(kept, -1)["_ms"] >= window_ms),
            F.concat(kept, F.array(x)),
        ).otherwise(kept),
    )
    return (
        instants.groupBy("event_id")
        .agg(F.sort_array(F.collect_list(F.struct("_ms", "_seq"))).alias("_all"))
        .select("event_id", F.explode(walk).alias("_kept"))
        .select("event_id", "_kept._ms", "_kept._seq")
    )


def _walk(instants: DataFrame, window_ms: int, block_ms: int) -> DataFrame:
    """Ids with any number of instants, block by block.

    1. Each block computes, in parallel, where the walk leaves it for every instant
       at which it may have stood before (the last window of the block before).
    2. A short pass per id threads the real walk through these answers.
    3. Each block walks again from its now known start.
    """
    ship_package(instants.sparkSession)
    own = instants.withColumn("_own", F.lit(True))
    into_next = F.pmod(F.col("_ms"), F.lit(block_ms)) >= block_ms - window_ms
    entering = instants.where(into_next).withColumn("_block", F.col("_block") + 1).withColumn("_own", F.lit(False))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ms")
        own_ms = pdf.loc[pdf["_own"], "_ms"].to_numpy()
        starts = pdf.loc[~pdf["_own"], "_ms"].to_numpy()
        last = _last_kept(own_ms, window_ms)
        enter = np.concatenate(([_FREE], starts))
        first = np.searchsorted(own_ms, np.concatenate(([_FREE], starts + window_ms)))
        leave = np.where(first < len(own_ms), last[np.minimum(first, len(own_ms) - 1)], _FREE) if len(own_ms) else (
            np.full(len(enter), _FREE)
        )
        new = np.ones(len(enter), dtype=bool)
        new[2:] = leave[2:] != leave[1:-1]  # equal neighbours share one row; the free start keeps its own
        return pd.DataFrame(
            {
                "event_id": pdf["event_id"].iloc[0],
                "_block": pdf["_block"].iloc[0],
                "_enter": enter[new],
                "_leave": leave[new],
            }
        )

    moves = own.unionByName(entering).groupBy("event_id", "_block").applyInPandas(
        exits, "event_id string, _block long, _enter long, _leave long"
    )

    def thread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here: tuple[str, int] | None = None
        stand = leave = _FREE
        for pdf in batches:
            out = []
            for event_id, block, enter, exit_ in zip(pdf["event_id"], pdf["_block"], pdf["_enter"], pdf["_leave"]):
                if (event_id, block) != here:
                    follows = here == (event_id, block - 1)
                    stand = leave if follows and leave > block * block_ms - window_ms else _FREE
                    here, leave = (event_id, block), _FREE
                    out.append((event_id, block, stand))
                if enter <= stand:  # rows come in order of enter; the last that fits holds
                    leave = exit_
            yield pd.DataFrame(out, columns=["event_id", "_block", "_stand"])

    stands = (
        moves.repartition("event_id")
        .sortWithinPartitions("event_id", "_block", "_enter")
        .mapInPandas(thread, "event_id string, _block long, _stand long")
    )

    def walk(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ms")
        ms = pdf["_ms"].to_numpy()
        kept = []
        at = int(np.searchsorted(ms, start["_stand"].iloc[0] + window_ms)) if len(start) and len(ms) else 0
        while at < len(ms):
            kept.append(at)
            at = int(np.searchsorted(ms, ms[at] + window_ms))
        return pdf.iloc[kept][["event_id", "_ms", "_seq"]]

    return (
        instants.groupBy("event_id", "_block")
        .cogroup(stands.groupBy("event_id", "_block"))
        .applyInPandas(walk, "event_id string, _ms long, _seq long")
    )


def _last_kept(ms: np.ndarray, window_ms: int) -> np.ndarray:
    """For each instant, the last one kept in the array if this one is kept."""
    step = np.searchsorted(ms, ms + window_ms)
    ends = step >= len(ms)
    step = np.where(ends, np.arange(len(ms)), step)
    while True:
        further = step[step]
        if np.array_equal(further, step):
            return ms[step]
        step = further


def _blocked(copies: DataFrame, seen: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Copies (event_id, _ms, _seq) with ``_blocked``: less than a window away from a
    copy accepted earlier, before or after it. Late copies count like others."""
    window_ms = cfg.dedup_window_s * 1000
    anchors = seen.where(is_set("event_id")).select("event_id", F.unix_millis("anchor_ts").alias("_anchor"))
    # only of the ids that are to be checked: most ids of a state do not come again
    ids = write_through(copies.select("event_id").distinct(), "ids")
    anchors = anchors.join(ids, "event_id", "left_semi")
    span = F.floor(F.col("_anchor") / F.lit(window_ms))
    # an anchor blocks in its own span of a window's length and in the two beside it;
    # of a span's anchors the first and last are enough for the neighbours
    spans = anchors.groupBy("event_id", span.alias("_span")).agg(F.min("_anchor").alias("_from"), F.max("_anchor").alias("_to"))
    around = spans.select("event_id", "_from", "_to", F.explode(F.array(*[F.col("_span") + k for k in (-1, 0, 1)])).alias("_span"))
    near = around.groupBy("event_id", "_span").agg(
        F.array_distinct(F.flatten(F.collect_list(F.array("_from", "_to")))).alias("_anchors")
    )
    own = F.floor(F.col("_ms") / F.lit(window_ms))
    joined = copies.withColumn("_span", own).join(write_through(near, "anchors"), ["event_id", "_span"], "left")
    hit = F.exists("_anchors", lambda at: F.abs(F.col("_ms") - at) < window_ms)
    return joined.select("event_id", "_ms", "_seq", F.coalesce(hit, F.lit(False)).alias("_blocked"))


def anti_seen(
    events: DataFrame, seen: DataFrame, cfg: EngineConfig, ts: str = "timestamp", seq: str = "seq"
) -> DataFrame:
    """Drop events whose id was accepted before, less than a window away.

    ``seen`` holds (event_id, anchor_ts). Events without an id take no part in the join.
    """
    marked = events.withColumns({"_ms": F.unix_millis(F.col(ts)), "_seq": F.col(seq).cast("long")})
    named = marked.where(is_set("event_id"))
    blocked = _blocked(named.select("event_id", "_ms", "_seq"), seen, cfg).where("_blocked").drop("_blocked")
    fresh = named.join(write_through(blocked.distinct(), "blocked"), ["event_id", "_ms", "_seq"], "left_anti")
    return fresh.unionByName(marked.where(~is_set("event_id"))).drop("_ms", "_seq")


def anti_processed(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``processed``: the event of a dead-letter entry is in the events table.

    The events are reduced to the ids of the entries before anything is made distinct.
    """
    ids = write_through(entries.where(is_set("event_id")).select("event_id").distinct(), "ids")
    found = lookup_join(events.where(is_set("event_id")).select("event_id"), ids, ["event_id"], "left_semi", written=True)
    known = found.distinct().withColumn("_known", F.lit(True))
    return (
        entries.join(write_through(known, "known"), "event_id", "left")
        .withColumn("processed", F.col("_known").isNotNull())
        .drop("_known")
    )


def accepted_ids(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """(event_id, anchor_ts): the accepted copies, as ``seen`` for later batches."""
    return events.where(is_set("event_id")).select("event_id", F.col(ts).alias("anchor_ts"))
