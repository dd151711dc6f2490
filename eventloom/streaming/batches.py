"""Stateful operators as micro-batches, for ``foreachBatch``.

Each makes a sink: it takes a batch of the stream, applies the batch operator together
with what earlier batches left behind, and hands every row on. A repeated batch starts
from the same state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import EngineConfig
from eventloom.functions.times import age_expired
from eventloom.operators.dedup import accepted_ids, mark_duplicates
from eventloom.operators.identity import latest_link, link_rows, live_links, resolve_identity
from eventloom.schemas import IDENTITY_LINKS, SEEN_IDS
from eventloom.sources.state import BatchState
from eventloom.streaming.sinks import Sink
from eventloom.workspace import dropping_scratch, ship_package, write_through


def numbered(batch: DataFrame) -> DataFrame:
    """The batch, written, with a number for every row."""
    rows = batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())
    return write_through(rows, "rows")


def dedup_batches(state: str, deliver: Sink, cfg: EngineConfig, now: Column | None = None) -> Sink:
    """Without retransmissions, by the rule of the batch operator; an accepted id blocks
    copies in later batches while it is remembered."""
    now = F.current_timestamp() if now is None else now

    def fold(rows: DataFrame) -> DataFrame:
        return rows.where(~age_expired(F.col("arrived_at"), cfg.seen_ttl_s, now))

    remembered = BatchState(state, SEEN_IDS, fold)

    def run(batch: DataFrame, batch_id: int) -> None:
        with dropping_scratch(batch.sparkSession):
            marked = mark_duplicates(numbered(batch), cfg, seen=remembered.before(batch.sparkSession, batch_id))
            kept = write_through(marked.where(~F.col("is_duplicate")).drop("is_duplicate"), "kept")
            remembered.propose(accepted_ids(kept).withColumn("arrived_at", now), batch_id)
            if deliver(kept, batch_id) is False:
                remembered.discard(batch.sparkSession, batch_id)
            else:
                remembered.confirm(batch.sparkSession, batch_id)

    return run


def identity_batches(state: str, deliver: Sink, cfg: EngineConfig, now: Column | None = None) -> Sink:
    """Events with their user; a link that comes in a later batch does not change rows
    already out."""
    now = F.current_timestamp() if now is None else now

    def fold(rows: DataFrame) -> DataFrame:
        return live_links(latest_link(rows.withColumn("seq", F.lit(0))), cfg, now)

    remembered = BatchState(state, IDENTITY_LINKS, fold)

    def run(batch: DataFrame, batch_id: int) -> None:
        with dropping_scratch(batch.sparkSession):
            rows = numbered(batch)
            deliver(resolve_identity(rows, cfg, stored=remembered.before(batch.sparkSession, batch_id)), batch_id)
            remembered.add(latest_link(link_rows(rows)), batch_id)

    return run


_BUCKET = T.StructType(
    [T.StructField("client", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("ms", T.LongType())]
)
_RANK_LANES = 1_024
#: Milliseconds of a client that one task goes through.
SLICE_MS = 16_384


def _chunks(parts: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*(part[name].to_numpy() for name in names), strict=True)


def _frames(rows: Iterator[tuple], names: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


def serve_instants(rows: Iterator[tuple], per_second: int) -> Iterator[tuple]:
    """Instants of slices, each slice after its bucket, through the bucket.

    rows: (client, slice, ms, n, tokens). n < 0: the slice begins with so many tokens at
    that time. Gives (client, slice, ms, granted, -1) per instant and, at the end of a
    slice, (client, slice, ms, -1, tokens left). Tokens are thousandths.
    """
    here, tokens, at, full = None, 0, 0, per_second * 1000
    for client, part, ms, n, left in rows:
        if n < 0:
            if here is not None:
                yield (*here, at, -1, tokens)
            here, tokens, at = (client, part), int(left), int(ms)
            continue
        if ms > at:
            tokens = min(full, tokens + (int(ms) - at) * per_second)
            at = int(ms)
        granted = min(int(n), tokens // 1000)
        tokens -= granted * 1000
        yield client, part, int(ms), granted, -1
    if here is not None:
        yield (*here, at, -1, tokens)


class SliceSteps:
    """What the instants of a slice do to any bucket they find.

    A bucket is (b, g): b thousandths of tokens supplied, g taken, so b - g are left. An
    instant is two steps that only take minima and add: supply, b = min(b + refill,
    g + full), and service, g = min(g + demand, b in whole tokens). Such steps compose.
    Rounding to whole tokens commutes with minima, but not with adding a refill; so the
    steps are kept for each fraction of a token that b can have on entry. Fractions are
    multiples of gcd(per_second, 1000), of which there are 1000 at most.

    From (b, g) with the fraction f: b' = min(b + bb[f], g + bg), g' = min(b + gb[f], g + gg).
    """

    FAR = 2**60

    def __init__(self, per_second: int):
        self.full, self.rate = per_second * 1000, per_second
        self.fractions = np.arange(0, 1000, math.gcd(per_second, 1000), dtype=np.int64)
        self.bb = np.zeros_like(self.fractions)
        self.gb = np.full_like(self.fractions, self.FAR)
        self.bg, self.gg = self.FAR, 0

    def add(self, refill_ms: int, demand: int) -> None:
        """The next instant, so long after the one before."""
        refill = refill_ms * self.rate
        self.bb = np.minimum(self.bb + refill, self.gb + self.full)
        self.bg = min(self.bg + refill, self.gg + self.full)
        whole = (self.fractions + self.bb) // 1000 * 1000 - self.fractions
        self.gb = np.minimum(self.gb + 1000 * demand, whole)
        self.gg = min(self.gg + 1000 * demand, self.bg // 1000 * 1000)

    def pack(self) -> bytes:
        return np.concatenate([[self.bg, self.gg], self.bb, self.gb]).astype(np.int64).tobytes()

    @staticmethod
    def left(packed: bytes, per_second: int, tokens: int) -> int:
        """Tokens that the slice leaves of a bucket with so many."""
        steps = np.frombuffer(packed, np.int64)
        n = (len(steps) - 2) // 2
        f = tokens % 1000 // math.gcd(per_second, 1000)
        b = min(tokens + int(steps[2 + f]), int(steps[0]))
        g = min(tokens + int(steps[2 + n + f]), int(steps[1]))
        return b - g


def summarise_slices(rows: Iterator[tuple], per_second: int) -> Iterator[tuple]:
    """(client, slice, steps) of (client, slice, ms, n) in order."""
    here, steps, at = None, None, 0
    for client, part, ms, n in rows:
        if (client, part) != here:
            if here is not None:
                yield (*here, steps.pack())
            here, steps, at = (client, part), SliceSteps(per_second), int(ms)
        steps.add(int(ms) - at, int(n))
        at = int(ms)
    if here is not None:
        yield (*here, steps.pack())


def thread_slices(rows: Iterator[tuple], per_second: int) -> Iterator[tuple]:
    """The bucket that each slice finds: (client, slice, ms, tokens).

    rows: (client, slice, first, last, tokens, steps) in order. A client's stored bucket,
    if it has one, comes first, as a slice with its tokens and no steps. A slice without
    steps ends long enough before the next one for the bucket to be full by then.
    """
    here, tokens, at, full = None, 0, 0, per_second * 1000
    for client, part, first, last, stored, steps in rows:
        if client != here:
            here, tokens, at = client, full, int(first)
        if stored >= 0:
            tokens, at = int(stored), int(last)
            continue
        yield client, int(part), at, tokens
        now = max(at, int(first))
        tokens = min(full, tokens + (now - at) * per_second)
        tokens = full if steps is None else SliceSteps.left(bytes(steps), per_second, tokens)
        at = int(last)


def rate_batches(
    state: str, deliver: Sink, cfg: EngineConfig, client: str = "app_code", ts: str = "timestamp", request_id: str = "event_id"
) -> Sink:
    """Flag requests that find their client's bucket empty: n tokens, refilled
    continuously at n per second. Requests of one instant are served by id.

    Only one count per client and instant goes through the buckets. A client's instants
    are cut into slices. What a slice does to a bucket is worked out for all slices in
    parallel, where the next slice follows so closely that it matters; one narrow pass per
    client over its slices then gives the bucket that each finds, and all slices are
    served in parallel. The requests themselves are ranked in two steps, so that neither a
    client nor an instant of it meets in one task.
    """
    per_second = cfg.max_requests_per_second

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("client").agg(F.max(F.struct("ms", "tokens")).alias("b")).select("client", "b.tokens", "b.ms")

    remembered = BatchState(state, _BUCKET, fold)

    def mapped(rows: DataFrame, fn, keys: list[str], schema: str) -> DataFrame:
        names, out = rows.columns, [field.name for field in T.StructType.fromDDL(schema)]
        ordered = rows.repartition(*keys).sortWithinPartitions(*names)
        return ordered.mapInPandas(lambda parts: _frames(fn(_chunks(parts, names), per_second), out), schema)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ship_package(spark)
        with dropping_scratch(spark):
            name = F.coalesce(F.when(F.col(client) != "", F.col(client)), F.lit(cfg.default_client))
            rows = write_through(batch.withColumns({"_client": name, "_ms": F.unix_millis(F.col(ts))}), "requests")
            counts = rows.groupBy(F.col("_client").alias("client"), F.col("_ms").alias("ms")).agg(F.count("*").alias("n"))
            counts = write_through(counts.withColumn("slice", F.floor(F.col("ms") / SLICE_MS)), "instants")
            clients = counts.select("client").distinct()
            before = write_through(remembered.before(spark, batch_id).join(clients, "client", "left_semi"), "buckets")
            # time does not go back: an instant before the stored one is served at that time
            timed = counts.join(before.select("client", F.col("ms").alias("_at")), "client", "left")
            timed = timed.select("client", "slice", "ms", F.greatest("ms", "_at").alias("at"), "n")
            slices = timed.groupBy("client", "slice").agg(F.min("at").alias("first"), F.max("at").alias("last"))
            following = F.lead("first").over(W.partitionBy("client").orderBy("slice"))
            slices = write_through(slices.withColumn("close", F.coalesce(following - F.col("last") < 1000, F.lit(False))), "slices")
            closely = timed.join(slices.where("close").select("client", "slice"), ["client", "slice"], "left_semi")
            # rows are put in order of their columns: the served time first, then the own one
            steps = mapped(
                closely.select("client", "slice", "ms", "at", "n"),
                lambda instants, rate: summarise_slices(((c, s, at, n) for c, s, _, at, n in instants), rate),
                ["client", "slice"],
                "client string, slice long, steps binary",
            )
            known = slices.drop("close").join(write_through(steps, "steps"), ["client", "slice"], "left")
            none = F.lit(None).cast("binary").alias("steps")
            found = known.select("client", "slice", "first", "last", F.lit(-1).cast("long").alias("tokens"), "steps").unionByName(
                before.select("client", F.lit(-(2**62)).alias("slice"), F.col("ms").alias("first"), F.col("ms").alias("last"), "tokens", none)
            )
            entries = mapped(found, thread_slices, ["client"], "client string, slice long, ms long, tokens long")
            entries = entries.select("client", "slice", F.lit(-(2**62)).alias("own"), "ms", F.lit(-1).cast("long").alias("n"), "tokens")
            instants = timed.select("client", "slice", F.col("ms").alias("own"), F.col("at").alias("ms"), "n", F.lit(-1).cast("long").alias("tokens"))
            served = mapped(
                instants.unionByName(write_through(entries, "entries")),
                lambda both, rate: _own_times(both, rate),
                ["client", "slice"],
                "client string, slice long, own long, ms long, granted long, tokens long",
            )
            served = write_through(served, "served")
            granted = served.where("granted >= 0").select(
                F.col("client").alias("_client"), F.col("own").alias("_ms"), F.col("granted").alias("_granted")
            )
            lane = F.pmod(F.xxhash64(request_id, *rows.columns), F.lit(_RANK_LANES))
            marked = rows.withColumn("_lane", lane).join(granted, ["_client", "_ms"])
            in_lane = W.partitionBy("_client", "_ms", "_lane").orderBy(request_id)
            first = F.row_number().over(in_lane) <= F.col("_granted")
            ranked = marked.withColumn("_first", first)
            together = W.partitionBy("_client", "_ms", F.when(~F.col("_first"), F.col("_lane"))).orderBy(request_id)
            over = ~F.col("_first") | (F.row_number().over(together) > F.col("_granted"))
            deliver(ranked.withColumn("over_limit", over).select(*batch.columns, "over_limit"), batch_id)
            # the bucket after a client's last slice
            ends = served.where("granted < 0").groupBy("client").agg(F.max(F.struct("slice", "tokens", "ms")).alias("end"))
            remembered.add(ends.select("client", "end.tokens", "end.ms"), batch_id)

    return run


def _own_times(rows: Iterator[tuple], per_second: int) -> Iterator[tuple]:
    """``serve_instants`` for rows that carry the time they were sent at (own), too:
    (client, slice, own, ms, n, tokens)."""
    sent: list[int] = []

    def passed() -> Iterator[tuple]:
        for client, part, own, ms, n, tokens in rows:
            sent.append(int(own))
            yield client, part, ms, n, tokens

    for client, part, ms, granted, tokens in serve_instants(passed(), per_second):
        yield client, part, sent[-1], ms, granted, tokens
        del sent[:-1]
