"""Identity and the session sweep as keyed state.

The state of a visitor or of a session key lives in the state store, so a trigger touches
only the keys that it has events of, or whose timers are due. Neither has a watermark: a
late row is a row like others. Timers go by the clock of the trigger; start the streams
under ``timers_by_clock`` where they run over what is there now.

All rows of a key in one trigger meet in one task, in arrival order, and are held there;
bound a trigger with ``maxOffsetsPerTrigger``. Where single keys are heavier than that, use
``identity_batches`` and ``sweep_sessions``, which cut heavy keys.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventloom.config import EngineConfig
from eventloom.functions.keys import new_session_id
from eventloom.functions.text import has_text
from eventloom.operators.sessions import OPENING, finalize, page_seen, session_key
from eventloom.workspace import ship_package

DAY_US = 86_400 * 1_000_000
_HELPERS = ["_at", "_linked", "_asks"]
_FLAGS = ["identity_linked", "identity_resolved"]


class VisitorLinks(StatefulProcessor):
    """Links of a visitor by day, for as long as a link lives after it arrived."""

    def __init__(self, ttl_days: int, columns: list[str]):
        self.ttl_days, self.columns = ttl_days, columns
        self.out = Row(*columns, *_FLAGS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = "at array<long>, seq array<long>, user array<string>"
        self.days = handle.getMapState("days", "day long", value, self.ttl_days * 86_400_000)

    def _store(self, rows: list[Row]) -> None:
        fresh: dict[int, list[tuple]] = {}
        for r in rows:
            if r["_linked"]:
                fresh.setdefault(r["_at"] // DAY_US, []).append((r["_at"], r["seq"], r["user_id"]))
        for day, links in fresh.items():
            if self.days.containsKey((day,)):
                links += zip(*self.days.getValue((day,)), strict=True)
            self.days.updateValue((day,), tuple(list(x) for x in zip(*sorted(set(links)), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        self._store(rows)
        asked = [r["_at"] // DAY_US for r in rows if r["_asks"]]
        days = sorted(day for (day,) in self.days.keys()) if asked else []
        read: dict[int, list[tuple]] = {}

        def link(at: int, seq: int) -> tuple | None:
            """The last link at or before, of the same day or of the last one before it."""
            for k in range(bisect_right(days, at // DAY_US) - 1, -1, -1):
                day = days[k]
                if day not in read:
                    read[day] = list(zip(*self.days.getValue((day,)), strict=True))
                place = bisect_right(read[day], (at, seq), key=lambda x: x[:2])
                if place:
                    return read[day][place - 1]
            return None

        for r in rows:
            found = link(r["_at"], r["seq"]) if r["_asks"] else None
            alive = found is not None and r["_at"] < found[0] + self.ttl_days * DAY_US
            values = [found[2] if alive and name == "user_id" else r[name] for name in self.columns]
            yield self.out(*values, r["_linked"], alive)

    def close(self) -> None:
        pass


def identity_keyed(events: DataFrame, cfg: EngineConfig, allowed: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """``resolve_identity`` over a stream, with one state per visitor.

    A late event finds the link of its own time, not only the last one: all links of a
    visitor are kept by day. Of rows that come in one trigger every link is known to every
    row. A link that comes in a later trigger does not change rows already out. Events
    need a ``seq``.
    """
    if not cfg.identity_enabled:
        return events.withColumns({name: F.lit(False) for name in _FLAGS})
    ship_package(events.sparkSession)
    may = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    visitor, user = has_text("anonymous_id"), has_text("user_id")
    timed = F.col(ts).isNotNull()
    kept = [name for name in events.columns if name not in _FLAGS]
    marked = events.select(*kept).withColumns(
        {"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_linked": visitor & user & may & timed, "_asks": visitor & ~user & may & timed}
    )
    # rows that neither link nor ask need no state
    part = F.col("_linked") | F.col("_asks")
    idle = marked.where(~part).drop(*_HELPERS).withColumns({name: F.lit(False) for name in _FLAGS})
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in events.select(*kept).schema), *(T.StructField(n, T.BooleanType()) for n in _FLAGS)])
    keyed = marked.where(part).groupBy("anonymous_id").transformWithState(
        VisitorLinks(cfg.identity_ttl_days, kept), out, "Append", "ProcessingTime"
    )
    return keyed.unionByName(idle)


class Part(NamedTuple):
    """A session so far; times in microseconds. ``version`` is that of the row that was
    sent last, 0 if none was; ``stale`` says that the session changed after it."""

    start: int
    end: int
    page_views: int
    clicks: int
    exposures: int
    scroll: int
    opened: tuple  # at, seq, OPENING
    viewed: tuple | None  # at, seq, page_url
    version: int = 0
    stale: bool = True
    heard: int = 0  # when the last event arrived, in milliseconds


def joined(a: Part, b: Part) -> Part:
    """Both as one session, under the name of the earlier one."""
    first = min(a, b, key=lambda p: p.start)
    return Part(
        first.start,
        max(a.end, b.end),
        a.page_views + b.page_views,
        a.clicks + b.clicks,
        a.exposures + b.exposures,
        max(a.scroll, b.scroll),
        min(a.opened, b.opened, key=lambda x: x[:2]),
        max((p.viewed for p in (a, b) if p.viewed), key=lambda x: x[:2], default=None),
        first.version,
        True,
        max(a.heard, b.heard),
    )


#: Sessions of a key are one JSON text: Spark hands a struct of a list to Python with its
#: whole schema each, which takes longer than all else.
_VISITS = "sent long, timer long, parts string"
_SENT = ", ".join(
    ["app_code string, _key string, _start long, _end long, page_views long, clicks long, exposures long, scroll_depth_max int"]
    + [*(f"{name} string" for name in OPENING), "_viewed_url string, version long, withdrawn boolean"]
)


class SessionTimers(StatefulProcessor):
    """Sessions of a key in order of their start. A session is sent by a timer when it is
    idle for the timeout, sent again when events came after that, and forgotten when none
    has come for so long.

    A key has one value and one timer, that of the session due first, so a trigger reads
    and writes a key once for its events and once for all its sessions that are due."""

    def __init__(self, timeout_s: int, keep_s: int):
        self.timeout_ms, self.keep_ms = timeout_s * 1000, keep_s * 1000
        self.out = Row(*T.StructType.fromDDL(_SENT).fieldNames())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visits = handle.getValueState("visits", _VISITS)

    def _read(self) -> list[Part]:
        self.sent, self.timer, parts = self.visits.get() if self.visits.exists() else (0, None, "[]")
        return [Part(*p[:6], tuple(p[6]), p[7] and tuple(p[7]), *p[8:]) for p in json.loads(parts)]

    def _write(self, parts: list[Part]) -> None:
        """Also sets the timer anew, if another session is due first."""
        due = min(map(self._due, parts), default=None)
        if due != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.visits.update((self.sent, due, json.dumps(parts)))

    def _due(self, p: Part) -> int:
        """When to look at it again."""
        return -(-p.end // 1000) + self.timeout_ms if p.stale else max(p.heard, p.end // 1000 + self.timeout_ms) + self.keep_ms

    def _next(self) -> int:
        self.sent += 1
        return self.sent

    def _row(self, key: tuple, p: Part, version: int, withdrawn: bool) -> Row:
        return self.out(*key, *p[:6], *p.opened[2:], p.viewed and p.viewed[2], version, withdrawn)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        before = [p for p in self._read() if p.stale or self._due(p) > now]
        events = [
            Part(r["_at"], r["_at"], int(r["_kind"] == "page_view"), int(r["_kind"] == "click"), int(r["_kind"] == "exposure"),
                 max(0, r["_scroll"] or 0), (r["_at"], r["seq"], *(r[name] for name in OPENING)),
                 (r["_at"], r["seq"], r["page_url"]) if r["_seen"] else None, heard=now)
            for r in rows
        ]
        after: list[Part] = []
        for p in sorted([*before, *events], key=lambda p: (p.start, -p.version)):
            if after and p.start - after[-1].end <= self.timeout_ms * 1000:
                after[-1] = joined(after[-1], p)
            else:
                after.append(p)
        starts = {p.start for p in after}
        gone = [self._row(key, p, self._next(), True) for p in before if p.start not in starts and p.version]
        self._write(after)
        yield from gone

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        kept, sent = [], []
        for p in self._read():
            if self._due(p) <= now:
                if not p.stale:
                    continue
                p = p._replace(version=self._next(), stale=False)
                sent.append(self._row(key, p, p.version, False))
            kept.append(p)
        # the timer that has come goes by itself
        if self.timer == expiredTimerInfo.getExpiryTimeInMs():
            self.timer = None
        self._write(kept)
        yield from sent

    def close(self) -> None:
        pass


def sweep_stream(events: DataFrame, cfg: EngineConfig, ts: str = "timestamp") -> DataFrame:
    """Sessions that are idle for the timeout by the clock: SESSIONS and (version,
    withdrawn).

    A session is sent again, with a higher version, when late events change it; one that
    late events lengthen at its start or join to another has a new id, and the old one is
    withdrawn. ``last_versions`` gives what stands. A session is forgotten when nothing has
    arrived for ``session_keep_s`` after it was due; what comes then is a session of its own.
    """
    ship_package(events.sparkSession)
    missing = {name: F.lit(None).cast("string") for name in OPENING if name not in events.columns}
    if "seq" not in events.columns:
        missing["seq"] = F.xxhash64("event_id")
    narrow = (
        events.withColumns(missing)
        .where(F.col(ts).isNotNull())
        .select(
            "app_code",
            session_key(cfg, events.columns).alias("_key"),
            F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"),
            F.col("seq").cast("long").alias("seq"),
            F.col("event_type").alias("_kind"),
            F.when(F.col("event_type") == "scroll", F.col("scroll_depth").cast("int")).alias("_scroll"),
            F.coalesce(page_seen(), F.lit(False)).alias("_seen"),
            *OPENING,
        )
    )
    sent = narrow.groupBy("app_code", "_key").transformWithState(
        SessionTimers(cfg.session_timeout_s, cfg.session_keep_s), _SENT, "Append", "ProcessingTime"
    )
    owner = F.concat_ws(":", F.col("app_code"), F.col("_key"))
    start = F.timestamp_micros("_start")
    merged = sent.select(
        "app_code",
        start.alias("start_time"),
        F.timestamp_micros("_end").alias("end_time"),
        "page_views", "clicks", "exposures", "scroll_depth_max",
        F.struct(*OPENING).alias("_opening"),
        F.struct(F.col("_viewed_url").alias("page_url")).alias("_viewed"),
        new_session_id(owner, start).alias("_session"),
        "version", "withdrawn",
    )
    return finalize(merged, cfg, "version", "withdrawn")


def last_versions(sent: DataFrame) -> DataFrame:
    """The sessions that stand: the last version of each that is not withdrawn."""
    columns = [name for name in sent.columns if name not in ("version", "withdrawn")]
    newest = sent.groupBy("session_id").agg(F.max_by(F.struct(*sent.columns), "version").alias("_last"))
    return newest.where("not _last.withdrawn").select(*[f"_last.{name}" for name in columns])
