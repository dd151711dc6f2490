"""Finished sessions and rollups from the events table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import EngineConfig
from eventloom.functions.times import partition_day, plus_seconds, sweep_due
from eventloom.operators.rollups import (
    DAILY_KEYS,
    apply_daily_changes,
    daily_changes,
    daily_partials,
    events_hourly,
    finish_daily,
    sessions_daily,
)
from eventloom.operators.sessions import (
    merge_parts,
    rows_of_parts,
    session_parts,
    session_rows,
    session_sink_defaults,
    split_live,
)
from eventloom.schemas import EVENTS, SESSION_COLUMNS, SESSIONS
from eventloom.sources.state import delete, exists, finished, read_note, write_note
from eventloom.sources.tables import COMPACTED, BatchNames, batches_of, numbered_batch, read_events, read_sessions, write_sessions
from eventloom.workspace import write_through


def finalize_sessions(events: DataFrame, cfg: EngineConfig, now: Column) -> DataFrame:
    """Sessions of events without a final session id that are idle for the timeout."""
    finished_rows, _ = split_live(session_rows(events, cfg), cfg, now)
    return finished_rows


def _open_schema(spark: SparkSession) -> T.StructType:
    parts = session_parts(spark.createDataFrame([], EVENTS)).schema
    return T.StructType([*parts.fields, T.StructField("_stored", SESSIONS)])


def swept_batches(spark: SparkSession, state: str) -> BatchNames:
    """Names of the batches of events that sweeps have read."""
    runs = finished(spark, state, "swept-")
    return BatchNames(read_note(spark, f"{state}/swept-{max(runs)}")[1:] if runs else [])


#: States of earlier sweeps that are kept.
KEEP = 3


def sweep_sessions(
    spark: SparkSession, events: str, sessions: str, state: str, cfg: EngineConfig, now: Column
) -> DataFrame:
    """One sweep over the stored tables; returns the rows it wrote.

    Stored events carry their final session id, so a session is an aggregate by id. A
    sweep reads the batches of events that no sweep has read, adds them to the measures
    of the open sessions, writes the sessions that are idle for the timeout, and keeps
    the measures: those of open sessions, and those of finished ones for
    ``session_keep_s`` more, in case late events change them. A session that changes
    after it was written is written again; ``read_sessions`` takes the last one.

    The measures carry the row that was last written of a session (``_stored``). A session
    that is written again under another day leaves a mark under the old one, and both rows
    go to ``changes-n`` below the state, for rollups (``upkeep_daily``).

    The state of run n is written last. If the job dies before, the next sweep is run n
    again and replaces what was written.
    """
    runs = finished(spark, state, "swept-")
    run = max(runs, default=-1) + 1
    known = BatchNames()
    open_schema = _open_schema(spark)
    parts = spark.createDataFrame([], open_schema).withColumn("fresh", F.lit(False))
    if runs:
        known = swept_batches(spark, state)
        parts = spark.read.schema(open_schema).parquet(f"{state}/open-{run - 1}").withColumn("fresh", F.lit(False))
    there = batches_of(spark, events)
    new = [b for b in there if b not in known and not b.startswith(COMPACTED)]
    if new:
        added = session_parts(read_events(spark, events, batches=new)).withColumn("fresh", F.lit(True))
        parts = parts.unionByName(added, allowMissingColumns=True)
    # one part of a session at most has a stored row
    merged = merge_parts(parts, F.max("fresh").alias("fresh"), F.max("_stored").alias("_stored"))
    due = sweep_due(F.col("end_time"), cfg.session_timeout_s, now)
    # finished in an earlier sweep, and nothing has come since
    old = sweep_due(F.col("end_time"), cfg.session_timeout_s, _last_sweep(spark, state, runs))
    merged = write_through(merged.withColumns({"_due": due, "_written": ~F.col("fresh") & old}), "sessions")
    sent = merged.where("_due and not _written")
    rows = write_through(session_sink_defaults(rows_of_parts(sent, cfg)), "finished")
    replaced = sent.where("_stored is not null").select("_stored.*", F.col("start_time").alias("_begins"))
    moved = replaced.where(partition_day(F.col("start_time")) != partition_day(F.col("_begins")))
    write_sessions(rows, sessions, numbered_batch("sweep", run), moved)
    changes = rows.withColumn("sign", F.lit(1)).unionByName(replaced.drop("_begins").withColumn("sign", F.lit(-1)))
    changes.write.mode("overwrite").parquet(f"{state}/changes-{run}")
    kept = merged.where(~F.col("_due") | (F.col("end_time") > plus_seconds(now, -cfg.session_timeout_s - cfg.session_keep_s)))
    latest = rows.select("session_id", F.struct(*SESSION_COLUMNS).alias("_now"))
    kept = kept.join(latest, "session_id", "left").withColumn("_stored", F.coalesce("_now", "_stored"))
    kept.drop("fresh", "_due", "_written", "_now").write.mode("overwrite").parquet(f"{state}/open-{run}")
    moment = spark.range(1).select(F.unix_millis(now)).first()[0]
    known.add(new)
    known.keep(there)
    write_note(spark, f"{state}/swept-{run}", [str(moment), *known.lines()])
    for kind in ("open-", "swept-"):
        for number in finished(spark, state, kind):
            if number <= run - KEEP:
                delete(spark, f"{state}/{kind}{number}")
    return rows


def _last_sweep(spark: SparkSession, state: str, runs: list[int]) -> Column:
    """The time of the last sweep; before the first one, a time before all events."""
    moment = int(read_note(spark, f"{state}/swept-{max(runs)}")[0]) if runs else -(2**46)
    return F.timestamp_millis(F.lit(moment))


def rollups(events: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events_hourly, sessions_daily)."""
    return events_hourly(events), sessions_daily(sessions)


def _replace_days(rows: DataFrame, path: str, day: str) -> None:
    """Write a rollup by day; only the days that occur in ``rows`` are replaced."""
    laid_out = rows.hint("rebalance", day)
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def _next_day(day: str) -> str:
    return (date.fromisoformat(day) + timedelta(days=1)).isoformat()


def refresh_hourly(spark: SparkSession, events: str, target: str, first_day: str, last_day: str) -> None:
    """Compute the hourly rollup of these days anew from the events table."""
    touched = read_events(spark, events, since=first_day, until=_next_day(last_day))
    _replace_days(events_hourly(touched).withColumn("day", F.to_date("hour")), target, "day")


def refresh_daily(spark: SparkSession, sessions: str, target: str, first_day: str, last_day: str) -> None:
    """Compute the daily rollup of sessions that began on these days anew; a session
    stored more than once counts once."""
    touched = read_sessions(spark, sessions, since=first_day, until=_next_day(last_day))
    _replace_days(sessions_daily(touched), target, "date")


# -- the daily rollup, kept up sweep by sweep ----------------------------------------


def _daily_schema(spark: SparkSession) -> T.StructType:
    partials = daily_partials(spark.createDataFrame([], SESSIONS)).schema
    return T.StructType([*partials.fields, T.StructField("run", T.LongType())])


def _rollup_days(spark: SparkSession, target: str) -> dict[str, int]:
    """The days of a kept-up rollup, and the run that each was last written in."""
    latest: dict[str, int] = {}
    for run in finished(spark, target, "_run-"):
        latest |= dict.fromkeys(read_note(spark, f"{target}/_run-{run}"), run)
    return latest


def _daily_rows(spark: SparkSession, target: str, days: dict[str, int]) -> DataFrame:
    schema = _daily_schema(spark)
    folders = [f"{target}/date={day}/run={run}" for day, run in sorted(days.items()) if exists(spark, f"{target}/date={day}/run={run}")]
    if not folders:
        return spark.createDataFrame([], schema).drop("run")
    return spark.read.schema(schema).option("basePath", target).parquet(*folders).drop("run")


def read_daily(spark: SparkSession, target: str, first_day: str = "", last_day: str = "9999-12-31") -> DataFrame:
    """The daily rollup of a range of days, as ``upkeep_daily`` has left it."""
    days = {day: run for day, run in _rollup_days(spark, target).items() if first_day <= day <= last_day}
    return finish_daily(_daily_rows(spark, target, days))


def upkeep_daily(spark: SparkSession, sessions: str, state: str, target: str) -> list[str]:
    """Bring the daily rollup up to the last sweep; returns the days that were touched.

    The changes of the sweeps since the last time are added to the stored sums: a session
    that was written again takes its old row back and adds the new one. Where the largest
    scroll depth of a key may have gone, it is found again from the sessions of that day.
    Only touched days are read and written, each into a folder of this run; a note of the
    run, written last, makes them count. A run that died is repeated and replaces them.
    """
    done = max(finished(spark, target, "_run-"), default=-1)
    swept = max(finished(spark, state, "swept-"), default=-1)
    pending = [n for n in finished(spark, state, "changes-") if done < n <= swept]
    if not pending:
        return []
    rows = T.StructType([*SESSIONS.fields, T.StructField("sign", T.IntegerType())])
    changes = daily_changes(spark.read.schema(rows).parquet(*[f"{state}/changes-{n}" for n in pending]))
    changes = write_through(changes, "daily-changes")
    days = [str(row.date) for row in changes.select("date").distinct().orderBy("date").collect()]
    before = _rollup_days(spark, target)
    stored = _daily_rows(spark, target, {day: before[day] for day in days if day in before})
    new = write_through(apply_daily_changes(stored, changes), "daily")
    stale = new.where("_stale").select(*DAILY_KEYS)
    again = [str(row.date) for row in stale.select("date").distinct().collect()]
    new = new.drop("_stale")
    if again:
        of_days = read_sessions(spark, sessions, since=min(again), until=_next_day(max(again)))
        of_days = of_days.withColumn("date", partition_day(F.col("start_time"))).where(F.col("date").isin([date.fromisoformat(d) for d in again]))
        found = of_days.join(stale, list(DAILY_KEYS), "left_semi").groupBy(*DAILY_KEYS).agg(F.max("scroll_depth_max").alias("_found"))
        new = new.join(found, list(DAILY_KEYS), "left").withColumn("max_scroll_depth", F.coalesce("_found", "max_scroll_depth")).drop("_found")
    run = pending[-1]
    laid_out = new.withColumn("run", F.lit(run)).hint("rebalance", "date")
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "run").parquet(target)
    write_note(spark, f"{target}/_run-{run}", days)
    for day in days:
        if day in before:
            delete(spark, f"{target}/date={day}/run={before[day]}")
    needed = set(_rollup_days(spark, target).values())
    for n in finished(spark, target, "_run-"):
        if n not in needed and n != run:
            delete(spark, f"{target}/_run-{n}")
    for n in pending:
        delete(spark, f"{state}/changes-{n}")
    return days
