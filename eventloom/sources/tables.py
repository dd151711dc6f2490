"""The events and sessions tables: Parquet by day, sorted for pruning.

Every writer uses one layout, ``day=D/batch=B``. A batch owns its folders: written
again, it replaces them, so a repeated job or micro-batch changes nothing. Day filters,
expiry and compaction work on the day folders whoever wrote them.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.times import age_expired, partition_day
from eventloom.operators.collapse import replace_latest
from eventloom.operators.enrich import default_times, sink_defaults
from eventloom.operators.sessions import session_sink_defaults
from eventloom.schemas import EVENT_COLUMNS, EVENTS, SESSION_COLUMNS, SESSIONS
from eventloom.sources.state import read_note, write_note

EVENT_DAY = "event_date"
SESSION_DAY = "start_date"
BATCH = "batch"
EVENT_ORDER = ("user_id", "timestamp", "event_type", "session_id")
SESSION_ORDER = ("user_id", "start_time")
# Columns that are looked up by value but are not in the sort order.
EVENT_BLOOM = ("event_id", "user_id", "session_id", "page_url", "spmb", "spmd", "app_code")
SESSION_BLOOM = ("app_code",)


def _with_blooms(writer: DataFrameWriter, columns: tuple[str, ...]) -> DataFrameWriter:
    for name in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.fpp#{name}", "0.01")
    return writer


def new_batch(kind: str = "job") -> str:
    """A name for a batch that is written once and not repeated."""
    return f"{kind}-{uuid.uuid4().hex}"


def numbered_batch(kind: str, number: int) -> str:
    """The name of a numbered batch; names of one kind sort like their numbers."""
    return f"{kind}-{number:012d}"


class BatchNames:
    """A set of batch names that stays small: of numbered batches of a kind it keeps ranges
    of numbers, so a stream without gaps is one line however long it runs."""

    def __init__(self, lines: Iterable[str] = ()):
        self._ranges: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self._others: set[str] = set()
        for line in lines:
            if found := re.fullmatch(r"(.*)-(\d{12})\.\.(\d{12})", line):
                self._ranges[found[1]].append((int(found[2]), int(found[3])))
            elif line:
                self.add([line])

    def __contains__(self, name: str) -> bool:
        if found := re.fullmatch(r"(.*)-(\d{12})", name):
            return any(first <= int(found[2]) <= last for first, last in self._ranges.get(found[1], ()))
        return name in self._others

    def add(self, names: Iterable[str]) -> None:
        for name in names:
            if found := re.fullmatch(r"(.*)-(\d{12})", name):
                self._ranges[found[1]].append((int(found[2]), int(found[2])))
            else:
                self._others.add(name)
        for kind, ranges in self._ranges.items():
            merged: list[tuple[int, int]] = []
            for first, last in sorted(ranges):
                if merged and first <= merged[-1][1] + 1:
                    merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
                else:
                    merged.append((first, last))
            self._ranges[kind] = merged

    def keep(self, names: Iterable[str]) -> None:
        """Forget other names without a number: their batches are gone."""
        self._others &= set(names)

    def lines(self) -> list[str]:
        ranges = [f"{kind}-{first:012d}..{last:012d}" for kind, of in sorted(self._ranges.items()) for first, last in of]
        return ranges + sorted(self._others)


def _write(rows: DataFrame, path: str, day: str, order: tuple[str, ...], blooms: tuple[str, ...], batch: str) -> None:
    # Rebalancing by day lets adaptive execution cut a heavy day into files of the
    # advisory size and join light days, so no task writes a third of the data.
    laid_out = rows.withColumn(BATCH, F.lit(batch)).hint("rebalance", day).sortWithinPartitions(day, *order)
    writer = laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    # ids hardly repeat: a dictionary of them would only stand in the way of the filter
    writer = writer.option("parquet.enable.dictionary#event_id", "false")
    _with_blooms(writer, blooms).partitionBy(day, BATCH).parquet(path)


def event_table_rows(events: DataFrame, now: Column) -> DataFrame:
    """The 40 columns as stored, and the day they are stored under."""
    rows = sink_defaults(default_times(events, now))
    return rows.withColumn(EVENT_DAY, partition_day(F.col("timestamp")))


def write_events(events: DataFrame, path: str, now: Column, batch: str | None = None) -> None:
    """Add a batch of events; without a name it is one of its own."""
    _write(event_table_rows(events, now), path, EVENT_DAY, EVENT_ORDER, EVENT_BLOOM, batch or new_batch())


#: Marks a row that only says that a session is no longer stored under this day.
MOVED = "moved"


def write_sessions(sessions: DataFrame, path: str, batch: str | None = None, moved: DataFrame | None = None) -> None:
    """``moved``: (session_id, start_time) of older versions of these sessions that lie
    under another day. Each leaves a mark there, so that every day can be read by itself."""
    rows = session_sink_defaults(sessions).withColumn(MOVED, F.lit(False))
    if moved is not None:
        marks = moved.select("session_id", "start_time", F.lit(True).alias(MOVED))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn(SESSION_DAY, partition_day(F.col("start_time")))
    _write(rows, path, SESSION_DAY, SESSION_ORDER, SESSION_BLOOM, batch or new_batch())


def cluster_sort(rows: DataFrame, day: str, order: tuple[str, ...], files: int) -> DataFrame:
    """Rows in the table's order across files: each file holds a narrow range of the
    leading columns, and heavy days get more files. For rewriting finished days."""
    return rows.repartitionByRange(files, day, *order).sortWithinPartitions(day, *order)


def _folders(spark: SparkSession, path: str):
    """The file system of a path and a maker of paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _children(files, folder) -> list[str]:
    """Names of the folders in a folder, without hidden ones."""
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder) if status.isDirectory()]
    return sorted(name for name in names if not name.startswith(("_", ".")))


def batches_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches a table has, from its folders."""
    files, make = _folders(spark, path)
    days = _children(files, make(path))
    found = {name for day in days for name in _children(files, make(f"{path}/{day}"))}
    return sorted(name.removeprefix(f"{BATCH}=") for name in found if name.startswith(f"{BATCH}="))


def drop_batch(spark: SparkSession, path: str, batch: str) -> None:
    """Take back what was written of a batch."""
    files, make = _folders(spark, path)
    for day in _children(files, make(path)):
        files.delete(make(f"{path}/{day}/{BATCH}={batch}"), True)


def skip_indexes(spark: SparkSession, path: str) -> DataFrame:
    """(column, bloom, dictionary): what lets a lookup by value skip row groups, as the
    footers say: every file has a Bloom filter on the column, or keeps its values in a
    dictionary (then it writes no filter, for readers check the dictionary). A check of
    a table's files, one by one, for small tables."""
    footers = spark.sparkContext._jvm.org.apache.parquet.hadoop.ParquetFileReader
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    bloom: dict[str, bool] = {}
    words: dict[str, bool] = {}
    for file in spark.read.parquet(path).inputFiles():
        for block in footers.readFooter(conf, make(file)).getBlocks():
            for column in block.getColumns():
                name = column.getPath().toDotString().split(".")[0]
                bloom[name] = bloom.get(name, True) and column.getBloomFilterOffset() > 0
                words[name] = words.get(name, True) and column.hasDictionaryPage()
    rows = [(name, bloom[name], words[name]) for name in sorted(bloom)]
    return spark.createDataFrame(rows, "column string, bloom boolean, dictionary boolean")


COMPACTED = "compact"


def compact_events(
    spark: SparkSession, path: str, first_day: str, last_day: str, files: int, batches: BatchNames | list[str] | None = None
) -> list[str]:
    """Rewrite the batches of a range of days as one, in table order; returns the days.
    ``files`` are written at least, more where one would be larger than FILE.

    Sweeps pass compacted batches by, so give the ``batches`` that were swept if there
    are others. Reads of these days have to wait until it is done.
    """
    fs, make = _folders(spark, path)
    days = [d for d in _children(fs, make(path)) if f"{EVENT_DAY}={first_day}" <= d <= f"{EVENT_DAY}={last_day}"]
    replaced = [f"{d}/{b}" for d in days for b in _children(fs, make(f"{path}/{d}"))]
    if batches is not None:
        replaced = [name for name in replaced if name.split(f"/{BATCH}=")[1] in batches]
    size = sum(fs.getContentSummary(make(f"{path}/{name}")).getLength() for name in replaced)
    _fold(spark, path, replaced, max(files, -(-size // FILE)))
    return [d.removeprefix(f"{EVENT_DAY}=") for d in days]


#: Batches of a day that are of one size, each size being so many times the one below,
#: are folded when there are so many of them.
TIER = 8
#: Bytes; smaller batches are of one size. Bytes that a file of a folded batch has: a task
#: sorts one, which takes about ten times as much memory.
SMALL, FILE = 2**20, 2**26


def fold_small_batches(
    spark: SparkSession, path: str, swept: BatchNames | None = None, tier: int = TIER, small: int = SMALL
) -> list[str]:
    """Fold the batches of a day that are of about one size, once there are ``tier`` of
    them, into one; returns the folders that went. A day then has a few folders of each
    size, and a row is rewritten once per size, however many batches come.

    Only batches in ``swept`` are folded (all, without it), and batches folded before, as
    sweeps pass folded ones by. Sizes are those of the folders; no file is opened. Reads of
    days that are folded have to wait until it is done.
    """
    fs, make = _folders(spark, path)
    chosen, size = [], 0
    for day in _children(fs, make(path)):
        tiers: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for batch in _children(fs, make(f"{path}/{day}")):
            name = batch.removeprefix(f"{BATCH}=")
            if swept is None or name in swept or name.startswith(COMPACTED):
                bytes_ = fs.getContentSummary(make(f"{path}/{day}/{batch}")).getLength()
                tiers[max(0, math.ceil(math.log(max(1, bytes_ / small), tier)))].append((f"{day}/{batch}", bytes_))
        for held in tiers.values():
            if len(held) >= tier:
                chosen += [name for name, _ in held]
                size += sum(bytes_ for _, bytes_ in held)
    if chosen:
        _fold(spark, path, chosen, len({name.split("/")[0] for name in chosen}) + size // FILE)
    return chosen


def _fold(spark: SparkSession, path: str, replaced: list[str], files: int) -> None:
    """Rewrite these folders as one batch per day. The new files are written beside the
    table first. Then the folders that were read go and the new ones move in. After a crash
    run ``finish_compaction`` before anything else."""
    if not replaced:
        return
    batch = new_batch(COMPACTED)
    fields = [*EVENTS.fields, T.StructField(EVENT_DAY, T.DateType()), T.StructField(BATCH, T.StringType())]
    rows = spark.read.schema(T.StructType(fields)).option("basePath", path).parquet(*[f"{path}/{name}" for name in replaced])
    writer = cluster_sort(rows.withColumn(BATCH, F.lit(batch)), EVENT_DAY, EVENT_ORDER, files).write.mode("overwrite")
    _with_blooms(writer, EVENT_BLOOM).partitionBy(EVENT_DAY, BATCH).parquet(f"{path}/_compact/rows")
    write_note(spark, f"{path}/_compact/replaced", replaced)
    finish_compaction(spark, path)


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Put a written compaction in place; nothing to do without one. Can be repeated."""
    fs, make = _folders(spark, path)
    if not fs.exists(make(f"{path}/_compact/replaced/_SUCCESS")):
        return
    for name in read_note(spark, f"{path}/_compact/replaced"):
        fs.delete(make(f"{path}/{name}"), True)
    for day in _children(fs, make(f"{path}/_compact/rows")):
        for batch in _children(fs, make(f"{path}/_compact/rows/{day}")):
            fs.mkdirs(make(f"{path}/{day}"))
            fs.rename(make(f"{path}/_compact/rows/{day}/{batch}"), make(f"{path}/{day}/{batch}"))
    fs.delete(make(f"{path}/_compact"), True)


def evolve_schema(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add columns that older files lack, and fill them with their default."""
    have = set(rows.columns)
    return rows.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
            for name, default in defaults.items()
        }
    )


def _days_between(rows: DataFrame, day: str, since: str | None, until: str | None) -> DataFrame:
    """By the day folders."""
    if since is not None:
        rows = rows.where(F.col(day) >= F.to_date(F.lit(since).cast("timestamp")))
    if until is not None:
        rows = rows.where(F.col(day) <= F.to_date(F.lit(until).cast("timestamp")))
    return rows


def _between(rows: DataFrame, ts: str, since: str | None, until: str | None) -> DataFrame:
    if since is not None:
        rows = rows.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.where(F.col(ts) < F.lit(until).cast("timestamp"))
    return rows


def read_table(spark: SparkSession, path: str, columns: T.StructType, day: str) -> DataFrame:
    """All batches, with the day and batch columns. The schema is given, so no file is
    opened to find it; a column that a file lacks reads as null. A table that nobody has
    written yet is empty."""
    fields = [*columns.fields, T.StructField(day, T.DateType()), T.StructField(BATCH, T.StringType())]
    files, make = _folders(spark, path)
    if not files.exists(make(path)):
        return spark.createDataFrame([], T.StructType(fields))
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_events(
    spark: SparkSession,
    path: str,
    since: str | None = None,
    until: str | None = None,
    batches: list[str] | None = None,
    days: list[date] | None = None,
) -> DataFrame:
    """Events of a time range, or of some batches or days; files written before app_code existed
    read as ''."""
    rows = _days_between(read_table(spark, path, EVENTS, EVENT_DAY), EVENT_DAY, since, until)
    rows = _between(rows, "timestamp", since, until)
    if batches is not None:
        rows = rows.where(F.col(BATCH).isin(batches))
    if days is not None:
        rows = rows.where(F.col(EVENT_DAY).isin(days))
    return evolve_schema(rows, {"app_code": ""}).select(*EVENT_COLUMNS)


def read_sessions(
    spark: SparkSession, path: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """One row per session: a session that several sweeps have written counts as the
    last one wrote it. Only the days of the range are opened: a version that lies under
    another day than the last one is followed there by a mark that it has moved."""
    stored = T.StructType([*SESSIONS.fields, T.StructField(MOVED, T.BooleanType())])
    rows = _days_between(read_table(spark, path, stored, SESSION_DAY), SESSION_DAY, since, until)
    rows = evolve_schema(rows, {"app_code": ""}).withColumn("_here", ~F.coalesce(F.col(MOVED), F.lit(False)))
    latest = replace_latest(
        rows.select(*SESSION_COLUMNS, BATCH, "_here"), ("session_id",), (BATCH, "_here", "last_active_at", "start_time")
    )
    return _between(latest.where("_here"), "start_time", since, until).select(*SESSION_COLUMNS)


def retain(rows: DataFrame, ts: str, ttl_s: int, now: Column) -> DataFrame:
    """Rows that have not outlived their time to live."""
    return rows.where(~age_expired(F.col(ts), ttl_s, now))


def expire_days(spark: SparkSession, path: str, day: str, oldest_kept: str) -> list[str]:
    """Delete day folders before ``oldest_kept`` (a date); nothing is rewritten."""
    files, make = _folders(spark, path)
    dropped = []
    for name in _children(files, make(path)):
        if name.startswith(f"{day}=") and name[len(day) + 1 :] < oldest_kept:
            files.delete(make(f"{path}/{name}"), True)
            dropped.append(name[len(day) + 1 :])
    return sorted(dropped)
