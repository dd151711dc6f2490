"""What a job remembers from batch to batch: rows added per batch, folded now and then.

A state has folders ``add-N`` (the rows batch N added) and ``base-N`` (everything up to
batch N, folded). Batch n reads what was added before n, so a repeated batch starts from
the same state and replaces what it wrote. Adding costs as much as the batch is large,
not as the state is.

Where a row may only count once something else has been written, a batch is added in two
steps: its rows wait in ``pending-N``, which nobody reads, and become ``add-N`` when the
write is known to have succeeded, or go when it has failed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Batches between two folds, and folded states that are kept.
FOLD_EVERY, KEEP = 16, 2


def finished(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix<number>`` that were written to their end."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    files = make(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(make(root)):
        return []
    names = [status.getPath().getName() for status in files.listStatus(make(root))]
    numbers = [n.removeprefix(prefix) for n in names if n.startswith(prefix)]
    return sorted(int(n) for n in numbers if n.isdigit() and files.exists(make(f"{root}/{prefix}{n}/_SUCCESS")))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Put a written folder in the place of another."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(make(target), True)
    if not files.rename(make(source), make(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def write_note(spark: SparkSession, folder: str, lines: list[str]) -> None:
    """A few lines of text as a folder like those that jobs write; replaces an old one."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    files = make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(make(folder), True)
    for name, text in (("lines.txt", "\n".join(lines)), ("_SUCCESS", "")):
        out = files.create(make(f"{folder}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()


def read_note(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/lines.txt")
    source = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        text = bytes(source.readAllBytes()).decode()
    finally:
        source.close()
    return text.split("\n") if text else []


@dataclass(frozen=True)
class BatchState:
    root: str
    schema: StructType
    fold: Callable[[DataFrame], DataFrame]
    """Makes the rows of several batches one table: drops what has run out or was replaced."""

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """Everything that batches before this one added, folded."""
        return self.fold(self._rows(spark, batch))

    def _rows(self, spark: SparkSession, batch: int) -> DataFrame:
        bases = [n for n in finished(spark, self.root, "base-") if n < batch]
        since = max(bases, default=-1)
        folders = [f"{self.root}/base-{since}"] if bases else []
        folders += [f"{self.root}/add-{n}" for n in finished(spark, self.root, "add-") if since < n < batch]
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*folders)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Keep the rows of a batch."""
        self.propose(rows, batch)
        self.confirm(rows.sparkSession, batch)

    def propose(self, rows: DataFrame, batch: int) -> None:
        """First step: the rows are written, but do not count."""
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/pending-{batch}")

    def discard(self, spark: SparkSession, batch: int) -> None:
        """The rows of this batch do not count, nor do those of an earlier attempt at it."""
        for kind in ("pending", "add", "base"):
            delete(spark, f"{self.root}/{kind}-{batch}")

    def confirm(self, spark: SparkSession, batch: int) -> None:
        """Second step: they count from now on. Every so often fold, and remove what a
        fold replaced."""
        columns = self.schema.fieldNames()
        replace_folder(spark, f"{self.root}/pending-{batch}", f"{self.root}/add-{batch}")
        bases = finished(spark, self.root, "base-")
        oldest = min(finished(spark, self.root, "add-"), default=batch)
        if batch - max(bases, default=oldest - 1) < FOLD_EVERY:
            return
        folded = self.fold(self._rows(spark, batch + 1))
        folded.select(*columns).write.mode("overwrite").parquet(f"{self.root}/base-{batch}")
        kept = sorted([*bases, batch])[-KEEP:]
        for n in bases:
            if n < kept[0]:
                delete(spark, f"{self.root}/base-{n}")
        for n in finished(spark, self.root, "add-"):
            if n <= kept[0] and len(kept) == KEEP:
                delete(spark, f"{self.root}/add-{n}")
