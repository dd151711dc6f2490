"""The stored dead-letter table: a snapshot, and the entries added since.

Jobs that refuse events add entries in folders of their own (``new/batch-N``, and
``new/topic-N`` for what comes back from the dead-letter topic). A replay folds them into the next snapshot by the rule of ``store`` and removes the folders it has
folded. If it dies in between, folding them again changes little: an event that was
replayed is found in the events table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.operators.dead_letters import store
from eventloom.schemas import DEAD_LETTERS
from eventloom.sources.snapshots import read_snapshot
from eventloom.sources.state import delete, finished


#: Writers with batch numbers of their own.
BATCHES, TOPIC = "batch", "topic"


def add_entries(entries: DataFrame, root: str, batch: int, kind: str = BATCHES) -> None:
    """Entries of a batch; written again, they replace themselves."""
    entries.write.mode("overwrite").parquet(f"{root}/new/{kind}-{batch}")


def read_entries(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, list[str]]:
    """(entries of a snapshot and of the batches added to it, names of these batches)."""
    added = [f"{kind}-{n}" for kind in (BATCHES, TOPIC) for n in finished(spark, f"{root}/new", f"{kind}-")]
    entries = read_snapshot(spark, root, DEAD_LETTERS, version)
    if added:
        new = spark.read.schema(DEAD_LETTERS).parquet(*[f"{root}/new/{name}" for name in added])
        entries = store(entries, new)
    return entries, added


def drop_added(spark: SparkSession, root: str, batches: list[str]) -> None:
    for name in batches:
        delete(spark, f"{root}/new/{name}")
