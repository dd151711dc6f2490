"""Joins to tables that are usually small.

Such a table is written first. Spark then knows its size from the files: within
``spark.sql.autoBroadcastJoinThreshold`` it is broadcast, beyond that both sides are
shuffled, and adaptive execution splits the heavy partitions of the other side, which it
can as the written side comes straight from a shuffle too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.workspace import write_through

HOUR_MS = 3_600_000


def lookup_join(
    left: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", written: bool = False
) -> DataFrame:
    """Join to a table that is usually small and unique on ``on``. ``written`` says that
    it is read from files already."""
    return left.join(table if written else write_through(table, "lookup"), list(on), how)


def hour_of(ms: Column) -> Column:
    """First millisecond of the hour."""
    return ms - F.pmod(ms, F.lit(HOUR_MS))
