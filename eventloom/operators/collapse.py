"""One row per key: the highest version replaces the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Keep the row with the highest ``version`` of each key.

    An aggregate with a partial step, not a window: copies of a heavy key are reduced
    before the shuffle. End ``version`` with a unique column for a repeatable result.
    """
    rest = [name for name in rows.columns if name not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
        .select(*[F.col(name) if name in keys else F.col(f"_row.{name}").alias(name) for name in rows.columns])
    )
