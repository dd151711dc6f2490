"""Small tables that are replaced as a whole: dead letters.

Each write makes a new numbered folder; readers take the newest finished one. A job
that fails half-way leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from eventloom.sources.state import delete, finished

#: Versions that are kept, for readers that have begun.
KEEP = 3


def newest_version(spark: SparkSession, root: str) -> int | None:
    return max(finished(spark, root, "version="), default=None)


def read_snapshot(spark: SparkSession, root: str, schema: StructType, version: int | None = None) -> DataFrame:
    """A version, the newest unless named; an empty table if there is none."""
    version = newest_version(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/version={version}")


def write_snapshot(rows: DataFrame, root: str, base: int | None) -> int:
    """Write the version after ``base``, the one ``rows`` were made from, and return its
    number. Fails if another job has written a version since."""
    spark = rows.sparkSession
    newest = newest_version(spark, root)
    if newest != base:
        raise RuntimeError(f"{root}: version {newest} was written since version {base} was read")
    version = 0 if base is None else base + 1
    rows.write.mode("overwrite").parquet(f"{root}/version={version}")
    for old in finished(spark, root, "version="):
        if old <= version - KEEP:
            delete(spark, f"{root}/version={old}")
    return version
