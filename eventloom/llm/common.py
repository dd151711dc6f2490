"""What the text operators share: reading, intermediate tables, batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.workspace import ship_package, write_through

#: Rows of one Arrow batch that a Python step hands back.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts the lineage."""
    return write_through(df, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % mod


def rows_in_arrow(fn: Callable[..., Iterator[tuple]], schema: pa.Schema, batch_rows: int = BATCH_ROWS):
    """A function for mapInArrow from one that turns an iterator of row tuples into
    another. Rows pass one at a time and leave in small batches, so memory stays bounded
    by a batch whatever a partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, batch_rows):
                    part = batch.slice(start, batch_rows)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        out: list[tuple] = []
        for row in fn(rows()):
            out.append(row)
            if len(out) >= batch_rows:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def map_rows(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """`fn` maps an iterator of row tuples to an iterator of row tuples of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(df.sparkSession)
    struct = StructType.fromDDL(schema)
    return df.mapInArrow(rows_in_arrow(fn, to_arrow_schema(struct)), struct)
