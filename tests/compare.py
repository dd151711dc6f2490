"""Compare a Spark result with the result of SQL run by DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(pdf: pd.DataFrame) -> list[tuple]:
    out = pd.DataFrame(index=pdf.index)
    for name in sorted(pdf.columns):
        values = pdf[name]
        if pd.api.types.is_datetime64_any_dtype(values):
            out[name] = values.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(values):
            out[name] = values.astype(str)
        elif pd.api.types.is_numeric_dtype(values):
            out[name] = values.astype("float64").map(lambda v: "null" if pd.isna(v) else repr(round(v, 6)))
        else:
            out[name] = values.map(lambda v: "null" if v is None or v is pd.NaT or v != v else str(v))
    return sorted(out.itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} / {len(b)}\n columns {sorted(got.columns)}\n only spark {only_a}\n only sql {only_b}"
