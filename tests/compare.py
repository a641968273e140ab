"""Comparison of a query with its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.01")


def connect(folder: Path = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return ""
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str([cell(v) for v in x])
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.6g}"
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(x) for x in r) for r in ordered.itertuples(index=False))
