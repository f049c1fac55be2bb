"""Runs queries and their SQL side by side, as the driver does."""

from __future__ import annotations

import math

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(folder).iterdir():
        if p.name.endswith(".parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "tolist") and not isinstance(x, str):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return "[" + ",".join(cell(y) for y in x) + "]"
    return str(x)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if both give the same rows, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    got = rows(df.columns, df.collect())
    if got == want:
        return ""
    first = next(((a, b) for a, b in zip(got, want) if a != b), (got[-1:], want[-1:]))
    return f"{len(got)} rows instead of {len(want)}; first difference {str(first)[:600]}"
