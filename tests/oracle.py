"""Comparing a query with its SQL over the same tables, whatever the order of rows and columns."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf: str = SF):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf)):
        at = f"{sf}/{f}/*.parquet" if os.path.isdir(f"{sf}/{f}") else f"{sf}/{f}"
        con.execute(f"create view {f.split('.')[0]} as select * from '{at}'")
    return con


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.6g}"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    return str(v)


def bag(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(plain(x) for x in row) for row in frame[cols].itertuples(index=False))


def differing(spark, con, query, sql: str, sf: str = SF) -> str | None:
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = bag(got), bag(want)
    return None if a == b else f"{len(a)} and {len(b)} rows; first that differ: {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
