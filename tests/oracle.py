"""Comparison of a query with its SQL, as the driver does it."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if both have the same rows, else what differs."""
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != names:
        return f"columns {cols} and {names}"
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} and {len(want)} rows; only Spark: {sorted(a - b, key=repr)[:3]}; only SQL: {sorted(b - a, key=repr)[:3]}"
    return ""
