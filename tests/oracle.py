"""Rows of a query against rows of its SQL, on any folder of tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if hasattr(x, "item"):
        return x.item()
    return x


def rows(names: list[str], values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in values)


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def differences(frame, con, sql: str) -> str:
    """Empty if the rows are equal."""
    ours = rows(frame.columns, frame.collect())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    theirs = rows(columns, found.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} {sorted(columns)}"
    if ours == theirs:
        return ""
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(a)[:2]}; only theirs {list(b)[:2]}"
