"""Runs a registered query and its SQL side by side and reports the differences."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)) if v is None else "", round(v, 3) if isinstance(v, float) else v) for v in row)


def kind(v: object) -> str:
    return type(v).__name__


def compare(name: str, df, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """Problems found; an empty list is an exact match of columns, types and values."""
    cols = sorted(df.columns)
    left = [tuple(r) for r in df.select(*cols).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return [f"{name}: columns {cols} != {sorted(names)}"]
    at = [names.index(c) for c in cols]
    right = [tuple(r[i] for i in at) for r in rows]
    if len(left) != len(right):
        return [f"{name}: {len(left)} rows != {len(right)}"]
    if set(left) == set(right):
        return []
    a, b = sorted(left, key=sort_key), sorted(right, key=sort_key)
    bad = []
    for x, y in zip(a, b):
        for c, u, v in zip(cols, x, y):
            same = u == v or (isinstance(u, float) and isinstance(v, float) and math.isnan(u) and math.isnan(v))
            if not same or (kind(u) != kind(v)):
                bad.append(f"{name}.{c}: {u!r} != {v!r} in {x} / {y}")
        if len(bad) > 4:
            break
    return bad
