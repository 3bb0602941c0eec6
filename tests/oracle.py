"""Compare a query with its SQL: same columns, same rows whatever their order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from tideline.session import TABLES


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for n in TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{d}/{n}.parquet'")
    return c


def plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(cols: list[str], data: list[tuple]) -> Counter:
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differ(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree, else what differs."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""
