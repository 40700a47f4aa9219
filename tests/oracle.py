"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(tuple(x) if isinstance(x, tuple) else x) for x in r) for r in df.select(*names).toLocalIterator())


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def assert_same(df, con, sql: str, name: str = "") -> int:
    a, x = rows_of_spark(df)
    b, y = rows_of_sql(con, sql)
    assert a == b, f"{name}: columns {a} and {b}"
    assert x == y, f"{name}: only in Spark {list((x - y).items())[:3]}, only in SQL {list((y - x).items())[:3]}; {sum(x.values())} and {sum(y.values())} rows"
    return sum(x.values())
