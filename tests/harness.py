"""Side-by-side comparison of a Spark query with its SQL twin in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int):
        return (2, str(v))
    if isinstance(v, float):
        return (3, "nan" if math.isnan(v) else repr(v + 0.0))
    return (4, str(v))


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())


def difference(df, con, sql: str) -> str | None:
    """NULL when both give the same columns and rows, else what differs first."""
    names, ours = spark_rows(df)
    cols, theirs = duck_rows(con, sql)
    if names != cols:
        return f"columns {names} != {cols}"
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return f"rows {len(ours)} / {len(theirs)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
