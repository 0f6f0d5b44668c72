"""Run a registered query and its SQL twin side by side and compare them."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.9g}" if math.isfinite(v) else str(v)
    return str(v)


def _kind(t: str) -> str:
    t = t.lower()
    if t in ("double", "float"):
        return "double"
    if t in ("int", "integer"):
        return "int"
    if t in ("bigint", "long"):
        return "bigint"
    if t in ("varchar", "string"):
        return "string"
    return t


def spark_rows(df):
    cols = sorted(df.columns)
    kinds = [_kind(dict(df.dtypes)[c]) for c in cols]
    rows = [tuple(_cell(r[c]) for c in cols) for r in (x.asDict() for x in df.collect())]
    return cols, kinds, rows


def sql_rows(con, sql: str):
    rel = con.sql(sql)
    names, types = rel.columns, [str(t) for t in rel.types]
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = rel.fetchall()
    return (
        [names[i] for i in order],
        [_kind(types[i]) for i in order],
        [tuple(_cell(r[i]) for i in order) for r in data],
    )


def compare(spark_result, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    c1, k1, r1 = spark_rows(spark_result)
    c2, k2, r2 = sql_rows(con, sql)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if k1 != k2:
        return f"types {list(zip(c1, k1, k2))}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}"
    if not r1:
        return "no rows"
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    a, b = sorted(r1, key=key), sorted(r2, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {c1}, first: {bad[0]}"
    return None
