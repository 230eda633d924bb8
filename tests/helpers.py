"""Compares a Spark result with DuckDB's result for the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes, int)):
        return v
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[bool, str]:
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    if got == want:
        return True, f"{len(got)} rows; {dict(df.dtypes)} and {kinds}"
    odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return False, f"{len(got)} and {len(want)} rows; {sorted(df.columns)}; first differences {odd}"
