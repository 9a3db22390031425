"""Runs a registered query in Spark and its SQL in DuckDB and compares the results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return v


def _family(kind: str) -> str:
    k = kind.lower()
    if "bool" in k:
        return "bool"
    if any(t in k for t in ("hugeint", "decimal")):
        return "wide"
    if "bigint" in k or k == "long":
        return "bigint"
    if "int" in k:
        return "int"
    if any(t in k for t in ("double", "float")):
        return "double"
    if any(t in k for t in ("varchar", "string")):
        return "string"
    return k


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(spark_df.columns)
    got = sorted(
        (tuple(_plain(r[n]) for n in names) for r in spark_df.collect()), key=repr
    )
    rel = con.sql(sql)
    theirs = sorted(rel.columns)
    if names != theirs:
        return f"columns {names} != {theirs}"
    position = [rel.columns.index(n) for n in theirs]
    want = sorted((tuple(_plain(r[i]) for i in position) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:2]} vs {want[:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"first difference {a} != {b}"
    kinds = dict(spark_df.dtypes)
    for n, i in zip(theirs, position, strict=True):
        if _family(kinds[n]) != _family(str(rel.types[i])):
            return f"type of {n}: {kinds[n]} != {rel.types[i]}"
    return None
