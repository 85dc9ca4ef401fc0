"""Runs a registered query and its reference SQL on the same files and compares them cell by
cell, after sorting columns by name and rows by value."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb

TYPES = {
    "int": {"INTEGER"}, "bigint": {"BIGINT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "date": {"DATE"},
    "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"},
}


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def table(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, sf: str, query, sql: str, con=None) -> list[str]:
    """Empty if equal, else what differs."""
    df = query(spark, sf)
    got_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want_rows = cur.fetchall()
    bad = []
    if sorted(df.columns) != sorted(want_cols):
        return [f"columns {sorted(df.columns)} != {sorted(want_cols)}"]
    for name, kind in df.dtypes:
        if want_types[name] not in TYPES.get(kind, {kind}):
            bad.append(f"type of {name}: {kind} vs {want_types[name]}")
    if len(got_rows) != len(want_rows):
        bad.append(f"rows {len(got_rows)} != {len(want_rows)}")
    got, want = table(df.columns, got_rows), table(want_cols, want_rows)
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        bad.append(f"{len(diff)} rows differ; columns {sorted(df.columns)}; first {diff[0]}")
    if not got:
        bad.append("no rows")
    return bad
