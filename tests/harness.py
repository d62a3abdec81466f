"""Run a registered query on Spark and its oracle text on DuckDB, and compare them value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from joulemill.tables import NAMES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (float, decimal.Decimal)):
        return format(round(float(value), 6) + 0.0, ".6f")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    return str(value)


def kind(value) -> str:
    for types, name in (((bool,), "bool"), ((int,), "int"), ((float, decimal.Decimal), "float"), ((str,), "str")):
        if isinstance(value, types):
            return name
    return type(value).__name__


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    kinds = {}
    for row in rows:
        for i in order:
            if row[i] is not None:
                kinds.setdefault(columns[i], kind(row[i]))
    return names, kinds, sorted(tuple(cell(row[i]) for i in order) for row in rows)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def difference(got, want) -> str | None:
    """None when equal, else a short description."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[2]) != len(want[2]):
        return f"rows {len(got[2])} != {len(want[2])}"
    for a, b in zip(got[2], want[2]):
        if a != b:
            return f"first difference {a} != {b}"
    shared = {c: (got[1][c], want[1][c]) for c in got[1] if c in want[1] and got[1][c] != want[1][c]}
    return f"kinds {shared}" if shared else None
