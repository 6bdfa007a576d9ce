"""Compare a registered query with its SQL twin, row by row."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return f"{value:.10f}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.10g}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return repr(value)


def normal_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def oracle_rows(con, sql: str) -> tuple[list[str], list]:
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def compare(df, con, sql: str) -> str | None:
    """None if equal, else a short description of the difference."""
    columns, rows = oracle_rows(con, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    mine = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = normal_rows(columns, rows)
    if mine == theirs:
        return None
    only_mine = sorted(set(mine) - set(theirs))[:2]
    only_theirs = sorted(set(theirs) - set(mine))[:2]
    return f"{len(mine)} rows against {len(theirs)}; only here {only_mine}; only there {only_theirs}"
