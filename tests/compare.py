"""Run a registered query and its SQL on the same tables and compare names, types and rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _kind(value) -> str:
    return type(value).__name__


def compare(df, con, sql: str) -> str | None:
    """None where both agree, else what differs."""
    cursor = con.execute(sql)
    sql_columns = [c[0] for c in cursor.description]
    want_rows = cursor.fetchall()
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    names = sorted(df.columns)
    at = [sql_columns.index(n) for n in names]
    got = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    want = Counter(tuple(_plain(r[i]) for i in at) for r in want_rows)
    if got == want:
        kinds = {n: {_kind(r[i]) for r in got} - {"NoneType"} for i, n in enumerate(names)}
        other = {n: {_kind(r[i]) for r in want} - {"NoneType"} for i, n in enumerate(names)}
        return None if kinds == other else f"value types {kinds} != {other}"
    return (f"rows {sum(got.values())} vs {sum(want.values())}; only in Spark "
            f"{list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}; {names}")
