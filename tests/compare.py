"""Order-free comparison of a Spark result with DuckDB's answer on the same tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

from catalog.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(bool(value))
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return f"{number:.6f}".rstrip("0").rstrip(".") if number else "0"
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(_cell(row[i]) for i in order) for row in rows))


def differences(df, con, sql, show=3):
    """(spark rows, sql rows, sample of differences); columns first."""
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return len(got[1]), len(want[1]), [("columns", got[0], want[0])]
    if got[1] == want[1]:
        return len(got[1]), len(want[1]), []
    only_got = [r for r in got[1] if r not in set(want[1])][:show]
    only_want = [r for r in want[1] if r not in set(got[1])][:show]
    return len(got[1]), len(want[1]), [("spark", only_got), ("sql", only_want)]
