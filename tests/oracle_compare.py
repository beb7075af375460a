"""Compare a Spark result with its DuckDB restatement, value by value."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf_dir) / table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences found, empty when the results are equal."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected_rows = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: {sorted(df.columns)} / {sorted(names)}"]
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    expected = _rows(names, expected_rows)
    if len(got) != len(expected):
        problems.append(f"row counts differ: {len(got)} / {len(expected)}")
    if got != expected:
        extra = [r for r in got if r not in set(expected)][:3]
        absent = [r for r in expected if r not in set(got)][:3]
        problems.append(f"values differ: {sorted(df.columns)}\n  only ours {extra}\n  only sql {absent}")
    return problems
