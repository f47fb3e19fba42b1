"""Compare a Spark result with the SQL that states what it should be."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

RAW = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def sorted_rows(rows, columns) -> list[str]:
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def assert_same(frame, con, sql: str) -> int:
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(expected_columns)
    expected = sorted_rows(result.fetchall(), expected_columns)
    actual = sorted_rows(frame.collect(), frame.columns)
    assert len(actual) == len(expected)
    different = [(a, e) for a, e in zip(actual, expected) if a != e]
    assert not different, different[:3]
    return len(actual)
