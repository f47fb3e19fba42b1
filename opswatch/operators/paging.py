"""Sorting and pages."""

from __future__ import annotations

import base64
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opswatch.functions.timing import instant

DEFAULT_LIMIT = 50
MAX_LIMIT = 200
TIMELINE_CAP = 1000
REPLAY_CAP = 500
QUEUE_HISTORY_CAP = 100
OCCURRENCE_CAP = 50


def sort_rows(df: DataFrame, spec: str | None, allowed: list[str], tie_breaker: str) -> DataFrame:
    """Order by ``key`` or ``-key`` with missing values last both ways; an unknown key leaves the order alone."""
    if not spec:
        return df
    desc, key = spec.startswith("-"), spec.removeprefix("-")
    if key not in allowed:
        return df
    column = F.col(key)
    return df.orderBy(column.desc_nulls_last() if desc else column.asc_nulls_last(), F.col(tie_breaker).asc())


def page_limit(limit: int | None) -> int:
    """Requested page size within 1 and the maximum; the default when none or not positive."""
    if limit is None or limit <= 0:
        return DEFAULT_LIMIT
    return min(limit, MAX_LIMIT)


def cursor_column(ts: Column, row_id: Column) -> Column:
    """Opaque cursor text of a row: base64 of ``<time>|<id>``, the time with its significant fraction digits."""
    fraction = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    stamp = F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("Z"),
    )
    return F.base64(F.encode(F.concat_ws("|", stamp, row_id.cast("string")), "UTF-8"))


def decode_cursor(cursor: str) -> tuple[datetime, int]:
    """Time and id held by a cursor."""
    stamp, _, row_id = base64.b64decode(cursor).decode().partition("|")
    return datetime.fromisoformat(stamp.replace("Z", "+00:00")), int(row_id)


def keyset_page(df: DataFrame, ts: str, row_id: str, limit: int | None = None, after: tuple | None = None) -> DataFrame:
    """Newest first page after a (time, id) position, with the cursor of every row."""
    if after is not None:
        at, last = instant(after[0]), F.lit(after[1])
        df = df.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(row_id) < last)))
    page = df.orderBy(F.col(ts).desc(), F.col(row_id).desc()).limit(page_limit(limit))
    return page.withColumn("cursor", cursor_column(F.col(ts), F.col(row_id)))


def offset_page(df: DataFrame, ts: str, row_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first page after skipping ``offset`` rows."""
    return df.orderBy(F.col(ts).desc(), F.col(row_id).desc()).offset(max(offset, 0)).limit(page_limit(limit))


def total_rows(df: DataFrame) -> DataFrame:
    """Exact total behind a page, as one row."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def capped(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """First ``cap`` rows in order, each flagged ``truncated`` when more existed.

    The window runs on the at most ``cap + 1`` rows the limit leaves.
    """
    fetched = df.orderBy(*order).limit(cap + 1)
    everything = Window.orderBy(*order)
    numbered = fetched.withColumn("position", F.row_number().over(everything)).withColumn(
        "truncated", F.count(F.lit(1)).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > cap
    )
    return numbered.filter(F.col("position") <= cap)


def page(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """All rows in order; where a limit is given its first rows, flagged ``truncated`` when more existed."""
    return df.orderBy(*order) if limit is None else capped(df, order, limit).drop("position")
