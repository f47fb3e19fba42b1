"""Retention and rebuild jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.functions.timing import instant, shift

DEFAULT_RETENTION_HOURS = 24


def split_expired(df: DataFrame, column: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) rows by a time column; rows without a time are kept."""
    expired = F.coalesce(F.col(column) < instant(cutoff), F.lit(False))
    return df.filter(~expired), df.filter(expired)


def retention(df: DataFrame, column: str, now, hours: float = DEFAULT_RETENTION_HOURS) -> DataFrame:
    """Rows that stay; hours below 1 keep everything."""
    return df if hours < 1 else split_expired(df, column, shift(now, -hours * 3600))[0]


def retention_report(tables: dict[str, tuple[DataFrame, str, float]], now) -> DataFrame:
    """Per table how many rows stay and go. ``tables`` maps a name to (rows, time column, hours)."""
    parts = []
    for name, (df, column, hours) in tables.items():
        cutoff = shift(now, -hours * 3600)
        expired = F.coalesce(F.col(column) < cutoff, F.lit(False)) if hours >= 1 else F.lit(False)
        parts.append(
            df.agg(F.count_if(~expired).alias("kept"), F.count_if(expired).alias("removed")).select(
                F.lit(name).alias("table_name"), "kept", "removed"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def expire_bodies(artifacts: DataFrame, now, hours: float) -> DataFrame:
    """Artifacts with the bodies older than the cutoff blanked; the rows stay."""
    old = ~F.col("body_expired") & (F.col("produced_at") < shift(now, -hours * 3600))
    return artifacts.withColumn("sanitized_body", F.when(old, F.lit("")).otherwise(F.col("sanitized_body"))).withColumn(
        "body_expired", F.col("body_expired") | F.coalesce(old, F.lit(False))
    )
