"""Validation of delivery rows: untrusted text fields become typed columns, unusable rows go to a reject set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE_ID = r"\A[A-Za-z0-9._:-]{1,64}\z"
SAFE_VERSION = r"\A[0-9A-Za-z.]{1,8}\z"
RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"


def usable(job_id: Column) -> Column:
    return F.coalesce(job_id.rlike(SAFE_ID), F.lit(False))


def safe_or_null(column: Column, pattern: str = SAFE_ID) -> Column:
    return F.when(column.rlike(pattern), column)


def parse_delivery(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Bad optional fields become NULL; keys that are not part of an envelope are dropped."""
    created = F.when(F.col("created_at").rlike(RFC3339), F.try_to_timestamp("created_at"))
    accepted = rows.filter(usable(F.col("job_id"))).select(
        "id",
        "job_id",
        safe_or_null(F.col("correlation_id")).alias("correlation_id"),
        safe_or_null(F.col("trace_id")).alias("trace_id"),
        created.alias("created_at"),
        safe_or_null(F.col("schema_version"), SAFE_VERSION).alias("schema_version"),
    )
    rejected = rows.filter(~usable(F.col("job_id"))).select("id", "job_id", F.lit("delivery.malformed").alias("event_type"))
    return accepted, rejected
