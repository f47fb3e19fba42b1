"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` for each key.

    A ``max_by`` aggregate rather than a window: every input partition keeps one row per key before the shuffle,
    so a key that holds a large share of the rows costs one row per task and never lands whole in one task.
    """
    kept = [c for c in (columns or df.columns) if c not in keys]
    row = F.struct(*kept) if kept else F.struct(F.lit(1).alias("one"))
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.max_by(row, rank).alias("row"))
    return picked.select(*keys, *[F.col("row")[c].alias(c) for c in kept])


def newest_heartbeats(heartbeats: DataFrame, key: str = "worker_id") -> DataFrame:
    """Newest heartbeat per worker or per instance."""
    return latest_per_key(heartbeats, [key], ["occurred_at", "id"])


def newest_queue_samples(samples: DataFrame) -> DataFrame:
    return latest_per_key(samples, ["queue_name"], ["sampled_at", "id"])


def newest_workers(workers: DataFrame, key: str = "worker_id") -> DataFrame:
    return latest_per_key(workers, [key], ["started_at", "id"])


def newest_attempts(attempts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Attempt with the highest number per run; ties by id."""
    return latest_per_key(attempts, ["job_id"], ["attempt_number", "attempt_id"], columns)
