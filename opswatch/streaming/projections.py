"""Incremental projections.

The folds are aggregates of minima and maxima, so the streaming state is exactly the accumulators of the batch
fold: late, repeated and reordered events give the batch result, and no watermark drops anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.operators.folds import OCCURRENCE_KEYS, fold_occurrences, fold_runs, summarize_schedules
from opswatch.sources.sinks import VERSION, read_keyed, upsert

BatchFunction = Callable[[DataFrame, int], None]


def run_projection_stream(events: DataFrame) -> DataFrame:
    """Changed run projections of every micro batch (update mode)."""
    return fold_runs(events)


def save_changes(path: str) -> BatchFunction:
    """Store the changed rows of a micro batch in a keyed table."""

    def save(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, batch_id)

    return save


def read_run_projections(spark: SparkSession, path: str, tasks: DataFrame) -> DataFrame:
    """Stored projections; the run's own status stands in where no event asserts one."""
    stored = read_keyed(spark, path, ["job_id"])
    own = tasks.select("job_id", F.col("status").alias("task_status"))
    status = F.coalesce("event_status", "task_status", F.lit("")).alias("current_status")
    joined = stored.join(own, "job_id", "left")
    return joined.select("job_id", status, *[c for c in stored.columns if c not in ("job_id", "event_status")])


def occurrence_stream(events: DataFrame) -> DataFrame:
    """Changed ledger rows of every micro batch (update mode)."""
    return fold_occurrences(events)


LEDGER_BUCKET = ["schedule_id"]


def save_ledger(ledger_path: str, summary_path: str) -> BatchFunction:
    """Store changed ledger rows, then the summaries of the schedules they touch, from the buckets of those schedules alone."""

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        upsert(batch, ledger_path, batch_id, LEDGER_BUCKET)
        changed = spark.read.parquet(f"{ledger_path}/{VERSION}={batch_id}").select("schedule_id").distinct()
        held = read_keyed(spark, ledger_path, list(OCCURRENCE_KEYS), only=changed)
        rows = held.join(changed, "schedule_id", "left_semi")
        upsert(summarize_schedules(rows), summary_path, batch_id)

    return save
