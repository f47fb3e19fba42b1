"""Schedule definitions: changes against the stored snapshot, skipped and next occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.functions.schedules import (
    definition_hash,
    next_fire,
    occurrence_id,
    skipped_count,
)
from opswatch.functions.timing import shift
from opswatch.operators.filters import due_schedules

#: occurrences made from one row at once
CHUNK = 4096


def with_hash(definitions: DataFrame) -> DataFrame:
    return definitions.withColumn(
        "definition_hash",
        definition_hash(F.col("task_name"), F.col("task_type"), F.col("payload"), F.col("interval_seconds")),
    )


def schedule_changes(definitions: DataFrame, snapshots: DataFrame, seeded: bool = True) -> DataFrame:
    """Changes since the snapshot: created, updated, enabled, disabled; everything is ``seed`` on the first run.

    One definition can yield two changes.
    """
    current = with_hash(definitions).select("schedule_id", "enabled", "definition_hash")
    if not seeded:
        return current.select("schedule_id", F.lit("seed").alias("change"))
    before = snapshots.select(
        "schedule_id", F.col("enabled").alias("was_enabled"), F.col("definition_hash").alias("old_hash")
    )
    known = F.col("old_hash").isNotNull()
    kinds = F.array(
        F.when(~known, F.lit("created")),
        F.when(known & (F.col("old_hash") != F.col("definition_hash")), F.lit("updated")),
        F.when(
            known & (F.col("enabled") != F.col("was_enabled")),
            F.when(F.col("enabled"), F.lit("enabled")).otherwise(F.lit("disabled")),
        ),
    )
    changed = current.join(before, "schedule_id", "left").select("schedule_id", F.explode(F.array_compact(kinds)).alias("change"))
    return changed


def new_snapshots(definitions: DataFrame) -> DataFrame:
    """Snapshot to store after the changes were announced."""
    return with_hash(definitions).select("schedule_id", "definition_hash", "enabled")


def fired_schedules(definitions: DataFrame, now) -> DataFrame:
    """Due schedules with the occurrence they fire, how many were passed over, and the next run time."""
    interval = F.col("interval_seconds")
    return due_schedules(definitions, now).select(
        "schedule_id",
        occurrence_id(F.col("schedule_id"), F.col("next_run_at")).alias("occurrence_id"),
        F.col("next_run_at").alias("expected_at"),
        skipped_count(F.col("next_run_at"), now, interval).alias("skipped_count"),
        next_fire(now, interval).alias("next_run_at"),
    )


def skipped_occurrences(definitions: DataFrame, now, cap: int | None = None) -> DataFrame:
    """One row per passed-over occurrence of every due schedule, at most the ``cap`` oldest of each where one is given.

    A schedule's occurrences are made in chunks that are dealt out, so no row holds more than one chunk.
    """
    count = skipped_count(F.col("next_run_at"), now, F.col("interval_seconds"))
    n = count if cap is None else F.least(count, F.lit(cap))
    due = due_schedules(definitions, now).select("schedule_id", "next_run_at", "interval_seconds", n.alias("n")).filter("n > 0")
    chunks = due.select("*", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / CHUNK).cast("int"))).alias("chunk"))
    first = F.col("chunk") * CHUNK + 1
    last = F.col("n") - F.greatest(F.col("n") - F.col("chunk") * CHUNK - CHUNK, F.lit(0))
    dealt = chunks.repartition("schedule_id", "chunk")
    rows = dealt.select("*", F.explode(F.sequence(first, last)).alias("k"))
    return rows.withColumn("expected_at", shift(F.col("next_run_at"), F.col("k") * F.col("interval_seconds"))).select(
        "schedule_id",
        "k",
        "expected_at",
        occurrence_id(F.col("schedule_id"), F.col("expected_at")).alias("occurrence_id"),
    )
