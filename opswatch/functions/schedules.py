"""Schedule arithmetic: occurrence ids, lateness, skipped occurrences, definition hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opswatch.functions.timing import instant, seconds_between, shift


def occurrence_id(schedule_id: Column, expected_at: Column) -> Column:
    return F.concat(schedule_id, F.lit(":"), F.unix_seconds(expected_at).cast("string"))


def expected_from_occurrence_id(occurrence: Column) -> Column:
    """Expected time held by an occurrence id; NULL when the id carries none."""
    seconds = F.regexp_extract(occurrence, r":([+-]?\d+)$", 1)
    return F.timestamp_seconds(seconds.try_cast("bigint"))


def lateness(at: Column, expected_at: Column) -> Column:
    """Seconds late, never negative; NULL when either time is unknown."""
    late = seconds_between(at, expected_at)
    return F.when(late < 0, F.lit(0.0)).otherwise(late)


def skipped_count(expected_at: Column, now, interval_seconds: Column) -> Column:
    """How many further occurrences came due after ``expected_at`` and no later than ``now``."""
    late = seconds_between(now, expected_at)
    ok = (interval_seconds > 0) & (late > 0)
    return F.when(ok, F.floor(late / interval_seconds)).otherwise(F.lit(0)).cast("int")


def skipped_times(expected_at: Column, now, interval_seconds: Column, cap: int | None = None) -> Column:
    """Array of the passed-over times, oldest first; at most ``cap`` where one is given."""
    n = skipped_count(expected_at, now, interval_seconds)
    n = n if cap is None else F.least(n, F.lit(cap))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: shift(expected_at, k * interval_seconds))


def next_fire(now, interval_seconds: Column) -> Column:
    return shift(now, interval_seconds)


def definition_hash(task_name: Column, task_type: Column, payload: Column, interval_seconds: Column) -> Column:
    """Hash of what defines a schedule; run bookkeeping and the enabled flag are left out."""
    nul = F.lit("\0")
    parts: list[Column] = []
    for part in (task_name, task_type, payload, interval_seconds.cast("string")):
        parts += [F.coalesce(part, F.lit("")), nul]
    return F.sha2(F.concat(*parts), 256)


def clamp_run_at(run_at: Column, now) -> Column:
    """A run time in the past becomes ``now``."""
    return F.greatest(F.coalesce(run_at, instant(now)), instant(now))
