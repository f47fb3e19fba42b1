"""Schedule ledger, summaries, definition changes and skipped occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.catalog.registry import query
from opswatch.catalog.shared import LEDGER_SQL, STORED, ledger, number_of, schedule_summary, with_projections
from opswatch.functions.schedules import clamp_run_at, expected_from_occurrence_id
from opswatch.operators import filters, folds, paging
from opswatch.plans import reports, runs, schedules
from opswatch.sources.tables import Tables
from opswatch.sources.views import NOW


@query("occurrence_ledger", LEDGER_SQL)
def _(t: Tables) -> DataFrame:
    return ledger(t)


SUMMARY_SQL = """
SELECT schedule_id, max(expected_at) AS last_expected_at, max_by(occurrence_id, (expected_at, occurrence_id)) AS last_occurrence_id,
 max_by(coalesce(run_id, '-'), (expected_at, occurrence_id)) FILTER (WHERE outcome = 'CREATED') AS last_run_id,
 nullif(max_by(coalesce(creation_lateness_seconds, -1), (expected_at, occurrence_id)) FILTER (WHERE outcome = 'CREATED'), -1) AS last_creation_lateness_seconds,
 nullif(max_by(coalesce(start_lateness_seconds, -1), (expected_at, occurrence_id)) FILTER (WHERE outcome = 'CREATED'), -1) AS last_start_lateness_seconds,
 count(*) FILTER (WHERE outcome = 'CREATED') AS occurrences_created, count(*) FILTER (WHERE outcome = 'SKIPPED') AS occurrences_skipped,
 max(recorded_at) FILTER (WHERE outcome = 'SKIPPED') AS last_skipped_at, max(last_event_at) AS last_event_at
FROM ledger GROUP BY schedule_id"""


@query("schedule_summary", SUMMARY_SQL, STORED)
def _(t: Tables) -> DataFrame:
    return schedule_summary(t)


BACKFILL_SQL = """
SELECT coalesce(l.schedule_id, t.schedule_id) AS schedule_id, coalesce(l.occurrence_id, t.occ) AS occurrence_id, coalesce(l.expected_at, t.expected_at) AS expected_at,
 CASE WHEN l.outcome = 'SKIPPED' OR t.occ IS NULL THEN l.outcome ELSE 'CREATED' END AS outcome,
 CASE WHEN l.outcome = 'SKIPPED' THEN l.run_id ELSE coalesce(l.run_id, t.job_id) END AS run_id,
 CASE WHEN l.outcome = 'SKIPPED' THEN l.creation_lateness_seconds ELSE coalesce(l.creation_lateness_seconds,
  CASE WHEN t.created_at IS NOT NULL THEN greatest(epoch_us(t.created_at) - epoch_us(coalesce(l.expected_at, t.expected_at)), 0) / 1000000.0::DOUBLE END) END AS creation_lateness_seconds,
 CASE WHEN l.outcome = 'SKIPPED' THEN l.start_lateness_seconds ELSE coalesce(l.start_lateness_seconds,
  CASE WHEN s.started_at IS NOT NULL THEN greatest(epoch_us(s.started_at) - epoch_us(coalesce(l.expected_at, t.expected_at)), 0) / 1000000.0::DOUBLE END) END AS start_lateness_seconds,
 coalesce(l.recorded_at, t.created_at) AS recorded_at, coalesce(l.last_event_at, t.created_at) AS last_event_at
FROM ledger AS l FULL JOIN (SELECT *, schedule_occurrence_id AS occ FROM tasks WHERE schedule_id <> '' AND expected_at IS NOT NULL AND retry_index = 0
  QUALIFY row_number() OVER (PARTITION BY schedule_occurrence_id ORDER BY id) = 1) AS t ON t.occ = l.occurrence_id
LEFT JOIN (SELECT k.schedule_occurrence_id AS occ, p.started_at FROM tasks AS k JOIN fold AS p ON p.job_id = k.job_id AND p.started_at IS NOT NULL
  WHERE k.schedule_id <> '' AND k.expected_at IS NOT NULL AND k.retry_index = 0 QUALIFY row_number() OVER (PARTITION BY k.schedule_occurrence_id ORDER BY k.id) = 1) AS s ON s.occ = t.occ"""


def partial_ledger_events(t: Tables) -> DataFrame:
    """Schedule events of two thirds of the schedules; the rest is known from tasks only."""
    return t.occurrence_events.filter(number_of("schedule_id") % 3 != 1)


PARTIAL = {**STORED, "ledger": LEDGER_SQL.replace("WHERE schedule_occurrence_id <> ''", "WHERE CAST(substr(schedule_id, 2) AS BIGINT) % 3 <> 1 AND schedule_occurrence_id <> ''")}


@query("ledger_backfill", BACKFILL_SQL, PARTIAL)
def _(t: Tables) -> DataFrame:
    projected = with_projections(t)
    return folds.occurrence_ledger(partial_ledger_events(t), projected.tasks, projected.run_projections)


@query(
    "reconcile_ledger",
    """SELECT class, count(*) AS n FROM (SELECT CASE WHEN n % 7 = 0 THEN 'MISSING' WHEN n % 11 = 0 AND creation_lateness_seconds IS NOT NULL THEN 'WRONG' ELSE 'OK' END AS class
 FROM (SELECT *, CAST(split_part(occurrence_id, ':', 2) AS BIGINT) // 86400 AS n FROM ledger) AS x) AS y GROUP BY class""",
    STORED,
)
def _(t: Tables) -> DataFrame:
    """Ledger against a damaged stored copy: some rows missing, some lateness off by more than the tolerance."""
    computed = ledger(t)
    day = F.floor(F.split_part("occurrence_id", F.lit(":"), F.lit(2)).cast("bigint") / 86400)
    off = F.when(day % 11 == 0, F.lit(0.5)).otherwise(F.lit(0.0004))
    stored = computed.filter(day % 7 != 0).withColumn("creation_lateness_seconds", F.col("creation_lateness_seconds") + off)
    return runs.reconcile_report(runs.reconcile_occurrences(computed, stored))


@query("reconcile_schedules", "SELECT 'OK' AS class, count(*) AS n FROM (SELECT DISTINCT schedule_id FROM occurrence_events WHERE schedule_occurrence_id <> '') AS x")
def _(t: Tables) -> DataFrame:
    """Summaries rebuilt twice agree."""
    return runs.reconcile_report(runs.reconcile_schedules(schedule_summary(t), schedule_summary(t)))


@query(
    "schedule_diff",
    """SELECT d.schedule_id, c.change FROM (SELECT *, sha256(concat(task_name, chr(0), task_type, chr(0), payload, chr(0), CAST(interval_seconds AS VARCHAR), chr(0))) AS h FROM schedule_definitions) AS d
LEFT JOIN schedule_snapshots AS s ON s.schedule_id = d.schedule_id, (VALUES ('created'), ('updated'), ('enabled'), ('disabled')) AS c(change)
WHERE CASE c.change WHEN 'created' THEN s.schedule_id IS NULL WHEN 'updated' THEN s.definition_hash <> d.h WHEN 'enabled' THEN d.enabled AND NOT s.enabled ELSE s.enabled AND NOT d.enabled END""",
)
def _(t: Tables) -> DataFrame:
    return schedules.schedule_changes(t.schedule_definitions, t.schedule_snapshots)


@query("schedule_seed", "SELECT schedule_id, 'seed' AS change FROM schedule_definitions")
def _(t: Tables) -> DataFrame:
    return schedules.schedule_changes(t.schedule_definitions, t.schedule_snapshots, seeded=False)


SKIPPED = """SELECT schedule_id, CAST(k AS INT) AS k, next_run_at + INTERVAL '1' SECOND * (k * interval_seconds) AS expected_at,
 concat(schedule_id, ':', CAST(epoch(next_run_at) AS BIGINT) + k * interval_seconds) AS occurrence_id
FROM (SELECT *, unnest(range(1, (epoch_us($NOW) - epoch_us(next_run_at)) // (interval_seconds * 1000000) + 1)) AS k
 FROM schedule_definitions WHERE enabled AND next_run_at <= $NOW AND interval_seconds > 0) AS x"""


@query("skipped_occurrences", SKIPPED)
@query("skipped_occurrences_all", SKIPPED)
def _(t: Tables) -> DataFrame:
    return schedules.skipped_occurrences(t.schedule_definitions, NOW)


@query(
    "fired_schedules",
    """SELECT schedule_id, concat(schedule_id, ':', CAST(epoch(next_run_at) AS BIGINT)) AS occurrence_id, next_run_at AS expected_at,
 CASE WHEN interval_seconds > 0 THEN (epoch_us($NOW) - epoch_us(next_run_at)) // (interval_seconds * 1000000) ELSE 0 END AS skipped_count,
 $NOW + INTERVAL '1' SECOND * interval_seconds AS next_run_at FROM schedule_definitions WHERE enabled AND next_run_at <= $NOW""",
)
def _(t: Tables) -> DataFrame:
    return schedules.fired_schedules(t.schedule_definitions, NOW)


@query("schedules_filtered", "SELECT schedule_id, enabled, next_run_at FROM schedule_definitions WHERE enabled AND contains(schedule_id, 's12')")
def _(t: Tables) -> DataFrame:
    return filters.search_schedules(t.schedule_definitions, "S12", True).select("schedule_id", "enabled", "next_run_at")


@query(
    "occurrence_times",
    "SELECT job_id, schedule_occurrence_id AS occurrence_id, CASE WHEN schedule_occurrence_id <> '' THEN created_at END AS expected_at, greatest(run_at, TIMESTAMP '1996-01-01') AS run_at FROM tasks",
)
def _(t: Tables) -> DataFrame:
    occurrence = F.col("schedule_occurrence_id")
    return t.tasks.select(
        "job_id", occurrence.alias("occurrence_id"), expected_from_occurrence_id(occurrence).alias("expected_at"),
        clamp_run_at(F.col("run_at"), "1996-01-01 00:00:00").alias("run_at"),
    )


@query(
    "schedule_runs",
    """SELECT t.schedule_id, t.id, t.job_id AS run_id, t.status, t.created_at, t.expected_at, p.started_at, (epoch_us(t.created_at) - epoch_us(t.expected_at)) / 1000000.0::DOUBLE AS creation_drift_seconds,
 (epoch_us(p.started_at) - epoch_us(t.expected_at)) / 1000000.0::DOUBLE AS start_drift_seconds FROM tasks AS t LEFT JOIN fold AS p ON p.job_id = t.job_id WHERE t.schedule_id <> ''""",
    STORED,
)
def _(t: Tables) -> DataFrame:
    return reports.schedule_runs(with_projections(t))


@query(
    "schedule_detail",
    """SELECT t.job_id AS run_id, t.status, t.created_at, (epoch_us(t.created_at) - epoch_us(t.expected_at)) / 1000000.0::DOUBLE AS creation_drift_seconds FROM tasks AS t
WHERE schedule_id = 's7' ORDER BY created_at DESC, id DESC LIMIT 100""",
)
def _(t: Tables) -> DataFrame:
    return reports.schedule_runs(with_projections(t), "s7", 100).select("run_id", "status", "created_at", "creation_drift_seconds")


@query(
    "schedule_detail_all",
    """SELECT t.job_id AS run_id, t.status, t.created_at, (epoch_us(t.created_at) - epoch_us(t.expected_at)) / 1000000.0::DOUBLE AS creation_drift_seconds FROM tasks AS t
WHERE schedule_id = 's7'""",
)
def _(t: Tables) -> DataFrame:
    return reports.schedule_runs(with_projections(t), "s7").select("run_id", "status", "created_at", "creation_drift_seconds")


@query("schedule_occurrences", "SELECT * FROM ledger WHERE schedule_id = 's7' ORDER BY expected_at DESC, occurrence_id DESC LIMIT 50", STORED)
def _(t: Tables) -> DataFrame:
    return reports.schedule_occurrences(ledger(t), "s7", paging.OCCURRENCE_CAP).drop("truncated")


@query("schedule_occurrences_all", "SELECT * FROM ledger WHERE schedule_id = 's7'", STORED)
def _(t: Tables) -> DataFrame:
    return reports.schedule_occurrences(ledger(t), "s7")


@query(
    "schedule_cards",
    """SELECT r.*, coalesce(m.n, 0) AS missed_delayed FROM (
 SELECT schedule_id, count(*) FILTER (WHERE drift > 30) AS late_starts, count(*) FILTER (WHERE status = 'Failed') AS recent_failures, greatest(coalesce(max(drift), 0), 0) AS worst_start_drift,
  max(creation) FILTER (WHERE rn = 1) AS latest_creation_drift, max(drift) FILTER (WHERE rn = 1) AS latest_start_drift,
  concat(count(*) FILTER (WHERE status = 'Completed'), ' ok / ', count(*) FILTER (WHERE status = 'Failed'), ' failed',
   CASE WHEN count(*) FILTER (WHERE status NOT IN ('Completed', 'Failed')) > 0 THEN concat(' / ', count(*) FILTER (WHERE status NOT IN ('Completed', 'Failed')), ' other') ELSE '' END) AS results
 FROM (SELECT t.*, (epoch_us(t.created_at) - epoch_us(t.expected_at)) / 1000000.0::DOUBLE AS creation, (epoch_us(p.started_at) - epoch_us(t.expected_at)) / 1000000.0::DOUBLE AS drift,
   row_number() OVER (PARTITION BY t.schedule_id ORDER BY t.created_at DESC, t.id DESC) AS rn FROM tasks AS t LEFT JOIN fold AS p ON p.job_id = t.job_id WHERE t.schedule_id <> '') AS x GROUP BY schedule_id) AS r
LEFT JOIN (SELECT subject_id, count(*) AS n FROM annotations WHERE subject_type = 'SCHEDULE' AND regexp_matches(type, 'MISSED|DELAYED') GROUP BY 1) AS m ON m.subject_id = r.schedule_id""",
    STORED,
)
def _(t: Tables) -> DataFrame:
    return reports.schedule_cards(reports.schedule_runs(with_projections(t)), t.annotations)


@query(
    "outcome_counts",
    "SELECT schedule_id, count(*) FILTER (WHERE outcome = 'CREATED') AS created, count(*) FILTER (WHERE outcome = 'SKIPPED') AS skipped, count(*) FILTER (WHERE outcome = 'DUE') AS due FROM ledger GROUP BY schedule_id",
    STORED,
)
def _(t: Tables) -> DataFrame:
    return reports.outcome_counts(ledger(t))
