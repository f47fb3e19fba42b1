"""Expected-result SQL shared by several queries, and the stored tables derived from the sample data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.operators.folds import occurrence_ledger, run_projections, summarize_schedules
from opswatch.sources.tables import Tables

# Fold of the run log, written as windows over the ordered events.
FOLD_SQL = """
SELECT p.job_id, coalesce(p.event_status, t.status, '') AS current_status, queued_at, started_at, completed_at, last_event_at,
 recovery_started, recovery_started AS was_reclaimed, contradicted, contradiction_note
FROM (
 SELECT job_id,
  CASE WHEN max(term_rn) IS NOT NULL THEN max(first_terminal) ELSE
   CASE greatest(max(CASE WHEN rn > rec_rn THEN rank END), CASE WHEN max(rec_rn) > 0 THEN 20 END)
    WHEN 10 THEN 'Pending' WHEN 20 THEN 'Queued' WHEN 30 THEN 'Running' END END AS event_status,
  min(CASE WHEN s = 'Queued' THEN occurred_at END) AS queued_at, min(CASE WHEN s = 'Running' THEN occurred_at END) AS started_at,
  min(CASE WHEN s IN ('Completed', 'Failed') THEN occurred_at END) AS completed_at, max(occurred_at) AS last_event_at,
  bool_or(event_type = 'task.recovery_started') AS recovery_started,
  count(DISTINCT CASE WHEN rank = 40 THEN s END) > 1 AS contradicted,
  coalesce(string_agg(CASE WHEN rank = 40 AND s <> first_terminal AND kind_rn = 1 THEN concat(substr(event_type, 6), ' after ', first_terminal) END, '; ' ORDER BY rn), '') AS contradiction_note
 FROM (
  SELECT *, max(CASE WHEN event_type = 'task.recovery_started' THEN rn ELSE 0 END) OVER (PARTITION BY job_id) AS rec_rn,
   min(CASE WHEN rank = 40 THEN rn END) OVER (PARTITION BY job_id) AS term_rn,
   first_value(CASE WHEN rank = 40 THEN s END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_terminal,
   row_number() OVER (PARTITION BY job_id, s ORDER BY rn) AS kind_rn
  FROM (
   SELECT *, CASE event_type WHEN 'task.created' THEN 'Pending' WHEN 'task.queued' THEN 'Queued' WHEN 'task.started' THEN 'Running'
     WHEN 'task.completed' THEN 'Completed' WHEN 'task.failed' THEN 'Failed' WHEN 'task.blocked' THEN 'Blocked' END AS s,
    CASE event_type WHEN 'task.created' THEN 10 WHEN 'task.queued' THEN 20 WHEN 'task.started' THEN 30
     WHEN 'task.completed' THEN 40 WHEN 'task.failed' THEN 40 WHEN 'task.blocked' THEN 40 END AS rank,
    row_number() OVER (PARTITION BY job_id ORDER BY occurred_at, producer_id, producer_sequence, id) AS rn
   FROM event_log WHERE event_type <> 'attempt.heartbeat') AS a) AS b
 GROUP BY job_id) AS p LEFT JOIN tasks AS t ON t.job_id = p.job_id"""

LEDGER_SQL = """
SELECT schedule_id, occurrence_id, expected_at, outcome, run_id,
 CASE WHEN outcome = 'CREATED' AND created_at IS NOT NULL THEN greatest(epoch_us(created_at) - epoch_us(expected_at), 0) / 1000000.0::DOUBLE END AS creation_lateness_seconds,
 CASE WHEN outcome = 'CREATED' AND started_at IS NOT NULL THEN greatest(epoch_us(started_at) - epoch_us(expected_at), 0) / 1000000.0::DOUBLE
  END AS start_lateness_seconds, recorded_at, last_event_at
FROM (
 SELECT schedule_id, schedule_occurrence_id AS occurrence_id,
  to_timestamp(CAST(split_part(schedule_occurrence_id, ':', 2) AS BIGINT)) AT TIME ZONE 'UTC' AS expected_at,
  CASE WHEN min(CASE WHEN kind = 'C' THEN rn END) < coalesce(min(CASE WHEN kind = 'S' THEN rn END), 999999999) THEN 'CREATED'
       WHEN min(CASE WHEN kind = 'S' THEN rn END) IS NOT NULL THEN 'SKIPPED' ELSE 'DUE' END AS outcome,
  CASE WHEN min(CASE WHEN kind = 'C' THEN rn END) < coalesce(min(CASE WHEN kind = 'S' THEN rn END), 999999999)
   THEN arg_min(job_id, rn) FILTER (WHERE kind = 'C' AND job_id <> '') END AS run_id,
  arg_min(occurred_at, rn) FILTER (WHERE event_type = 'schedule.occurrence_run_created') AS created_at,
  arg_min(occurred_at, rn) FILTER (WHERE event_type = 'attempt.started') AS started_at,
  min(occurred_at) AS recorded_at, max(occurred_at) AS last_event_at
 FROM (SELECT *, CASE event_type WHEN 'schedule.occurrence_due' THEN 'D' WHEN 'schedule.occurrence_skipped' THEN 'S' ELSE 'C' END AS kind,
   row_number() OVER (PARTITION BY schedule_occurrence_id ORDER BY occurred_at, producer_id, producer_sequence, id) AS rn
  FROM occurrence_events WHERE schedule_occurrence_id <> '' AND (event_type <> 'attempt.started' OR retry_index = 0)) AS e
 GROUP BY schedule_id, schedule_occurrence_id) AS o"""

STORED = {"fold": FOLD_SQL, "ledger": LEDGER_SQL}


def with_projections(tables: Tables) -> Tables:
    """Tables with the run projections computed from the run log."""
    return tables.with_tables(run_projections=run_projections(tables.event_log, tables.tasks))


def ledger(tables: Tables) -> DataFrame:
    return occurrence_ledger(tables.occurrence_events)


def schedule_summary(tables: Tables) -> DataFrame:
    return summarize_schedules(ledger(tables))


def number_of(column: str):
    """Digits of an id such as ``j17`` as a number."""
    return F.regexp_extract(column, "[0-9]+", 0).cast("bigint")
