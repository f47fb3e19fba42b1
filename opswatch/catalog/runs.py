"""Run projections, counts, filters, pages, chains and reconciliation."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.catalog.registry import query
from opswatch.catalog.shared import FOLD_SQL, STORED, number_of, with_projections
from opswatch.functions.status import (
    asserted_status,
    attempt_kind,
    failure_category,
    is_terminal,
    latest_transition,
    status_class,
    status_label,
    status_of,
    status_rank,
)
from opswatch.functions.timing import shift
from opswatch.operators import filters, folds, latest, paging
from opswatch.plans import maintenance, runs, timeline
from opswatch.plans.reports import side_by_side
from opswatch.sources.delivery import parse_delivery
from opswatch.sources.sinks import append, append_new, read_keyed, rebuild, upsert, version_log
from opswatch.sources.tables import Tables, events_for, visible
from opswatch.sources.views import NOW
from opswatch.streaming.sources import fresh_folder



def secs(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier})) / 1000000.0::DOUBLE"


@query("run_projection", FOLD_SQL)
def _(t: Tables) -> DataFrame:
    return folds.run_projections(t.event_log, t.tasks)


COUNTS_SQL = """
SELECT t.job_id, coalesce(a.n, 0) AS attempt_count, a.latest_attempt_id, a.latest_attempt_status, a.latest_worker_id,
 coalesce(f.n, 0) AS pii_finding_count, coalesce(m.n, 0) AS active_annotation_count, coalesce(al.n, 0) AS open_alert_count
FROM tasks AS t
LEFT JOIN (SELECT job_id, max(n) AS n, max(attempt_id) FILTER (WHERE rn = 1) AS latest_attempt_id, max(status) FILTER (WHERE rn = 1) AS latest_attempt_status,
  max(worker_id) FILTER (WHERE rn = 1) AS latest_worker_id
 FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n, row_number() OVER (PARTITION BY job_id ORDER BY attempt_number DESC, attempt_id DESC) AS rn FROM attempts) AS x
 GROUP BY job_id) AS a ON a.job_id = t.job_id
LEFT JOIN (SELECT job_id, count(*) AS n FROM findings GROUP BY job_id) AS f ON f.job_id = t.job_id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM annotations WHERE subject_type IN ('RUN', 'TASK') AND resolved_at IS NULL GROUP BY 1) AS m ON m.subject_id = t.job_id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM alerts WHERE subject_type IN ('RUN', 'TASK') AND status = 'OPEN' GROUP BY 1) AS al ON al.subject_id = t.job_id"""


@query("run_counts", COUNTS_SQL)
def _(t: Tables) -> DataFrame:
    return runs.run_counts(t, t.tasks)


FULL_SQL = """
SELECT t.job_id, coalesce(p.current_status, t.status) AS current_status, p.queued_at, p.started_at, p.completed_at, p.last_event_at,
 coalesce(p.recovery_started, false) AS recovery_started, coalesce(p.was_reclaimed, false) AS was_reclaimed,
 coalesce(p.contradicted, false) AS contradicted, coalesce(p.contradiction_note, '') AS contradiction_note,
 c.attempt_count, c.latest_attempt_id, c.latest_attempt_status, c.latest_worker_id, c.pii_finding_count, c.active_annotation_count, c.open_alert_count
FROM tasks AS t LEFT JOIN fold AS p ON p.job_id = t.job_id JOIN counts AS c ON c.job_id = t.job_id"""
WIDE = {**STORED, "counts": COUNTS_SQL, "full_projection": FULL_SQL}


@query("full_run_projection", FULL_SQL, WIDE)
def _(t: Tables) -> DataFrame:
    return runs.full_run_projections(t)


def stored_projections(t: Tables) -> DataFrame:
    """A stored copy with every kind of damage: rows missing, wrong counts and times, rows of no run."""
    n = number_of("job_id")
    full = runs.full_run_projections(t)
    damaged = full.filter(n % 13 != 0).withColumn("open_alert_count", F.col("open_alert_count") + F.when(n % 17 == 0, 1).otherwise(0)).withColumn(
        "last_event_at", F.when(n % 19 == 0, F.col("last_event_at") + F.expr("INTERVAL '1' SECOND")).otherwise(F.col("last_event_at"))
    )
    junk = full.filter(n % 23 == 0).withColumn("job_id", F.concat(F.lit("x"), F.col("job_id")))
    return damaged.unionByName(junk)


@query(
    "reconcile_runs",
    """
SELECT class, count(*) AS n FROM (
 SELECT CASE WHEN n % 13 = 0 THEN 'MISSING' WHEN n % 17 = 0 OR (n % 19 = 0 AND last_event_at IS NOT NULL) THEN 'WRONG' ELSE 'OK' END AS class
 FROM (SELECT *, CAST(substr(job_id, 2) AS BIGINT) AS n FROM full_projection) AS x
 UNION ALL SELECT 'JUNK' FROM full_projection WHERE CAST(substr(job_id, 2) AS BIGINT) % 23 = 0) AS y GROUP BY class""",
    WIDE,
)
def _(t: Tables) -> DataFrame:
    return runs.reconcile_report(runs.reconcile_runs(t, stored_projections(t)))


@query("orphan_projections", "SELECT p.job_id, p.current_status FROM fold AS p WHERE NOT EXISTS (SELECT 1 FROM tasks AS t WHERE t.job_id = p.job_id AND t.id % 2 = 0)", STORED)
def _(t: Tables) -> DataFrame:
    """Projections without a run once half of the runs are gone."""
    projected = folds.run_projections(t.event_log, t.tasks)
    return runs.orphans(projected, t.tasks.filter(F.col("id") % 2 == 0)).select("job_id", "current_status")


# --- scans ---


@query("events_of_type", "SELECT * FROM event_log WHERE event_type IN ('task.failed', 'task.blocked')")
def _(t: Tables) -> DataFrame:
    return events_for(t.event_log, event_types=["task.failed", "task.blocked"])


@query("visible_runs", "SELECT count(*) AS visible_rows, (SELECT count(*) FROM tasks) AS all_rows FROM tasks WHERE deleted_at IS NULL")
def _(t: Tables) -> DataFrame:
    shown = visible(t.tasks).agg(F.count(F.lit(1)).alias("visible_rows"))
    every = t.tasks.agg(F.count(F.lit(1)).alias("all_rows"))
    return side_by_side(shown, every)


DELIVERY_OK = "regexp_full_match(coalesce(job_id, ''), '[A-Za-z0-9._:-]{1,64}')"


@query(
    "delivery_accepted",
    f"""SELECT id, job_id, CASE WHEN regexp_full_match(correlation_id, '[A-Za-z0-9._:-]{{1,64}}') THEN correlation_id END AS correlation_id,
 CASE WHEN regexp_full_match(trace_id, '[A-Za-z0-9._:-]{{1,64}}') THEN trace_id END AS trace_id,
 TRY_CAST(replace(replace(created_at, 'T', ' '), 'Z', '') AS TIMESTAMP) AS created_at,
 CASE WHEN regexp_full_match(schema_version, '[0-9A-Za-z.]{{1,8}}') THEN schema_version END AS schema_version
FROM delivery_rows WHERE {DELIVERY_OK}""",
)
def _(t: Tables) -> DataFrame:
    return parse_delivery(t.delivery_rows)[0]


@query("delivery_rejected", f"SELECT id, job_id, 'delivery.malformed' AS event_type FROM delivery_rows WHERE NOT {DELIVERY_OK}")
def _(t: Tables) -> DataFrame:
    return parse_delivery(t.delivery_rows)[1]


# --- filters ---

RUN_OUT = ("job_id", "execution_chain_id", "status", "retry_index", "created_at")


@query(
    "runs_by_columns",
    "SELECT job_id, execution_chain_id, status, retry_index, created_at FROM tasks WHERE status = 'Failed' AND queue = 'q2'"
    " AND scan_status = 'DETECTED' AND created_at >= TIMESTAMP '1994-01-01' AND created_at <= TIMESTAMP '1998-06-30'",
)
def _(t: Tables) -> DataFrame:
    found = filters.filter_runs(
        t.tasks, created_from="1994-01-01", created_to="1998-06-30", execution_state="Failed", queue="q2", pii_scan_status="DETECTED"
    )
    return found.select(*RUN_OUT)


@query(
    "runs_filtered",
    """SELECT job_id, execution_chain_id, status, retry_index, created_at FROM tasks AS t
WHERE job_id IN (SELECT job_id FROM attempts WHERE failure_category = 'TIMEOUT')
 AND job_id IN (SELECT job_id FROM attempts GROUP BY job_id HAVING count(*) = 4)
 AND job_id IN (SELECT job_id FROM attempts WHERE epoch_us(finished_at) - epoch_us(started_at) >= 600000000)
 AND job_id IN (SELECT job_id FROM attempts WHERE epoch_us(finished_at) - epoch_us(started_at) <= 1800000000)""",
)
def _(t: Tables) -> DataFrame:
    found = filters.runs_related_to(t, t.tasks, failure_category="TIMEOUT", attempt_count=4, duration_from=600, duration_to=1800)
    return found.select(*RUN_OUT)


@query(
    "runs_with_findings",
    """SELECT job_id, execution_chain_id, status, retry_index, created_at FROM tasks AS t
WHERE job_id IN (SELECT job_id FROM findings WHERE type = 'SSN') AND job_id IN (SELECT job_id FROM fold WHERE started_at >= TIMESTAMP '2024-01-05')
 AND job_id IN (SELECT subject_id FROM annotations WHERE subject_type IN ('RUN', 'TASK') AND type = 'RUN_STUCK')""",
    STORED,
)
def _(t: Tables) -> DataFrame:
    found = filters.runs_related_to(
        with_projections(t), t.tasks, pii_type="SSN", started_from="2024-01-05", monitoring_annotation="RUN_STUCK"
    )
    return found.select(*RUN_OUT)


@query(
    "runs_with_alerts",
    """SELECT job_id, execution_chain_id, status, retry_index, created_at FROM tasks AS t
WHERE job_id IN (SELECT subject_id FROM alerts WHERE subject_type = 'RUN' AND alert_type = 'RUN_FAILED')
 AND job_id IN (SELECT subject_id FROM alerts WHERE subject_type = 'RUN' AND severity = 'INFO') AND job_id IN (SELECT job_id FROM attempts WHERE worker_id LIKE 'w%')""",
)
def _(t: Tables) -> DataFrame:
    return filters.runs_related_to(t, t.tasks, alert_type="RUN_FAILED", alert_severity="INFO").join(
        t.attempts.select("job_id"), "job_id", "left_semi"
    ).select(*RUN_OUT)


@query("runs_of_worker", "SELECT job_id, execution_chain_id, status, retry_index, created_at FROM tasks WHERE job_id IN (SELECT job_id FROM attempts WHERE worker_id = 'w7')")
def _(t: Tables) -> DataFrame:
    return filters.runs_related_to(t, t.tasks, worker_id="w7").select(*RUN_OUT)


@query("due_tasks", "SELECT job_id, run_at FROM tasks WHERE run_at <= TIMESTAMP '1998-01-01' AND status = 'Pending'")
def _(t: Tables) -> DataFrame:
    return filters.due_tasks(t.tasks, "1998-01-01 00:00:00").select("job_id", "run_at")


@query(
    "stranded_tasks",
    "SELECT job_id, updated_at FROM tasks WHERE status = 'Queued' AND published_at IS NULL AND updated_at < $NOW - INTERVAL '30' SECOND",
)
def _(t: Tables) -> DataFrame:
    return filters.stranded_tasks(t.tasks, NOW).select("job_id", "updated_at")


@query("work_in_flight", "SELECT count(*) > 0 AS busy FROM tasks WHERE status IN ('Queued', 'Running') OR (status = 'Pending' AND run_at <= $NOW)")
def _(t: Tables) -> DataFrame:
    return filters.work_in_flight(t.tasks, NOW)


# --- hydration ---

HYDRATED_SQL = """
SELECT t.id, t.job_id, t.execution_chain_id, t.status, t.retry_index, t.created_at, p.current_status, p.queued_at, p.started_at, p.completed_at, p.last_event_at,
 coalesce(p.was_reclaimed, false) AS was_reclaimed, coalesce(a.n, 0) AS attempt_count, a.worker_id AS latest_worker,
 (epoch_us(a.finished_at) - epoch_us(a.started_at)) / 1000000.0::DOUBLE AS attempt_duration_s,
 (epoch_us(p.completed_at) - epoch_us(p.started_at)) / 1000000.0::DOUBLE AS run_duration_s,
 coalesce(f.n, 0) AS chain_finding_count, coalesce(al.n, 0) AS active_alert_count, coalesce(m.n, 0) AS annotation_count,
 s.enabled AS schedule_enabled, s.next_run_at AS schedule_next_run_at,
 CASE t.status WHEN 'Pending' THEN 'SCHEDULED' WHEN 'Queued' THEN 'QUEUED' WHEN 'Running' THEN 'RUNNING' WHEN 'Completed' THEN 'SUCCEEDED'
  ELSE CASE WHEN t.retry_index >= 3 THEN 'DEAD' WHEN upper(trim(a.failure_category)) = 'TIMEOUT' THEN 'TIMED_OUT' ELSE 'FAILED' END END AS state,
 coalesce(p.current_status <> t.status AND p.current_status <> '', false) AS status_disagrees, strlen(t.payload) AS payload_size_bytes
FROM tasks AS t LEFT JOIN fold AS p ON p.job_id = t.job_id
LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM attempts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt_number DESC, attempt_id DESC) = 1) AS a
 ON a.job_id = t.job_id
LEFT JOIN (SELECT x.execution_chain_id, count(*) AS n FROM findings AS y JOIN tasks AS x ON x.job_id = y.job_id GROUP BY 1) AS f ON f.execution_chain_id = t.execution_chain_id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM alerts WHERE subject_type = 'RUN' AND status = 'OPEN' GROUP BY 1) AS al ON al.subject_id = t.job_id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM annotations WHERE subject_type IN ('RUN', 'TASK') GROUP BY 1) AS m ON m.subject_id = t.job_id
LEFT JOIN schedule_definitions AS s ON s.schedule_id = t.schedule_id"""


@query("runs_hydrated", HYDRATED_SQL, STORED)
def _(t: Tables) -> DataFrame:
    return runs.hydrate_runs(with_projections(t), t.tasks)


@query("runs_page_hydrated", HYDRATED_SQL + " ORDER BY t.created_at DESC, t.id DESC LIMIT 200", STORED)
def _(t: Tables) -> DataFrame:
    """The newest page only: children are cut to the page before they are aggregated."""
    page = paging.keyset_page(t.tasks, "created_at", "id", 200)
    return runs.hydrate_runs(with_projections(t), page, page=True)


@query("run_detail", HYDRATED_SQL + " WHERE t.job_id = 'j1209'", STORED)
def _(t: Tables) -> DataFrame:
    return runs.run_detail(with_projections(t), "j1209")


ITEM_DETAIL = {
    "attempts": ("attempt_id", ("attempt_number", "worker_id", "status", "failure_category")),
    "findings": ("finding_id", ("found_in", "type", "detector_id", "source", "index", "policy_action")),
    "open_alerts": ("alert_id", ("alert_type", "severity", "summary")),
    "annotations": ("annotation_id", ("type", "evidence")),
}


def items_sql(page: str) -> str:
    """Items of the runs of a page, as rows in the order of their lists."""
    return f"""
SELECT * FROM (WITH p AS ({page}), i AS (
 SELECT job_id, 'attempts' AS list, attempt_number AS rank, attempt_id AS item_id, concat_ws('|', attempt_number, worker_id, status, failure_category) AS detail FROM attempts
 UNION ALL SELECT c.job_id, 'findings', f.id, CAST(f.id AS VARCHAR), concat_ws('|', f.job_id, f.type, f.detector_id, f.source, f.index, f.policy_action)
 FROM p AS c JOIN tasks AS m ON m.execution_chain_id = c.execution_chain_id JOIN findings AS f ON f.job_id = m.job_id
 UNION ALL SELECT subject_id, 'open_alerts', epoch_us(opened_at), alert_id, concat_ws('|', alert_type, severity, summary) FROM alerts WHERE subject_type = 'RUN' AND status = 'OPEN'
 UNION ALL SELECT subject_id, 'annotations', epoch_us(derived_at), annotation_id, concat_ws('|', type, evidence) FROM annotations WHERE subject_type IN ('RUN', 'TASK'))
SELECT job_id, list, row_number() OVER (PARTITION BY job_id, list ORDER BY rank, item_id) - 1 AS position, item_id, detail FROM i
WHERE job_id IN (SELECT job_id FROM p)) AS q"""


def items_as_rows(items: DataFrame, part_items: int) -> DataFrame:
    lists = [
        runs.item_rows(items, name, part_items).select(
            "job_id", F.lit(name).alias("list"), "position", F.col(ident).cast("string").alias("item_id"), F.concat_ws("|", *detail).alias("detail")
        )
        for name, (ident, detail) in ITEM_DETAIL.items()
    ]
    return functools.reduce(DataFrame.unionByName, lists)


@query("run_items", items_sql("SELECT * FROM tasks ORDER BY created_at DESC, id DESC LIMIT 200"))
def _(t: Tables) -> DataFrame:
    """The nested lists of the newest page, in rows of three items at most, opened again."""
    page = paging.keyset_page(t.tasks, "created_at", "id", 200)
    return items_as_rows(runs.run_items(with_projections(t), page, 3), 3)


@query("run_detail_items", items_sql("SELECT * FROM tasks WHERE job_id = 'j1209'"))
def _(t: Tables) -> DataFrame:
    return items_as_rows(runs.run_detail_items(with_projections(t), "j1209"), runs.PART_ITEMS)


@query(
    "chain_findings",
    """SELECT m.execution_chain_id, f.job_id, f.id AS finding_id, f.type, f.detector_id, f.confidence, f.source, f.index, f.policy_action
FROM findings AS f JOIN tasks AS m ON m.job_id = f.job_id""",
)
def _(t: Tables) -> DataFrame:
    return runs.chain_findings(t)


@query(
    "page_attempts",
    """SELECT a.attempt_id, a.job_id, a.attempt_number, a.status FROM attempts AS a
WHERE job_id IN (SELECT job_id FROM (SELECT * FROM tasks WHERE status = 'Failed' ORDER BY created_at DESC, id DESC LIMIT 200) AS p)""",
)
def _(t: Tables) -> DataFrame:
    page = paging.keyset_page(filters.filter_runs(t.tasks, execution_state="Failed"), "created_at", "id", 200)
    return runs.page_attempts(t, page).select("attempt_id", "job_id", "attempt_number", "status")


@query(
    "new_idempotent_runs",
    """SELECT job_id, idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, id) AS rn FROM tasks) AS x
WHERE coalesce(idempotency_key, '') = '' OR (rn = 1 AND idempotency_key NOT IN (SELECT idempotency_key FROM tasks WHERE status = 'Completed' AND coalesce(idempotency_key, '') <> ''))""",
)
def _(t: Tables) -> DataFrame:
    """Runs that may be created when the completed ones are already stored."""
    stored = t.tasks.filter(F.col("status") == "Completed")
    return runs.new_idempotent(t.tasks, stored).select("job_id", "idempotency_key")


@query(
    "status_ranks",
    "SELECT status, CASE status WHEN 'Pending' THEN 10 WHEN 'Queued' THEN 20 WHEN 'Running' THEN 30 ELSE 40 END AS rank, status IN ('Completed', 'Failed', 'Blocked') AS terminal, count(*) AS n FROM tasks GROUP BY status",
)
def _(t: Tables) -> DataFrame:
    counts = t.tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("status", status_rank(F.col("status")).alias("rank"), is_terminal(F.col("status")).alias("terminal"), "n")


@query(
    "page_findings",
    """SELECT p.job_id, p.execution_chain_id, f.job_id AS found_in, f.id AS finding_id, f.type, f.policy_action
FROM (SELECT * FROM tasks WHERE status = 'Failed' ORDER BY created_at DESC, id DESC LIMIT 200) AS p JOIN tasks AS m ON m.execution_chain_id = p.execution_chain_id
JOIN findings AS f ON f.job_id = m.job_id""",
)
def _(t: Tables) -> DataFrame:
    page = paging.keyset_page(filters.filter_runs(t.tasks, execution_state="Failed"), "created_at", "id", 200)
    return runs.page_findings(t, page).select("job_id", "execution_chain_id", "found_in", "finding_id", "type", "policy_action")


@query("asserted_statuses", "SELECT event_type, max(s) AS status, count(*) AS n FROM (SELECT *, CASE event_type WHEN 'task.created' THEN 'Pending' WHEN 'task.queued' THEN 'Queued' WHEN 'task.started' THEN 'Running' WHEN 'task.completed' THEN 'Completed' WHEN 'task.failed' THEN 'Failed' WHEN 'task.blocked' THEN 'Blocked' END AS s FROM event_log) AS x GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return t.event_log.groupBy("event_type").agg(F.max(asserted_status(F.col("event_type"))).alias("status"), F.count(F.lit(1)).alias("n"))


@query(
    "run_metrics",
    f"""
SELECT t.job_id, t.execution_chain_id, t.retry_index, {secs('p.queued_at', 't.created_at')} AS queue_latency_s, {secs('t.finished_at', 'a.started_at')} AS execution_duration_s,
 {secs('t.finished_at', 't.created_at')} AS run_duration_s, c.n - 1 AS retry_count, {secs('c.last_finished', 'c.first_created')} AS chain_total_duration_s,
 coalesce({secs('t.created_at', 't.expected_at')}, 0) AS creation_drift_s
FROM tasks AS t JOIN fold AS p ON p.job_id = t.job_id
JOIN (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt_number DESC, attempt_id DESC) = 1) AS a ON a.job_id = t.job_id
JOIN (SELECT execution_chain_id, max(n) AS n, max(CASE WHEN up = 1 THEN created_at END) AS first_created, max(CASE WHEN down = 1 THEN finished_at END) AS last_finished
 FROM (SELECT *, count(*) OVER (PARTITION BY execution_chain_id) AS n, row_number() OVER (PARTITION BY execution_chain_id ORDER BY retry_index, id) AS up,
  row_number() OVER (PARTITION BY execution_chain_id ORDER BY retry_index DESC, id DESC) AS down FROM tasks) AS x GROUP BY 1) AS c ON c.execution_chain_id = t.execution_chain_id
WHERE t.finished_at IS NOT NULL""",
    STORED,
)
def _(t: Tables) -> DataFrame:
    return runs.run_metrics(with_projections(t))


@query(
    "chain_events",
    """SELECT t.execution_chain_id, t.retry_index, t.job_id, t.status, e.event_type, e.occurred_at, e.producer_id, e.producer_sequence, e.id AS event_row
FROM tasks AS t LEFT JOIN event_log AS e ON e.job_id = t.job_id""",
)
def _(t: Tables) -> DataFrame:
    return runs.chain_events(t)


CORRELATION_SQL = """
SELECT e.id, e.event_id, e.job_id, e.event_type, e.occurred_at, e.scoped AS run_scoped, coalesce(nullif(e.execution_chain_id, ''), t.execution_chain_id, '') AS execution_chain_id,
 coalesce(t.execution_chain_id, '') AS correlation_id, coalesce(t.parent_run_id, '') AS parent_run_id, coalesce(t.retry_index, 0) AS retry_index, coalesce(t.trace_id, '') AS trace_id,
 CASE WHEN NOT e.scoped AND e.event_type LIKE 'schedule.%' THEN e.job_id ELSE coalesce(t.schedule_id, '') END AS schedule_id, coalesce(t.schedule_occurrence_id, '') AS schedule_occurrence_id,
 CASE WHEN NOT e.scoped AND e.event_type LIKE 'queue.%' THEN e.job_id ELSE coalesce(t.queue, '') END AS queue_name,
 CASE WHEN NOT e.scoped AND e.event_type LIKE 'worker.%' AND e.worker_id = '' THEN e.job_id ELSE e.worker_id END AS worker_id
FROM (SELECT *, job_id <> 'system' AND (event_type = 'schedule.occurrence_run_created' OR NOT regexp_matches(event_type, '^(queue|worker|component|monitoring|redis|alert|retention|schedule)[.]')) AS scoped
 FROM activity_log) AS e LEFT JOIN tasks AS t ON e.scoped AND t.job_id = e.job_id"""


@query("event_correlation", CORRELATION_SQL)
def _(t: Tables) -> DataFrame:
    return runs.fill_correlation(t.activity_log, t.tasks).select(*CORRELATED)


CORRELATED = (
    "id", "event_id", "job_id", "event_type", "occurred_at", "run_scoped", "execution_chain_id", "correlation_id", "parent_run_id",
    "retry_index", "trace_id", "schedule_id", "schedule_occurrence_id", "queue_name", "worker_id",
)


@query("events_appended", CORRELATION_SQL)
def _(t: Tables) -> DataFrame:
    """Events appended in two batches, the first of them twice, and read back."""
    spark = t.tasks.sparkSession
    folder = fresh_folder(spark, "event-log")
    for batch in (0, 1, 0):
        runs.append_events(t.activity_log.filter(F.col("id") % 2 == batch), t.tasks, folder, "importer", batch)
    return spark.read.parquet(folder).select(*CORRELATED)


@query(
    "annotations_appended",
    """SELECT subject_id, type, derived_at FROM annotations WHERE resolved_at IS NULL UNION ALL SELECT schedule_id, 'SCHEDULE_MISSED', $NOW FROM schedule_definitions WHERE enabled
 AND schedule_id NOT IN (SELECT subject_id FROM annotations WHERE resolved_at IS NULL AND type = 'SCHEDULE_MISSED')""",
)
def _(t: Tables) -> DataFrame:
    """Open annotations, and new ones appended twice but only where none of their subject and type is open."""
    spark = t.tasks.sparkSession
    folder, key = fresh_folder(spark, "annotations"), ["subject_id", "type"]
    columns = ("subject_id", "type", "derived_at")
    append(t.annotations.filter("resolved_at IS NULL").select(*columns), folder)
    fresh = t.schedule_definitions.filter("enabled").select(F.col("schedule_id").alias("subject_id"), F.lit("SCHEDULE_MISSED").alias("type"), F.lit(NOW).cast("timestamp").alias("derived_at"))
    for _ in range(2):
        append_new(fresh, spark.read.parquet(folder), key, folder)
    return spark.read.parquet(folder).select(*columns)


def damaged(rows: DataFrame) -> DataFrame:
    """A stored projection that lost some rows, has others wrong and holds some of no run."""
    number = F.xxhash64("job_id")
    kept = rows.filter(F.pmod(number, F.lit(7)) != 0)
    wrong = kept.withColumn("current_status", F.when(F.pmod(number, F.lit(5)) == 0, F.lit("Broken")).otherwise(F.col("current_status")))
    junk = rows.filter(F.pmod(number, F.lit(11)) == 0).withColumn("job_id", F.concat(F.lit("ghost-"), "job_id"))
    return wrong.unionByName(junk)


def rebuilt(t: Tables) -> tuple[str, DataFrame]:
    spark = t.tasks.sparkSession
    folder, wanted = fresh_folder(spark, "rebuilt"), folds.run_projections(t.event_log, t.tasks)
    upsert(damaged(wanted), folder, 0, ["job_id"])
    for version in (1, 1, 2):
        rebuild(wanted, folder, ["job_id"], version, ["job_id"])
    return folder, wanted


@query("projections_rebuilt", FOLD_SQL)
def _(t: Tables) -> DataFrame:
    """Damaged projections after a rebuild, its repetition and a further one."""
    folder, wanted = rebuilt(t)
    return read_keyed(t.tasks.sparkSession, folder, ["job_id"]).select(*wanted.columns)


@query("rebuild_changes")
def _(t: Tables) -> DataFrame:
    """How many rows each version of the rebuilt table wrote and marked as gone; the last one changes nothing."""
    folder, _ = rebuilt(t)
    log = version_log(t.tasks.sparkSession, folder)
    return log.groupBy("version").agg(F.count_if(~F.col("_gone")).alias("written"), F.count_if("_gone").alias("gone"))


@query(
    "idempotent_runs",
    """SELECT job_id, idempotency_key FROM tasks WHERE coalesce(idempotency_key, '') = '' UNION ALL
SELECT job_id, idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, id) AS rn FROM tasks WHERE coalesce(idempotency_key, '') <> '') AS x WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    return runs.first_per_idempotency_key(t.tasks).select("job_id", "idempotency_key")


# --- timeline ---

TIMELINE_SQL = """
SELECT x.occurred_at, x.event_type, x.run_id, x.source, x.attempt_id, x.worker_id, x.attempt_number, x.status, x.policy_action, x.severity, x.annotation_type, t.execution_chain_id
FROM (
 SELECT occurred_at, event_type, e.job_id AS run_id, 'EVENT' AS source, nullif(e.attempt_id, '') AS attempt_id, CASE WHEN e.attempt_id <> '' THEN e.worker_id END AS worker_id, a.attempt_number,
  NULL AS status, NULL AS policy_action, NULL AS severity, NULL AS annotation_type FROM run_event_details AS e LEFT JOIN attempts AS a ON a.attempt_id = e.attempt_id
 UNION ALL SELECT moment, concat('attempt.', kind), job_id, 'ATTEMPT', attempt_id, worker_id, attempt_number, CASE WHEN kind = 'finished' THEN status END, NULL, NULL, NULL
 FROM (SELECT *, claimed_at AS moment, 'claimed' AS kind FROM attempts UNION ALL SELECT *, started_at, 'started' FROM attempts UNION ALL SELECT *, finished_at, 'finished' FROM attempts) AS s
 WHERE moment IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run_event_details AS e WHERE e.attempt_id = s.attempt_id AND ((e.event_type = 'attempt.started' AND s.kind = 'started') OR (e.event_type = 'attempt.failed' AND s.kind = 'finished')))
 UNION ALL SELECT created_at, 'pii.detected', job_id, 'PII', NULL, NULL, NULL, NULL, policy_action, NULL, NULL FROM findings
 UNION ALL SELECT moment, kind, subject_id, 'ALERT', NULL, NULL, NULL, NULL, NULL, severity, NULL FROM (
  SELECT *, opened_at AS moment, 'alert.opened' AS kind FROM alerts UNION ALL SELECT *, acknowledged_at, 'alert.acknowledged' FROM alerts UNION ALL SELECT *, resolved_at, 'alert.resolved' FROM alerts) AS s
  WHERE subject_type = 'RUN' AND moment IS NOT NULL
 UNION ALL SELECT moment, kind, subject_id, 'ANNOTATION', NULL, NULL, NULL, NULL, NULL, NULL, type FROM (
  SELECT *, derived_at AS moment, concat('annotation.', type) AS kind FROM annotations UNION ALL SELECT *, resolved_at, 'annotation.resolved' FROM annotations) AS s
  WHERE subject_type IN ('RUN', 'TASK') AND moment IS NOT NULL) AS x JOIN tasks AS t ON t.job_id = x.run_id"""
TIMELINE_OUT = (
    "occurred_at", "event_type", "run_id", "source", "attempt_id", "worker_id", "attempt_number", "status", "policy_action", "severity",
    "annotation_type", "execution_chain_id",
)


@query("timeline", TIMELINE_SQL)
def _(t: Tables) -> DataFrame:
    """Every chain's timeline."""
    return timeline.timeline_entries(t).select(*TIMELINE_OUT)


@query("chain_timeline", "SELECT *, false AS truncated FROM (" + TIMELINE_SQL + ") AS z WHERE execution_chain_id = 'c1200' AND source <> 'PII'")
def _(t: Tables) -> DataFrame:
    return timeline.chain_timeline(t, "c1200", can_read_pii=False).select(*TIMELINE_OUT, "truncated")


@query("run_timeline", "SELECT *, false AS truncated FROM (" + TIMELINE_SQL + ") AS z WHERE execution_chain_id = 'c1208'")
def _(t: Tables) -> DataFrame:
    return timeline.run_timeline(t, "j1209").select(*TIMELINE_OUT, "truncated")


# --- labels and states ---


@query(
    "attempt_failures",
    """SELECT CASE WHEN upper(trim(failure_category)) IN ('APPLICATION_ERROR','INVALID_INPUT','DEPENDENCY_ERROR','TIMEOUT','WORKER_FAILURE','INFRASTRUCTURE_ERROR','UNKNOWN')
 THEN upper(trim(failure_category)) ELSE 'UNKNOWN' END AS category, count(*) AS n FROM attempts GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return t.attempts.groupBy(failure_category(F.col("failure_category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_transitions",
    """SELECT job_id, CASE WHEN moment IS NULL THEN NULL WHEN completed_at = moment THEN 'Run completed' WHEN started_at = moment THEN 'Run started' ELSE 'Run queued' END AS label,
 moment AS changed_at FROM (SELECT *, greatest(completed_at, started_at, queued_at) AS moment FROM fold) AS x""",
    STORED,
)
def _(t: Tables) -> DataFrame:
    last = latest_transition(F.col("completed_at"), F.col("started_at"), F.col("queued_at"))
    projected = folds.run_projections(t.event_log, t.tasks).withColumn("last", last)
    return projected.select("job_id", F.col("last")["label"].alias("label"), F.col("last")["at"].alias("changed_at"))


@query(
    "run_status_labels",
    """SELECT t.job_id, t.status AS status, lower(t.status) AS status_class, t.status AS status_label FROM tasks AS t""",
)
def _(t: Tables) -> DataFrame:
    shown = status_of(F.col("status"), F.lit(""))
    return t.tasks.select("job_id", shown.alias("status"), status_class(shown).alias("status_class"), status_label(shown).alias("status_label"))


@query(
    "attempt_event_kinds",
    """SELECT CASE event_type WHEN 'attempt.started' THEN 'started' WHEN 'attempt.failed' THEN 'finished' END AS kind, count(*) AS n FROM run_event_details GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return t.run_event_details.groupBy(attempt_kind(F.col("event_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- retention ---


@query(
    "retention_report",
    """SELECT 'queue_samples' AS table_name, count(*) FILTER (WHERE NOT sampled_at < $NOW - INTERVAL '24' HOUR) AS kept, count(*) FILTER (WHERE sampled_at < $NOW - INTERVAL '24' HOUR) AS removed FROM queue_samples
UNION ALL SELECT 'heartbeats', count(*) FILTER (WHERE NOT occurred_at < $NOW - INTERVAL '24' HOUR), count(*) FILTER (WHERE occurred_at < $NOW - INTERVAL '24' HOUR) FROM heartbeats
UNION ALL SELECT 'annotations', count(*) FILTER (WHERE resolved_at IS NULL OR NOT resolved_at < $NOW - INTERVAL '24' HOUR), count(*) FILTER (WHERE resolved_at < $NOW - INTERVAL '24' HOUR) FROM annotations
UNION ALL SELECT 'findings', count(*), 0 FROM findings""",
)
def _(t: Tables) -> DataFrame:
    return maintenance.retention_report(
        {
            "queue_samples": (t.queue_samples, "sampled_at", 24),
            "heartbeats": (t.heartbeats, "occurred_at", 24),
            "annotations": (t.annotations, "resolved_at", 24),
            "findings": (t.findings, "created_at", 0),
        },
        NOW,
    )


@query(
    "expired_bodies",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS sanitized_body, doc_id % 3 = 0 OR doc_id % 5 = 0 AS body_expired FROM (
 SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM documents) AS x""",
)
def _(t: Tables) -> DataFrame:
    """Bodies of artifacts past their retention are blanked; the rows stay."""
    gone = F.col("doc_id") % 5 == 0
    age = F.when(F.col("doc_id") % 3 == 0, F.lit(200)).otherwise(F.lit(2))
    artifacts = t.documents.select(
        "doc_id",
        F.when(gone, F.lit("")).otherwise(F.col("text")).alias("sanitized_body"),
        gone.alias("body_expired"),
        shift(NOW, -age * 3600).alias("produced_at"),
    )
    return maintenance.expire_bodies(artifacts, NOW, 100).drop("produced_at")


@query("retention", "SELECT * FROM annotations WHERE resolved_at IS NULL OR resolved_at >= $NOW - INTERVAL '72' HOUR")
def _(t: Tables) -> DataFrame:
    return maintenance.retention(t.annotations, "resolved_at", NOW, 72)


@query(
    "latest_attempt",
    "SELECT job_id, attempt_id, attempt_number, status FROM attempts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt_number DESC, attempt_id DESC) = 1",
)
def _(t: Tables) -> DataFrame:
    return latest.newest_attempts(t.attempts).select("job_id", "attempt_id", "attempt_number", "status")
