"""Monitoring checks, component health, freshness, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.catalog.registry import query
from opswatch.catalog.shared import STORED, with_projections
from opswatch.functions import verdicts as v
from opswatch.functions.timing import age_seconds
from opswatch.operators import latest
from opswatch.plans import monitoring, reports
from opswatch.sources.tables import Tables
from opswatch.sources.views import NOW

DAY = 86400
SWEEP_END = "2024-01-30 23:00:00"

SILENT_SQL = """
SELECT t.job_id, a.worker_id, e.last_event_at, h.last_heartbeat_at FROM tasks AS t
JOIN (SELECT job_id, max(occurred_at) AS last_event_at FROM event_log WHERE event_type <> 'attempt.heartbeat' GROUP BY job_id) AS e ON e.job_id = t.job_id
JOIN (SELECT job_id, worker_id FROM attempts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, attempt_id DESC) = 1) AS a ON a.job_id = t.job_id
LEFT JOIN (SELECT worker_id, max(occurred_at) AS last_heartbeat_at FROM heartbeats GROUP BY worker_id) AS h ON h.worker_id = a.worker_id
WHERE t.status = 'Running' AND epoch_us($NOW) - epoch_us(e.last_event_at) > 60000000"""
STUCK_SQL = SILENT_SQL + " AND epoch_us($NOW) - epoch_us(h.last_heartbeat_at) < 86400000000"
LOST_SQL = SILENT_SQL + " AND (h.last_heartbeat_at IS NULL OR epoch_us($NOW) - epoch_us(h.last_heartbeat_at) > 14400000000)"


@query("stuck_runs", STUCK_SQL)
def _(t: Tables) -> DataFrame:
    return monitoring.stuck_runs(t, NOW, heartbeat_window=DAY)


@query("lost_runs", LOST_SQL)
def _(t: Tables) -> DataFrame:
    return monitoring.lost_runs(t, NOW, heartbeat_window=4 * 3600)


@query("duplicate_execution", "SELECT job_id, count(*) AS active_attempt_count FROM attempts WHERE status IN ('Claimed', 'Started') GROUP BY job_id HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return monitoring.duplicate_executions(t.attempts)


@query(
    "duplicates_cleared",
    """SELECT annotation_id, subject_id FROM annotations AS n WHERE resolved_at IS NULL AND type = 'RUN_DUPLICATE_SUSPECTED'
 AND (SELECT count(*) FROM attempts AS a WHERE a.job_id = n.subject_id AND a.status IN ('Claimed', 'Started')) <= 1""",
)
def _(t: Tables) -> DataFrame:
    return monitoring.cleared_duplicates(t).select("annotation_id", "subject_id")


@query(
    "silence_cleared",
    """SELECT n.annotation_id, n.subject_id FROM annotations AS n JOIN tasks AS t ON t.job_id = n.subject_id
JOIN (SELECT job_id, max(occurred_at) AS last_event_at FROM event_log WHERE event_type <> 'attempt.heartbeat' GROUP BY job_id) AS e ON e.job_id = n.subject_id
WHERE n.resolved_at IS NULL AND n.type = 'RUN_STUCK' AND (t.status IN ('Completed', 'Failed') OR epoch_us($NOW) - epoch_us(e.last_event_at) < 86400000000)""",
)
def _(t: Tables) -> DataFrame:
    return monitoring.cleared_silence(t, NOW, "RUN_STUCK", DAY).select("annotation_id", "subject_id")


@query("missed_schedules", "SELECT schedule_id, next_run_at, (epoch_us($NOW) - epoch_us(next_run_at)) / 1000000.0::DOUBLE AS overdue_seconds FROM schedule_definitions WHERE enabled AND next_run_at < $NOW - INTERVAL '5' MINUTE")
def _(t: Tables) -> DataFrame:
    return monitoring.missed_schedules(t.schedule_definitions, NOW)


@query(
    "schedules_recovered",
    """SELECT n.annotation_id, n.subject_id, s.next_run_at FROM annotations AS n JOIN schedule_definitions AS s ON s.schedule_id = n.subject_id
WHERE n.resolved_at IS NULL AND n.type = 'SCHEDULE_MISSED' AND epoch_us($NOW) - epoch_us(s.next_run_at) < 300000000""",
)
def _(t: Tables) -> DataFrame:
    return monitoring.recovered_schedules(t, NOW).select("annotation_id", "subject_id", "next_run_at")


OPEN_SQL = "SELECT DISTINCT subject_id, type FROM annotations WHERE resolved_at IS NULL"


NEW_SQL = f"""SELECT type, subject_type, subject_id FROM (
 SELECT 'RUN_STUCK' AS type, 'TASK' AS subject_type, job_id AS subject_id FROM stuck UNION ALL SELECT 'RUN_LOST', 'TASK', job_id FROM lost
 UNION ALL SELECT 'RUN_DUPLICATE_SUSPECTED', 'TASK', job_id FROM attempts WHERE status IN ('Claimed', 'Started') GROUP BY job_id HAVING count(*) > 1
 UNION ALL SELECT 'SCHEDULE_MISSED', 'SCHEDULE', schedule_id FROM schedule_definitions WHERE enabled AND next_run_at < $NOW - INTERVAL '5' MINUTE) AS x
WHERE (subject_id, type) NOT IN ({OPEN_SQL})"""


@query(
    "new_annotations",
    NEW_SQL,
    {"stuck": STUCK_SQL.replace("$NOW", f"TIMESTAMP '{NOW}'"), "lost": LOST_SQL.replace("$NOW", f"TIMESTAMP '{NOW}'")},
)
def _(t: Tables) -> DataFrame:
    found = monitoring.new_annotations(t, NOW, stuck_window=DAY, lost_window=4 * 3600)
    return found.select("type", "subject_type", "subject_id")


# --- owners and recovery ---

OWNERS_SQL = """
SELECT a.attempt_id, a.job_id, a.worker_id, coalesce(w.started > a.claimed_at, false) OR h.last IS NULL OR epoch_us($NOW) - epoch_us(h.last) > 21600000000 AS owner_gone
FROM attempts AS a LEFT JOIN (SELECT worker_id, max(occurred_at) AS last FROM heartbeats GROUP BY worker_id) AS h ON h.worker_id = a.worker_id
LEFT JOIN (SELECT worker_id, max(started_at) AS started FROM workers GROUP BY worker_id) AS w ON w.worker_id = a.worker_id
WHERE a.status IN ('Claimed', 'Started')"""


def late_claims(t: Tables) -> Tables:
    """Attempts claimed by half of the workers after their registration, so that live owners exist."""
    recent = F.when(
        F.regexp_extract("worker_id", "[0-9]+", 0).cast("int") % 2 == 0, F.expr("TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR")
    ).otherwise(F.col("claimed_at"))
    return t.with_tables(attempts=t.attempts.withColumn("claimed_at", recent))


LATE_SQL = OWNERS_SQL.replace(
    "FROM attempts AS a",
    "FROM (SELECT * REPLACE (CASE WHEN CAST(substr(worker_id, 2) AS INT) % 2 = 0 THEN $NOW - INTERVAL '1' HOUR ELSE claimed_at END AS claimed_at) FROM attempts) AS a",
)


@query("attempt_owners", LATE_SQL)
def _(t: Tables) -> DataFrame:
    return monitoring.attempt_owners(late_claims(t), NOW, 6 * 3600).select("attempt_id", "job_id", "worker_id", "owner_gone")


@query(
    "recovery_plan",
    """SELECT t.job_id, coalesce(o.n, 0) AS unfinished_attempts,
 CASE WHEN t.status IN ('Completed', 'Failed') OR o.n IS NULL THEN 'PROCEED' WHEN o.all_gone THEN 'ABANDON' ELSE 'WAIT' END AS plan
FROM tasks AS t LEFT JOIN (SELECT job_id, count(*) AS n, bool_and(owner_gone) AS all_gone FROM owners GROUP BY job_id) AS o ON o.job_id = t.job_id""",
    {"owners": LATE_SQL.replace("$NOW", f"TIMESTAMP '{NOW}'")},
)
def _(t: Tables) -> DataFrame:
    return monitoring.recovery_plan(late_claims(t), NOW, 6 * 3600)


@query(
    "retry_candidates",
    """SELECT job_id AS parent_run_id, execution_chain_id, trace_id, task_name, 'Default' AS task_type, payload, CASE WHEN retry_index >= 3 THEN 'EXHAUSTED' ELSE 'RETRY' END AS decision,
 CASE WHEN retry_index < 3 THEN retry_index + 1 END AS retry_index, CASE WHEN retry_index < 3 THEN $NOW + INTERVAL '10' SECOND END AS run_at
FROM tasks AS t WHERE status = 'Failed' AND job_id IN (SELECT job_id FROM event_log WHERE event_type = 'task.retry_scheduled')
 AND NOT EXISTS (SELECT 1 FROM tasks AS c WHERE c.parent_run_id = t.job_id)""",
)
def _(t: Tables) -> DataFrame:
    return monitoring.retry_candidates(t, NOW)


# --- components ---

INSTANCE_SQL = """
SELECT CASE WHEN component_type = '' THEN 'Worker' ELSE component_type END AS component_type, w.instance_id, w.worker_id AS display_name, w.started_at, h.seen AS last_seen_at,
 w.stopped_at, w.draining_at, w.build_revision
FROM (SELECT * FROM workers QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY started_at DESC, id DESC) = 1) AS w
LEFT JOIN (SELECT instance_id, max(occurred_at) AS seen FROM heartbeats GROUP BY instance_id) AS h ON h.instance_id = w.instance_id"""
VERDICT_SQL = """
SELECT *, stopped_at IS NOT NULL AND NOT coalesce(stopped_at < last_seen_at - INTERVAL '2' SECOND, false) AS stopped,
 draining_at IS NOT NULL AND NOT (stopped_at IS NOT NULL AND NOT coalesce(stopped_at < last_seen_at - INTERVAL '2' SECOND, false)) AND epoch_us($NOW) - epoch_us(draining_at) < 300000000 AS drains,
 (epoch_us($NOW) - epoch_us(last_seen_at)) / 1000000.0::DOUBLE AS age FROM instances""".replace("$NOW", f"TIMESTAMP '{NOW}'")
HEALTH_CASE = "CASE WHEN stopped THEN 'OFFLINE' WHEN drains THEN 'HEALTHY' WHEN last_seen_at IS NULL THEN 'UNKNOWN' WHEN age > 21600 THEN 'OFFLINE' WHEN age > 3600 THEN 'DEGRADED' ELSE 'HEALTHY' END"
AGO = (
    "CASE WHEN round(age) >= 3600 THEN concat(CAST(round(age) AS BIGINT) // 3600, 'h', CAST(round(age) AS BIGINT) % 3600 // 60, 'm', CAST(round(age) AS BIGINT) % 60, 's')"
    " WHEN round(age) >= 60 THEN concat(CAST(round(age) AS BIGINT) // 60, 'm', CAST(round(age) AS BIGINT) % 60, 's') ELSE concat(CAST(round(age) AS BIGINT), 's') END"
)


@query("component_instances", INSTANCE_SQL)
def _(t: Tables) -> DataFrame:
    return monitoring.component_instances(t)


@query(
    "component_report",
    f"""SELECT component_type, CASE component_type WHEN 'Alert Evaluator' THEN 'ALERT_EVALUATOR' ELSE upper(component_type) END AS component_kind, instance_id, display_name, build_revision,
 started_at, last_seen_at, {HEALTH_CASE} AS health,
 CASE WHEN stopped THEN concat('stopped gracefully at ', strftime(stopped_at, '%Y-%m-%dT%H:%M:%SZ'))
  WHEN drains THEN concat('draining since ', strftime(draining_at, '%Y-%m-%dT%H:%M:%SZ'), ': finishing the work it holds, not claiming new tasks')
  WHEN last_seen_at IS NULL THEN 'no heartbeat has ever been recorded' ELSE concat('last heartbeat ', {AGO}, ' ago (degraded after 1h0m0s, offline after 6h0m0s)') END AS reason,
 (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen_at)) // 1000 AS observed_lag_ms,
 CASE WHEN last_seen_at IS NULL THEN NULL WHEN {HEALTH_CASE} = 'OFFLINE' THEN 21600000 ELSE 3600000 END AS threshold_ms, stopped
FROM verdicts""",
    {"instances": INSTANCE_SQL, "verdicts": VERDICT_SQL},
)
def _(t: Tables) -> DataFrame:
    return monitoring.component_report(t, NOW, 3600, 21600).drop("evidence")


@query(
    "component_states",
    f"SELECT instance_id, CASE WHEN stopped THEN 'stopped' WHEN drains THEN 'draining' WHEN last_seen_at IS NULL THEN 'unknown' WHEN age > 300 THEN 'offline' WHEN age > 60 THEN 'degraded' ELSE 'healthy' END AS state FROM verdicts",
    {"instances": INSTANCE_SQL, "verdicts": VERDICT_SQL},
)
def _(t: Tables) -> DataFrame:
    return monitoring.component_instances(t).select("instance_id", monitoring.component_state(NOW).alias("state"))


@query("component_evidence")
def _(t: Tables) -> DataFrame:
    return monitoring.component_report(t, NOW).select("instance_id", "evidence")


WORKER_STATES_SQL = """SELECT h.worker_id, h.instance_id, h.occurred_at, CASE WHEN w.stopped THEN 'stopped' WHEN w.draining THEN 'draining'
  WHEN epoch_us($NOW) - epoch_us(h.occurred_at) > 300000000 THEN 'offline' WHEN epoch_us($NOW) - epoch_us(h.occurred_at) > 60000000 THEN 'degraded' ELSE 'online' END AS status
FROM (SELECT * FROM heartbeats QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY occurred_at DESC, id DESC) = 1) AS h
LEFT JOIN (SELECT instance_id, bool_or(stopped_at IS NOT NULL) AS stopped, bool_or(coalesce(draining_at > $NOW - INTERVAL '5' MINUTE, false) AND stopped_at IS NULL) AS draining FROM workers GROUP BY instance_id) AS w
 ON w.instance_id = h.instance_id"""


@query("worker_states", WORKER_STATES_SQL)
def _(t: Tables) -> DataFrame:
    return monitoring.worker_states(t, NOW)


LATEST_ROWS = "(SELECT * FROM component_rows QUALIFY row_number() OVER (PARTITION BY component_type, display_name ORDER BY started_at DESC, id DESC) = 1) AS x"
ROW_STATUS = "CASE WHEN health IN ('HEALTHY', 'DEGRADED', 'UNHEALTHY', 'OFFLINE') THEN lower(health) ELSE 'unknown' END"


@query(
    "health_summary",
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE NOT stopped AND {ROW_STATUS} = '{s}') AS {s}" for s in ("healthy", "degraded", "unhealthy", "offline", "unknown"))
    + f", count(*) FILTER (WHERE stopped) AS stopped FROM {LATEST_ROWS}",
)
def _(t: Tables) -> DataFrame:
    return reports.health_summary(t.component_rows)


@query(
    "needs_attention",
    f"""SELECT component_type, display_name, {ROW_STATUS} AS status, reason, CASE {ROW_STATUS} WHEN 'offline' THEN 4 WHEN 'unhealthy' THEN 3 WHEN 'degraded' THEN 2 ELSE 1 END AS urgency
FROM {LATEST_ROWS} WHERE NOT stopped AND {ROW_STATUS} <> 'healthy' ORDER BY urgency DESC, component_type, display_name LIMIT 3""",
)
def _(t: Tables) -> DataFrame:
    return reports.needs_attention(t.component_rows)


@query(
    "worst_verdicts",
    f"""SELECT component_type, {ROW_STATUS} AS status, reason FROM component_rows
QUALIFY row_number() OVER (PARTITION BY component_type ORDER BY CASE {ROW_STATUS} WHEN 'offline' THEN 4 WHEN 'unhealthy' THEN 3 WHEN 'unknown' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END DESC, id) = 1""",
)
def _(t: Tables) -> DataFrame:
    return reports.worst_verdicts(t.component_rows, "component_type")


@query("build_revisions", "SELECT DISTINCT trim(build_revision) AS build_revision FROM workers WHERE trim(build_revision) NOT IN ('', 'unknown')")
def _(t: Tables) -> DataFrame:
    return reports.known_revisions(t.workers)


@query(
    "merged_components",
    """SELECT display_name, status, reason, CASE display_name WHEN 'Scheduler' THEN 3 WHEN 'Monitoring Ingestor' THEN 6 WHEN 'Monitoring Projector' THEN 7 WHEN 'Alert Evaluator' THEN 9 WHEN 'PII Scanner' THEN 8
  WHEN 'Redis Delivery' THEN 4 ELSE 11 END AS position
FROM (SELECT component_type AS display_name, min(status) AS status, max(hostname) AS reason FROM server_rows GROUP BY 1
 UNION ALL SELECT component_type, min(status), max(hostname) FROM client_rows WHERE component_type NOT IN (SELECT component_type FROM server_rows)
  AND component_type <> 'Monitoring Ingestor / Projector' GROUP BY 1) AS x""",
    {
        "server_rows": "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Scheduler' WHEN 1 THEN 'Monitoring Ingestor' WHEN 2 THEN 'Monitoring Projector' ELSE 'Custom' END AS component_type, 'healthy' AS status, s_name AS hostname FROM supplier",
        "client_rows": "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Scheduler' WHEN 1 THEN 'Monitoring Ingestor / Projector' WHEN 2 THEN 'Redis Delivery' ELSE 'Local' END AS component_type, 'degraded' AS status, s_name AS hostname FROM supplier",
    },
)
def _(t: Tables) -> DataFrame:
    def rows(names: list[str], status: str) -> DataFrame:
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % 4 + 1).cast("int"))
        return t.supplier.groupBy(pick.alias("display_name")).agg(F.lit(status).alias("status"), F.max("s_name").alias("reason"))

    server = rows(["Scheduler", "Monitoring Ingestor", "Monitoring Projector", "Custom"], "healthy")
    client = rows(["Scheduler", "Monitoring Ingestor / Projector", "Redis Delivery", "Local"], "degraded")
    return reports.merge_rows(client, server)


# --- freshness ---

OBSERVED = {
    "observed": "SELECT 'Event Ingestion' AS subsystem, max(ingested_at) AS seen FROM event_log UNION ALL SELECT 'Projection', max(last_event_at) FROM fold"
    " UNION ALL SELECT 'Redis Queue Inspection', max(sampled_at) FROM queue_samples UNION ALL SELECT 'PII Scanner', max(created_at) FROM tasks"
    f" UNION ALL SELECT 'Alert Evaluation', TIMESTAMP '{SWEEP_END}'",
    **STORED,
}


@query(
    "subsystem_freshness",
    """SELECT subsystem, seen AS last_observed_at, (epoch_us($NOW) - epoch_us(seen)) / 1000000.0::DOUBLE AS lag_seconds, seen IS NOT NULL AS available,
 CASE WHEN seen IS NULL THEN 'unknown' WHEN epoch_us($NOW) - epoch_us(seen) > 60000000 THEN 'slow' ELSE 'ok' END AS level FROM observed""",
    OBSERVED,
)
def _(t: Tables) -> DataFrame:
    return monitoring.subsystem_freshness(with_projections(t), NOW, SWEEP_END)


@query(
    "derived_components",
    """SELECT component_kind, health FROM (
 SELECT CASE subsystem WHEN 'Event Ingestion' THEN 'MONITORING_INGESTOR' WHEN 'Projection' THEN 'MONITORING_PROJECTOR' ELSE 'PII_SCANNER' END AS component_kind,
  CASE WHEN seen IS NULL THEN 'UNKNOWN' WHEN epoch_us($NOW) - epoch_us(seen) <= 60000000 OR NOT (SELECT count(*) > 0 FROM tasks WHERE deleted_at IS NULL AND (status IN ('Queued', 'Running') OR (status = 'Pending' AND run_at <= $NOW)))
   THEN 'HEALTHY' ELSE 'DEGRADED' END AS health FROM observed WHERE subsystem IN ('Event Ingestion', 'Projection', 'PII Scanner')
 UNION ALL SELECT 'ALERT_EVALUATOR', 'OFFLINE'
 UNION ALL SELECT 'REDIS_DELIVERY', CASE WHEN count(*) FILTER (WHERE consumer_count = 0) > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END
  FROM (SELECT * FROM queue_samples QUALIFY row_number() OVER (PARTITION BY queue_name ORDER BY sampled_at DESC, id DESC) = 1) AS q) AS x""",
    OBSERVED,
)
def _(t: Tables) -> DataFrame:
    return monitoring.derived_components(with_projections(t), NOW, SWEEP_END).select("component_kind", "health")


@query(
    "subsystem_verdicts",
    """SELECT subsystem, CASE WHEN seen IS NULL THEN 'unavailable' WHEN epoch_us($NOW) - epoch_us(seen) > 120000000 THEN 'degraded' ELSE 'available' END AS verdict,
 CASE WHEN seen IS NULL THEN 'unavailable' WHEN epoch_us($NOW) - epoch_us(seen) > 120000000 AND subsystem NOT IN ('event-ingestion', 'projection') THEN 'degraded' ELSE 'available' END AS idle_verdict
FROM (SELECT CASE subsystem WHEN 'Event Ingestion' THEN 'event-ingestion' WHEN 'Projection' THEN 'projection' ELSE subsystem END AS subsystem, seen FROM observed) AS x""",
    OBSERVED,
)
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("subsystem") == "Event Ingestion", "event-ingestion").when(F.col("subsystem") == "Projection", "projection").otherwise(F.col("subsystem"))
    verdict = v.subsystem_verdict(F.col("last_observed_at"), NOW)
    return monitoring.newest_observations(with_projections(t), SWEEP_END).select(
        name.alias("subsystem"), verdict.alias("verdict"), v.soften_when_idle(name, verdict, F.lit(False)).alias("idle_verdict")
    )


@query("log_watermark", "SELECT greatest(coalesce(max(id), 0) - 5, 0) AS watermark FROM event_log")
def _(t: Tables) -> DataFrame:
    return monitoring.log_watermark(t.event_log)


@query(
    "pipeline_lag",
    """SELECT greatest((epoch_us(max_by(ingested_at, (ingested_at, id))) - epoch_us(max_by(occurred_at, (ingested_at, id)))) // 1000, 0) AS last_lag_ms,
 max(greatest((epoch_us(ingested_at) - epoch_us(occurred_at)) // 1000, 0)) AS max_lag_ms, count(*) AS recorded,
 (SELECT count(*) FROM event_log WHERE event_type <> 'attempt.heartbeat') AS published, greatest(count(*) - (SELECT count(*) FROM event_log WHERE event_type <> 'attempt.heartbeat'), 0) AS backlog FROM event_log""",
)
def _(t: Tables) -> DataFrame:
    return monitoring.pipeline_lag(t.event_log, t.event_log.filter(F.col("event_type") != "attempt.heartbeat"))


@query(
    "sweep_status",
    """SELECT id, failed_checks, CASE WHEN failed_checks = 0 THEN 'COMPLETE' WHEN failed_checks = 7 THEN 'UNKNOWN' WHEN failed_checks < 3 THEN 'PARTIAL' ELSE 'DEGRADED' END AS status FROM monitoring_healths""",
)
def _(t: Tables) -> DataFrame:
    return t.monitoring_healths.select("id", "failed_checks", v.sweep_status(F.col("failed_checks"), 7).alias("status"))


@query(
    "queue_verdicts",
    """SELECT id, queue_name, CASE WHEN pending_count > 20 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health, concat(pending_count, ' messages pending (degraded above 20)') AS reason,
 CASE WHEN oldest_pending_age_seconds > 300 THEN 'offline' WHEN oldest_pending_age_seconds > 60 THEN 'degraded' ELSE 'healthy' END AS age_status,
 CASE WHEN pending_count >= 50 THEN concat('pending is ', pending_count, ' (unhealthy at 50+)') WHEN pending_count >= 20 THEN concat('pending is ', pending_count, ' (degraded at 20+)')
  ELSE concat('pending is ', pending_count) END AS count_reason FROM queue_samples""",
)
def _(t: Tables) -> DataFrame:
    pending = F.col("pending_count")
    return t.queue_samples.select(
        "id",
        "queue_name",
        v.queue_verdict(pending).alias("health"),
        v.queue_reason(pending).alias("reason"),
        v.verdict_from_age(F.col("oldest_pending_age_seconds"), 60, 300)["status"].alias("age_status"),
        v.verdict_from_count(pending, 20, 50, "pending")["reason"].alias("count_reason"),
    )


@query("latest_heartbeat", "SELECT worker_id, instance_id, occurred_at, running_attempts, capacity, id FROM heartbeats QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY occurred_at DESC, id DESC) = 1")
def _(t: Tables) -> DataFrame:
    return latest.newest_heartbeats(t.heartbeats)


@query(
    "heartbeat_status",
    "SELECT id, CASE WHEN epoch_us($NOW) - epoch_us(occurred_at) > 300000000 THEN 'offline' WHEN epoch_us($NOW) - epoch_us(occurred_at) > 60000000 THEN 'degraded' ELSE 'online' END AS status FROM heartbeats",
)
def _(t: Tables) -> DataFrame:
    return t.heartbeats.select("id", v.worker_status(age_seconds(F.col("occurred_at"), NOW)).alias("status"))
