"""Aggregated reports and cards; pages of workers and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.catalog.feed import CATEGORY
from opswatch.catalog.registry import query
from opswatch.functions import feed, timing
from opswatch.functions.status import short_checksum
from opswatch.operators import filters
from opswatch.operators.paging import QUEUE_HISTORY_CAP
from opswatch.plans import reports
from opswatch.sources.tables import Tables
from opswatch.sources.views import NOW

NEWEST_QUEUE = "(SELECT * FROM queue_samples QUALIFY row_number() OVER (PARTITION BY queue_name ORDER BY sampled_at DESC, id DESC) = 1) AS q"


@query(
    "system_metrics",
    """SELECT (SELECT count(*) FROM tasks) AS runs_created_total, (SELECT count(*) FROM tasks WHERE status = 'Completed') AS runs_completed_total, (SELECT count(*) FROM tasks WHERE status = 'Failed') AS runs_failed_total,
 (SELECT pending_count FROM queue_samples ORDER BY sampled_at DESC, id DESC LIMIT 1) AS queue_depth, (SELECT count(DISTINCT worker_id) FROM heartbeats WHERE occurred_at > $NOW - INTERVAL '1' HOUR) AS worker_online""",
)
def _(t: Tables) -> DataFrame:
    return reports.system_metrics(t, NOW, 3600)


@query(
    "overview",
    f"""SELECT (SELECT count(*) FROM tasks WHERE status = 'Running') AS active_runs, (SELECT count(*) FROM tasks WHERE status = 'Pending') AS queued_runs,
 (SELECT count(DISTINCT execution_chain_id) FROM tasks WHERE parent_run_id <> '' AND status IN ('Pending', 'Queued', 'Running')) AS retrying_chains,
 (SELECT count(*) FROM alerts WHERE status = 'OPEN') AS open_alerts, (SELECT count(*) FROM {NEWEST_QUEUE} WHERE pending_count > 20) AS degraded_queues,
 (SELECT count(DISTINCT worker_id) FROM workers WHERE worker_id NOT IN (SELECT worker_id FROM heartbeats)) AS offline_workers""",
)
def _(t: Tables) -> DataFrame:
    return reports.overview(t)


@query("throughput", "SELECT count(*) / 720.0::DOUBLE AS per_minute FROM event_log WHERE event_type IN ('task.completed', 'task.failed') AND occurred_at > $NOW - INTERVAL '12' HOUR AND occurred_at <= $NOW")
def _(t: Tables) -> DataFrame:
    return reports.throughput(t.event_log, NOW, 12 * 3600)


@query(
    "pii_breakdown",
    """SELECT 'type' AS dimension, type AS value, count(*) AS n FROM findings GROUP BY type UNION ALL SELECT 'action', policy_action, count(*) FROM findings GROUP BY policy_action
UNION ALL SELECT 'rule', rule_id, count(*) FROM findings GROUP BY rule_id UNION ALL SELECT 'runs_with_findings', '', count(DISTINCT job_id) FROM findings
UNION ALL SELECT 'scan_failures', '', count(*) FROM tasks WHERE scan_status = 'SCAN_ERROR'""",
)
def _(t: Tables) -> DataFrame:
    return reports.pii_breakdown(t.findings, t.tasks)


@query(
    "alert_cards",
    """SELECT concat('active_', lower(severity)) AS card, count(*) AS n FROM alerts WHERE status <> 'RESOLVED' GROUP BY severity UNION ALL
SELECT 'new', count(*) FROM alerts WHERE epoch_us($NOW) - epoch_us(opened_at) < 86400000000 UNION ALL SELECT 'acknowledged', count(*) FROM alerts WHERE status = 'ACKNOWLEDGED'""",
)
def _(t: Tables) -> DataFrame:
    return reports.alert_cards(t.alerts, NOW, 86400)


@query("most_affected", "SELECT subject_type, subject_id, count(*) AS alerts FROM alerts AS a WHERE status <> 'RESOLVED' GROUP BY 1, 2 ORDER BY alerts DESC, subject_type, subject_id LIMIT 3")
def _(t: Tables) -> DataFrame:
    return reports.most_affected(t.alerts)


@query(
    "priority_banner",
    """SELECT CASE WHEN c > 0 THEN 'critical' WHEN w > 0 THEN 'warning' ELSE 'healthy' END AS level, c AS critical, w AS warning, CASE WHEN c > 0 THEN tc WHEN w > 0 THEN tw END AS top_alert FROM (
 SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'WARNING') AS w, max_by(summary, (opened_at, id)) FILTER (WHERE severity = 'CRITICAL') AS tc,
  max_by(summary, (opened_at, id)) FILTER (WHERE severity = 'WARNING') AS tw FROM alerts WHERE status = 'OPEN') AS x""",
)
def _(t: Tables) -> DataFrame:
    return reports.priority_banner(t.alerts)


@query(
    "queue_cards",
    f"""SELECT count(*) FILTER (WHERE pending_count > 20) AS degraded, count(*) FILTER (WHERE pending_count <= 20) AS healthy, CAST(sum(stream_length) AS BIGINT) AS total_depth, max(oldest_pending_age_seconds) AS worst_oldest_age,
 (SELECT queue_name FROM {NEWEST_QUEUE} ORDER BY oldest_pending_age_seconds DESC, queue_name LIMIT 1) AS worst_queue, count(*) FILTER (WHERE consumer_count = 0) AS no_consumer FROM {NEWEST_QUEUE}""",
)
def _(t: Tables) -> DataFrame:
    return reports.queue_cards(t.queue_samples)


WORKERS_SQL = """
SELECT w.worker_id, w.instance_id, w.hostname, w.started_at, w.configured_capacity, h.occurred_at AS last_heartbeat, coalesce(h.running_attempts, 0) AS running_attempts, coalesce(h.capacity, 0) AS capacity,
 CASE WHEN h.occurred_at IS NULL THEN 'UNKNOWN' WHEN epoch_us($NOW) - epoch_us(h.occurred_at) > 300000000 THEN 'OFFLINE' WHEN epoch_us($NOW) - epoch_us(h.occurred_at) > 60000000 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health, w.build_revision
FROM (SELECT * FROM workers QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY started_at DESC, id DESC) = 1) AS w
LEFT JOIN (SELECT * FROM heartbeats WHERE occurred_at >= $NOW - INTERVAL '24' HOUR QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY occurred_at DESC, id DESC) = 1) AS h ON h.worker_id = w.worker_id""".replace(
    "$NOW", f"TIMESTAMP '{NOW}'"
)


@query("worker_list", WORKERS_SQL)
def _(t: Tables) -> DataFrame:
    return reports.worker_list(t, NOW).drop("health_reason")


@query(
    "worker_cards",
    """SELECT count(*) FILTER (WHERE health = 'HEALTHY') AS online, count(*) FILTER (WHERE health = 'DEGRADED') AS degraded, count(*) FILTER (WHERE health = 'OFFLINE') AS offline, CAST(sum(running_attempts) AS BIGINT) AS running,
 CAST(sum(capacity) AS BIGINT) AS capacity, coalesce(sum(running_attempts) * 100.0::DOUBLE / nullif(sum(capacity), 0), 0) AS utilization_percent FROM worker_rows""",
    {"worker_rows": WORKERS_SQL},
)
def _(t: Tables) -> DataFrame:
    return reports.worker_cards(reports.worker_list(t, NOW))


@query("workers_searched", "SELECT worker_id, hostname FROM worker_rows WHERE contains(worker_id, 'w1') AND hostname LIKE '%host-1%' AND health = 'OFFLINE'", {"worker_rows": WORKERS_SQL})
def _(t: Tables) -> DataFrame:
    listed = reports.worker_list(t, NOW).withColumn("status", F.lower("health"))
    return filters.search_workers(listed, "W1", "offline", "HOST-1").select("worker_id", "hostname")


@query(
    "worker_details",
    """SELECT w.worker_id, w.instance_id, w.hostname, w.started_at, w.configured_capacity, h.occurred_at AS last_heartbeat, h.running_attempts, h.capacity, coalesce(a.active, 0) AS active_attempts,
 coalesce(a.done, 0) AS recent_completions, coalesce(a.bad, 0) AS recent_failures, coalesce(l.n, 0) AS alert_count, coalesce(l.open_n, 0) AS active_alert_count
FROM (SELECT * FROM workers QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY started_at DESC, id DESC) = 1) AS w
LEFT JOIN (SELECT * FROM heartbeats QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY occurred_at DESC, id DESC) = 1) AS h ON h.worker_id = w.worker_id
LEFT JOIN (SELECT worker_id, count(*) FILTER (WHERE status IN ('Claimed', 'Started')) AS active, count(*) FILTER (WHERE status = 'Succeeded') AS done, count(*) FILTER (WHERE status IN ('Failed', 'Abandoned')) AS bad
 FROM attempts GROUP BY worker_id) AS a ON a.worker_id = w.worker_id
LEFT JOIN (SELECT subject_id, count(*) AS n, count(*) FILTER (WHERE status = 'OPEN') AS open_n FROM alerts WHERE subject_type = 'WORKER' GROUP BY 1) AS l ON l.subject_id = w.worker_id""",
)
def _(t: Tables) -> DataFrame:
    return reports.worker_details(t)


@query("worker_attempts", "SELECT attempt_id, status, CASE WHEN status IN ('Claimed', 'Started') THEN 'active' WHEN status = 'Succeeded' THEN 'completed' ELSE 'failed' END AS fate, started_at FROM attempts WHERE worker_id = 'w7'")
def _(t: Tables) -> DataFrame:
    return reports.worker_attempts(t, "w7").select("attempt_id", "status", "fate", "started_at")


@query(
    "queue_list",
    """SELECT queue_name, id, pending_count, consumer_count, stream_length, oldest_pending_age_seconds, sampled_at, CASE WHEN pending_count > 20 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health,
 concat(pending_count, ' messages pending (degraded above 20)') AS health_reason FROM queue_samples WHERE sampled_at >= $NOW - INTERVAL '12' HOUR
QUALIFY row_number() OVER (PARTITION BY queue_name ORDER BY sampled_at DESC, id DESC) = 1""",
)
def _(t: Tables) -> DataFrame:
    return reports.queue_list(t, NOW, 12 * 3600)


@query("queues_searched", f"SELECT queue_name, pending_count FROM {NEWEST_QUEUE} WHERE pending_count > 20 AND contains(queue_name, 'q') AND consumer_count = 0")
def _(t: Tables) -> DataFrame:
    listed = reports.queue_list(t, NOW, 31 * 86400)
    return filters.search_queues(listed, "Q", "DEGRADED", no_consumers=True).select("queue_name", "pending_count")


@query("queue_history", "SELECT id, sampled_at, pending_count, CASE WHEN pending_count > 20 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM queue_samples WHERE queue_name = 'q3' ORDER BY sampled_at DESC, id DESC LIMIT 100")
def _(t: Tables) -> DataFrame:
    return reports.queue_history(t, "q3", QUEUE_HISTORY_CAP).select("id", "sampled_at", "pending_count", "health")


@query("queue_history_all", "SELECT id, sampled_at, pending_count, CASE WHEN pending_count > 20 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM queue_samples WHERE queue_name = 'q3'")
def _(t: Tables) -> DataFrame:
    return reports.queue_history(t, "q3").select("id", "sampled_at", "pending_count", "health")


@query(
    "run_cards",
    """SELECT c.*, (SELECT count(DISTINCT execution_chain_id) FROM tasks WHERE parent_run_id <> '' AND status IN ('Pending', 'Queued', 'Running')) AS retrying,
 (SELECT count(*) FROM alerts WHERE status = 'OPEN' AND alert_type IN ('RUN_LOST', 'RUN_STUCK')) AS lost_stuck, failed * 100.0::DOUBLE / (succeeded + failed) AS failure_rate
FROM (SELECT count(*) FILTER (WHERE status = 'Completed') AS succeeded, count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status = 'Running') AS running,
 count(*) FILTER (WHERE status = 'Queued') AS queued, count(*) FILTER (WHERE status = 'Blocked') AS blocked FROM tasks) AS c""",
)
def _(t: Tables) -> DataFrame:
    return reports.run_cards(t, NOW)


@query("recent_alerts", "SELECT alert_id, created_at FROM alerts WHERE created_at >= $NOW - INTERVAL '7' DAY")
def _(t: Tables) -> DataFrame:
    return filters.within_range(t.alerts, NOW, "7d").select("alert_id", "created_at")


@query("activity_by_category", f"SELECT {CATEGORY} AS category, count(*) AS n FROM activity_log GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return reports.category_counts(t.activity_log)


@query(
    "activity_histogram",
    "SELECT TIMESTAMP '2024-01-20 10:00:00' - INTERVAL '1' HOUR * (47 - b) AS bucket_start, "
    + ", ".join(f"count(*) FILTER (WHERE cat = '{c}') AS {c}" for c in feed.CATEGORIES)
    + f""", count(cat) AS total FROM range(48) AS r(b) LEFT JOIN (
 SELECT {CATEGORY} AS cat, least(48 - 1, (epoch_us(occurred_at) - epoch_us(TIMESTAMP '2024-01-18 11:00:00')) // 3600000000) AS slot FROM activity_log WHERE occurred_at >= TIMESTAMP '2024-01-18 11:00:00') AS e ON e.slot = r.b
GROUP BY b""",
)
def _(t: Tables) -> DataFrame:
    """Hourly buckets in the middle of the log: later events count in the last bucket."""
    return reports.activity_histogram(t.activity_log, "2024-01-20 10:17:00", 3600, 48)


@query(
    "activity_gaps",
    "SELECT b AS slot, TIMESTAMP '2024-01-20 10:00:00' - INTERVAL '1' HOUR * (47 - b) >= TIMESTAMP '2024-01-20 03:30:00' AS gap FROM range(48) AS r(b)",
)
def _(t: Tables) -> DataFrame:
    """Buckets that start after the last confirmed time."""
    buckets = reports.activity_histogram(t.activity_log, "2024-01-20 10:17:00", 3600, 48)
    slot = ((F.unix_seconds("bucket_start") - F.unix_seconds(timing.instant("2024-01-18 11:00:00"))) / 3600).cast("bigint")
    return buckets.select(slot.alias("slot"), feed.is_gap_bucket(F.col("bucket_start"), timing.instant("2024-01-20 03:30:00")).alias("gap"))


@query(
    "endpoint_summary",
    """SELECT endpoint, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, CAST(round(avg(duration_ms)) AS BIGINT) AS avg_latency_ms FROM (
 SELECT *, concat('/', array_to_string(list_transform(list_filter(string_split(split_part(path, '?', 1), '/'), lambda x: x <> ''),
  lambda x: CASE WHEN x IN ('runs', 'queues', 'pii', 'findings', 'alerts') THEN x ELSE ':id' END), '/')) AS endpoint FROM access_log) AS y GROUP BY endpoint""",
)
def _(t: Tables) -> DataFrame:
    return reports.endpoint_summary(t.access_log)


@query("policy_history", "SELECT id, policy_version, checksum, activated_at, result, substr(checksum, 1, 8) AS short FROM policy_activations ORDER BY activated_at DESC, id DESC LIMIT 50")
def _(t: Tables) -> DataFrame:
    return reports.policy_history(t.policy_activations, 50).select(
        "id", "policy_version", "checksum", "activated_at", "result", short_checksum(F.col("checksum")).alias("short")
    )


@query("policy_history_all", "SELECT id, policy_version, checksum, activated_at, result, substr(checksum, 1, 8) AS short FROM policy_activations")
def _(t: Tables) -> DataFrame:
    return reports.policy_history(t.policy_activations).select(
        "id", "policy_version", "checksum", "activated_at", "result", short_checksum(F.col("checksum")).alias("short")
    )


@query("active_policy", "SELECT id, policy_version, checksum FROM policy_activations WHERE result = 'SUCCESS' ORDER BY activated_at DESC, id DESC LIMIT 1")
def _(t: Tables) -> DataFrame:
    return reports.active_policy(t.policy_activations).select("id", "policy_version", "checksum")


@query(
    "alert_types",
    "SELECT alert_type, count(*) AS n, concat(alert_type[1], replace(lower(alert_type[2:]), '_', ' ')) AS label FROM alerts GROUP BY alert_type",
)
def _(t: Tables) -> DataFrame:
    return reports.alert_type_counts(t.alerts)


@query(
    "duration_labels",
    """SELECT id, CASE WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm') ELSE concat(s // 3600, 'h') END AS age,
 CASE WHEN v < 1 THEN '<1s' WHEN v < 120 THEN concat(CAST(round(v) AS BIGINT), 's') WHEN v < 7200 THEN concat(CAST(round(v / 60) AS BIGINT), 'm') ELSE concat(CAST(round(v / 3600) AS BIGINT), 'h') END AS lag,
 CASE WHEN r < 60 THEN concat(r, 's') WHEN r < 3600 THEN CASE WHEN r % 60 = 0 THEN concat(r // 60, 'm') ELSE concat(r // 60, 'm ', r % 60, 's') END
  WHEN r % 3600 // 60 = 0 THEN concat(r // 3600, 'h') ELSE concat(r // 3600, 'h ', r % 3600 // 60, 'm') END AS lateness
FROM (SELECT *, CAST(floor(v) AS BIGINT) AS s, CAST(round(v) AS BIGINT) AS r FROM (SELECT event_id AS id, value * 37 AS v FROM events) AS x) AS y""",
)
def _(t: Tables) -> DataFrame:
    seconds = F.col("value") * 37
    return t.events.select(
        F.col("event_id").alias("id"), timing.age_label(seconds).alias("age"), timing.lag_label(seconds).alias("lag"), timing.lateness_label(seconds).alias("lateness")
    )


@query(
    "throughput_labels",
    """SELECT queue, n / 1000.0::DOUBLE AS per_minute, CASE WHEN n / 1000.0::DOUBLE < 10 THEN concat(printf('%.1f', n / 1000.0::DOUBLE), '/min') ELSE concat(CAST(round(n / 1000.0::DOUBLE) AS BIGINT), '/min') END AS label
FROM (SELECT queue, count(*) AS n FROM tasks GROUP BY queue) AS x""",
)
def _(t: Tables) -> DataFrame:
    rates = t.tasks.groupBy("queue").agg((F.count(F.lit(1)) / F.lit(1000.0)).alias("per_minute"))
    return rates.withColumn("label", timing.throughput_label(F.col("per_minute")))


