"""Metric samples, rule matching, alert evaluation, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.catalog.registry import query
from opswatch.functions.status import notification_payload, should_notify
from opswatch.operators import filters
from opswatch.plans import alerting
from opswatch.sources.tables import Tables
from opswatch.sources.views import NOW


def rules_values(rules: list[dict] = alerting.DEFAULT_RULES) -> str:
    """Rules as a VALUES list."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "[" + ", ".join(f"'{i}'" for i in x) + "]"
        return f"'{x}'" if isinstance(x, str) else str(x)

    names = ("id", "enabled", "source", "annotation_type", "metric", "operator", "threshold", "text_value", "alert_type", "severity", "scope_type", "scope_values")
    neutral = {"enabled": True, "scope_type": "GLOBAL", "scope_values": [""]}
    rows = ", ".join("(" + ", ".join(lit({**neutral, **r}.get(n)) for n in names) + ")" for r in rules)
    return f"SELECT * FROM (VALUES {rows}) AS v({', '.join(names)})"


def _sample(metric: str, kind: str, subject: str, numeric: str, text: str, source: str, scope: str = "''") -> str:
    return (
        f"SELECT '{metric}' AS metric, '{kind}' AS subject_type, CAST({subject} AS VARCHAR) AS subject_id, {scope} AS scope_value,"
        f" CAST({numeric} AS DOUBLE) AS numeric, {text} AS text FROM {source}"
    )


def _text(number: str) -> str:
    return f"regexp_replace(CAST(CAST({number} AS DECIMAL(38, 9)) AS VARCHAR), '\\.?0+$', '')"


def _recent(ts: str, seconds: int, now: str) -> str:
    return f"{ts} >= TIMESTAMP '{now}' - INTERVAL '{seconds}' SECOND AND {ts} <= TIMESTAMP '{now}'"


def _latest(view: str, key: str, ts: str, seconds: int, now: str, condition: str = "true") -> str:
    return (
        f"(SELECT * FROM {view} WHERE {_recent(ts, seconds, now)} AND {condition}"
        f" QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {ts} DESC, id DESC) = 1) AS x"
    )


def _age(column: str, now: str = NOW) -> str:
    return f"(epoch_us(TIMESTAMP '{now}') - epoch_us({column})) / 1000000.0::DOUBLE"


def samples_sql(now: str = NOW) -> str:
    """Metric samples as they were at ``now``."""
    beats = _latest("heartbeats", "worker_id", "occurred_at", 3600, now)
    queues = _latest("queue_samples", "queue_name", "sampled_at", 3600, now)
    quiet = f"instance_id NOT IN (SELECT instance_id FROM workers WHERE stopped_at IS NOT NULL OR draining_at > TIMESTAMP '{now}' - INTERVAL '5' MINUTE)"
    used = "running_attempts / capacity::DOUBLE * 100"
    parts = [
        _sample("worker.heartbeat_age", "WORKER", "worker_id", _age("occurred_at", now), _text(_age("occurred_at", now)), f"{beats} WHERE {quiet}"),
        _sample("worker.capacity_used", "WORKER", "worker_id", used, _text(used), f"{beats} WHERE capacity > 0"),
        *[
            _sample(m, "QUEUE", "queue_name", c, f"CAST({c} AS VARCHAR)", queues)
            for m, c in [
                ("queue.oldest_age", "oldest_pending_age_seconds"), ("queue.pending_count", "pending_count"), ("queue.consumer_count", "consumer_count"),
            ]
        ],
        _sample(
            "monitoring.status", "PLATFORM", "'platform'", "failed_checks", "status",
            f"(SELECT * FROM monitoring_healths WHERE {_recent('sampled_at', 3600, now)} ORDER BY sampled_at DESC, id DESC LIMIT 1) AS x",
        ),
        _sample("pii.policy_action", "PII_FINDING", "id", "confidence", "policy_action", f"(SELECT * FROM findings WHERE {_recent('created_at', 900, now)}) AS x", "type"),
        *[
            _sample(m, "RUN", "job_id", _age("occurred_at", now), _text(_age("occurred_at", now)), _latest("event_log", "job_id", "occurred_at", 86400, now, f"event_type = '{e}'"))
            for m, e in [
                ("run.failed_age", "task.failed"), ("run.retries_exhausted_age", "task.retries_exhausted"),
                ("run.timed_out_age", "task.timed_out"), ("pii.scan_failed_age", "pii.scan_failed"),
            ]
        ],
    ]
    return " UNION ALL ".join(parts)


MATCH = (
    "(r.scope_type = 'GLOBAL' OR (r.scope_type = 'PII_CATEGORY' AND list_contains(r.scope_values, s.scope_value)))"
    " AND CASE r.operator WHEN 'GT' THEN s.numeric > r.threshold WHEN 'LTE' THEN s.numeric <= r.threshold WHEN 'EQ' THEN s.text = r.text_value ELSE s.text <> r.text_value END"
)
RULES = {"rules": rules_values(), "samples": samples_sql()}
BREACH = "SELECT s.*, r.id AS rule_id, r.alert_type, r.severity, r.operator FROM samples AS s JOIN rules AS r ON r.metric = s.metric AND r.enabled AND r.source = 'METRIC' WHERE " + MATCH


def rules(t: Tables) -> DataFrame:
    return alerting.rules_frame(t.events.sparkSession)


WANTED = [m for m in alerting.RESOLVERS if m != "schedule.creation_lateness"]


@query("metric_samples", "SELECT * FROM samples", RULES)
def _(t: Tables) -> DataFrame:
    return alerting.metric_samples(t, NOW, WANTED).drop("evidence")


@query("metric_evidence")
def _(t: Tables) -> DataFrame:
    return alerting.metric_samples(t, NOW).select("metric", "subject_id", "evidence")


@query("rule_breaches", f"SELECT metric, subject_type, subject_id, rule_id, alert_type, severity FROM ({BREACH}) AS b", RULES)
def _(t: Tables) -> DataFrame:
    hits = alerting.breaches(alerting.metric_samples(t, NOW, WANTED), rules(t))
    return hits.select("metric", "subject_type", "subject_id", F.col("id").alias("rule_id"), "alert_type", "severity")


# every sample that exists in the log, whatever its age: the whole event log takes part
@query(
    "event_ages",
    f"SELECT job_id AS subject_id, {_age('max(occurred_at)')} AS age_seconds FROM event_log WHERE event_type = 'task.failed' AND occurred_at >= $NOW - INTERVAL '24' HOUR GROUP BY job_id",
)
def _(t: Tables) -> DataFrame:
    return alerting.event_age("run.failed_age", "task.failed")(t, NOW).select("subject_id", F.col("numeric").alias("age_seconds"))


@query(
    "worst_lateness",
    """SELECT schedule_id, late AS lateness_seconds, job_id AS run_id, expected_at, created_at FROM (
 SELECT *, greatest(epoch_us(created_at) - epoch_us(expected_at), 0) / 1000000.0::DOUBLE AS late FROM tasks
 WHERE schedule_id <> '' AND created_at >= TIMESTAMP '2000-12-31' - INTERVAL '87600' HOUR AND expected_at > TIMESTAMP '2000-01-01') AS x
QUALIFY row_number() OVER (PARTITION BY schedule_id ORDER BY late DESC, id) = 1""",
)
def _(t: Tables) -> DataFrame:
    return alerting.worst_creation_lateness(t.tasks, "2000-12-31 00:00:00", 87600 * 3600)




def alert_id_sql(rule: str, subject_type: str, subject: str, source: str, now: str) -> str:
    return f"concat('al-', substr(sha256(concat_ws('|', {rule}, {subject_type}, {subject}, {source}, CAST(epoch_us(TIMESTAMP '{now}') AS VARCHAR))), 1, 26))"


SUBJECT = "CASE n.subject_type WHEN 'TASK' THEN 'RUN' ELSE n.subject_type END"
FROM_ANNOTATIONS = f"""
SELECT {alert_id_sql("r.id", SUBJECT, "n.subject_id", "n.annotation_id", NOW)} AS alert_id, r.alert_type, r.severity, 'OPEN' AS status, CASE n.subject_type WHEN 'TASK' THEN 'RUN' ELSE n.subject_type END AS subject_type, n.subject_id, r.id AS rule_id,
 concat(n.type, ' on ', CASE n.subject_type WHEN 'TASK' THEN 'RUN' ELSE n.subject_type END, ' ', n.subject_id) AS summary, n.annotation_id AS source_annotation_id
FROM annotations AS n JOIN rules AS r ON r.source = 'ANNOTATION' AND r.enabled AND r.annotation_type = n.type
WHERE n.resolved_at IS NULL AND n.annotation_id NOT IN (SELECT source_annotation_id FROM alerts WHERE status <> 'RESOLVED')"""
FROM_METRICS = f"""
SELECT {alert_id_sql("rule_id", "subject_type", "subject_id", "''", NOW)} AS alert_id, alert_type, severity, 'OPEN' AS status, subject_type, subject_id, rule_id, concat(alert_type, ' on ', subject_type, ' ', subject_id) AS summary, '' AS source_annotation_id
FROM ({BREACH}) AS b WHERE NOT EXISTS (SELECT 1 FROM alerts AS a WHERE a.status <> 'RESOLVED' AND a.rule_id = b.rule_id AND a.subject_type = b.subject_type AND a.subject_id = b.subject_id)"""
OPENED = ("alert_id", "alert_type", "severity", "status", "subject_type", "subject_id", "rule_id", "summary", "source_annotation_id")


@query("alerts_opened", f"{FROM_ANNOTATIONS} UNION ALL {FROM_METRICS}", RULES)
def _(t: Tables) -> DataFrame:
    samples = alerting.metric_samples(t, NOW, WANTED)
    return alerting.evaluate(t, rules(t), NOW, samples=samples)["opened"].select(*OPENED)


@query("alert_evidence")
def _(t: Tables) -> DataFrame:
    opened = alerting.evaluate(t, rules(t), NOW)["opened"]
    return opened.select("rule_id", "subject_id", "evidence")


RESOLVED_SQL = f"""
SELECT alert_id FROM alerts WHERE status <> 'RESOLVED' AND source_annotation_id IN (SELECT annotation_id FROM annotations WHERE resolved_at IS NOT NULL)
UNION ALL SELECT a.alert_id FROM alerts AS a JOIN rules AS r ON r.id = a.rule_id AND r.enabled AND r.source = 'METRIC'
JOIN samples AS s ON s.metric = r.metric AND s.subject_type = a.subject_type AND s.subject_id = a.subject_id
WHERE a.status <> 'RESOLVED' AND a.source_annotation_id = '' AND NOT ({MATCH})"""


@query("alerts_resolved", RESOLVED_SQL, RULES)
def _(t: Tables) -> DataFrame:
    samples = alerting.metric_samples(t, NOW, WANTED)
    return alerting.evaluate(t, rules(t), NOW, samples=samples)["resolved"].select("alert_id")


SEVERITY_SQL = f"""SELECT DISTINCT * FROM (SELECT a.alert_id, a.severity, b.severity AS new_severity FROM alerts AS a JOIN ({BREACH}) AS b ON b.rule_id = a.rule_id AND b.subject_type = a.subject_type AND b.subject_id = a.subject_id
 WHERE a.status <> 'RESOLVED'
UNION ALL SELECT a.alert_id, a.severity, r.severity FROM alerts AS a JOIN annotations AS n ON n.annotation_id = a.source_annotation_id AND n.resolved_at IS NULL JOIN rules AS r ON r.source = 'ANNOTATION' AND r.annotation_type = n.type
 WHERE a.status <> 'RESOLVED') AS x WHERE severity <> new_severity"""


@query("severity_changes", SEVERITY_SQL, RULES)
def _(t: Tables) -> DataFrame:
    samples = alerting.metric_samples(t, NOW, WANTED)
    return alerting.severity_changes(t.alerts, t.annotations, samples, rules(t))


@query(
    "notification_rows",
    """SELECT alert_id, rule_id, subject_type, subject_id, channel, target, 'PENDING' AS status, 0 AS attempt_count FROM alerts,
 (VALUES ('webhook', 'https://example.invalid/hook'), ('pager', 'on-call')) AS c(channel, target) WHERE severity IN ('WARNING', 'CRITICAL') AND alerts.status = 'OPEN'""",
)
def _(t: Tables) -> DataFrame:
    opened = t.alerts.filter(F.col("status") == "OPEN")
    return alerting.notification_rows(opened, [("webhook", "https://example.invalid/hook"), ("pager", "on-call")])


@query(
    "notification_payloads",
    """SELECT alert_id, concat('{"alert_id":"', alert_id, '","alert_type":"', alert_type, '","severity":"', severity, '","status":"', status, '","summary":"', summary, '","subject_type":"', subject_type,
 '","subject_id":"', subject_id, '","evidence":', evidence, '}') AS payload FROM alerts WHERE severity IN ('WARNING', 'CRITICAL')""",
)
def _(t: Tables) -> DataFrame:
    loud = t.alerts.filter(should_notify(F.col("severity")))
    return loud.select("alert_id", notification_payload({c: F.col(c) for c in loud.columns}).alias("payload"))


@query(
    "sendable_notifications",
    """SELECT notification_id, status, attempt_count FROM notifications WHERE status = 'PENDING' OR (status = 'FAILED' AND attempt_count < 3
 AND (last_attempt_at IS NULL OR last_attempt_at < $NOW - INTERVAL '5' MINUTE))""",
)
def _(t: Tables) -> DataFrame:
    return filters.sendable_notifications(t.notifications, NOW).select("notification_id", "status", "attempt_count")


@query(
    "alerts_filtered",
    """SELECT alert_id, alert_type, severity, status, opened_at FROM alerts WHERE alert_type IN ('RUN_FAILED', 'QUEUE_BACKLOG') AND status = 'OPEN' AND rule_version = 1
 AND opened_at >= TIMESTAMP '2024-01-05' AND opened_at <= TIMESTAMP '2024-01-25'""",
)
def _(t: Tables) -> DataFrame:
    found = filters.filter_alerts(t.alerts, "RUN_FAILED,QUEUE_BACKLOG", 1, "2024-01-05", "2024-01-25", status="OPEN")
    return found.select("alert_id", "alert_type", "severity", "status", "opened_at")


@query("findings_search", "SELECT id, job_id, type, policy_action, created_at FROM findings WHERE type = 'SSN' AND source = 'JOB_PAYLOAD' AND policy_action = 'BLOCK'")
def _(t: Tables) -> DataFrame:
    return filters.filter_findings(t.findings, pii_type="SSN", source="JOB_PAYLOAD", policy_action="BLOCK").select(
        "id", "job_id", "type", "policy_action", "created_at"
    )
