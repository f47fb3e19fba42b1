"""Operational tables expressed as views over the raw driver tables.

Each view is one SELECT in a dialect both Spark SQL and a checking engine understand; the few functions with
different names are written as ``$NAME(`` and rendered per dialect. The views are row-wise projections and
unions of the raw tables, so they add no shuffle and grow with the data.
"""

from __future__ import annotations

import re

# fixed reference instant of the sample data; every time-dependent function takes it as an argument
NOW = "2024-01-31 00:00:00"

# the number in ``{"k": 69}``
_K = "CAST(substr(props, 7, length(props) - 7) AS INT) AS k"
_EV = f"(SELECT *, {_K} FROM events)"

VIEWS: dict[str, str] = {
    # append-only event log of runs
    "event_log": f"""
SELECT event_id AS id, concat('e', CAST(event_id AS STRING)) AS event_id,
 concat('j', CAST(user_id * 31 + day(ts) AS STRING)) AS job_id,
 CASE WHEN k < 5 THEN 'task.recovery_started' WHEN k < 10 THEN 'attempt.heartbeat' WHEN k < 15 THEN 'task.blocked'
      WHEN k < 20 THEN 'task.retry_scheduled' WHEN k < 22 THEN 'task.retries_exhausted' WHEN k < 24 THEN 'task.timed_out'
      WHEN event_type = 'signup' THEN 'task.created' WHEN event_type = 'view' THEN 'task.queued'
      WHEN event_type = 'click' THEN 'task.started' WHEN event_type = 'purchase' THEN 'task.completed'
      ELSE 'task.failed' END AS event_type,
 ts AS occurred_at, ts + INTERVAL '1' SECOND * (k % 10) AS ingested_at,
 CASE user_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'worker' ELSE 'scheduler' END AS producer,
 concat(CASE user_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'worker' ELSE 'scheduler' END, ':p', CAST(user_id % 7 AS STRING)) AS producer_id,
 event_id AS producer_sequence, concat('w', CAST(user_id % 20 AS STRING)) AS worker_id,
 concat('c', CAST((user_id * 31 + day(ts)) - (user_id * 31 + day(ts)) % 4 AS STRING)) AS execution_chain_id,
 value AS lag_s
FROM {_EV} AS x""",
    # event log with every event family, for feeds and activity reports
    "activity_log": f"""
SELECT event_id AS id, concat('e', CAST(event_id AS STRING)) AS event_id,
 CASE WHEN k < 34 THEN concat('j', CAST(user_id * 31 + day(ts) AS STRING)) WHEN k < 50 THEN concat('w', CAST(user_id % 20 AS STRING))
      WHEN k < 65 THEN concat('q', CAST(user_id % 5 AS STRING)) WHEN k < 75 THEN concat('s', CAST(user_id AS STRING)) ELSE 'system' END AS job_id,
 CASE WHEN k < 5 THEN 'task.progress' WHEN k < 10 THEN 'attempt.heartbeat' WHEN k < 14 THEN 'task.failed' WHEN k < 20 THEN 'task.created'
      WHEN k < 24 THEN 'run.lost' WHEN k < 29 THEN 'attempt.started' WHEN k < 34 THEN 'pii.detected' WHEN k < 39 THEN 'worker.offline'
      WHEN k < 44 THEN 'worker.online' WHEN k < 50 THEN 'worker.heartbeat_age.sample' WHEN k < 54 THEN 'queue.no_consumer'
      WHEN k < 60 THEN 'queue.degraded' WHEN k < 65 THEN 'queue.read.batch' WHEN k < 69 THEN 'schedule.missed'
      WHEN k < 75 THEN 'schedule.occurrence_run_created' WHEN k < 79 THEN 'alert.opened' WHEN k < 82 THEN 'alert.resolved'
      WHEN k < 84 THEN 'pii.policy_activated' WHEN k < 86 THEN 'pii.policy_drift_detected' WHEN k < 89 THEN 'monitoring.degraded'
      WHEN k < 92 THEN 'component.offline' WHEN k < 94 THEN 'redis.reconnected' WHEN k < 96 THEN 'delivery.malformed'
      WHEN k < 98 THEN 'retention.pruned' ELSE 'billing.closed' END AS event_type,
 ts AS occurred_at, ts + INTERVAL '1' SECOND * (k % 10) AS ingested_at,
 CASE user_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'worker' ELSE 'scheduler' END AS producer,
 concat(CASE user_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'worker' ELSE 'scheduler' END, ':p', CAST(user_id % 7 AS STRING)) AS producer_id,
 event_id AS producer_sequence,
 CASE WHEN k < 34 THEN concat('c', CAST((user_id * 31 + day(ts)) - (user_id * 31 + day(ts)) % 4 AS STRING)) ELSE '' END AS execution_chain_id,
 CASE k % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE '' END AS severity,
 CASE WHEN k % 2 = 0 THEN concat('w', CAST(user_id % 20 AS STRING)) ELSE '' END AS worker_id,
 '' AS queue_name, '' AS schedule_id, '' AS schedule_occurrence_id, '' AS trace_id
FROM {_EV} AS x""",
    # runs
    "tasks": """
SELECT o_orderkey AS id, concat('j', CAST(o_orderkey AS STRING)) AS job_id,
 concat('c', CAST(o_orderkey - o_orderkey % 4 AS STRING)) AS execution_chain_id,
 CASE WHEN o_orderkey % 4 > 0 THEN concat('j', CAST(o_orderkey - 1 AS STRING)) ELSE '' END AS parent_run_id,
 CAST(o_orderkey % 4 AS INT) AS retry_index,
 CASE WHEN o_orderstatus = 'F' THEN 'Failed' WHEN o_orderstatus = 'P' THEN 'Completed' WHEN o_orderpriority = '1-URGENT' THEN 'Pending'
      WHEN o_orderpriority = '2-HIGH' THEN 'Queued' ELSE 'Running' END AS status,
 o_orderdate AS created_at, o_orderdate + INTERVAL '1' SECOND * (CAST(floor(o_totalprice) AS BIGINT) % 90) AS updated_at,
 o_orderdate + INTERVAL '1' SECOND * (CAST(floor(o_totalprice) AS BIGINT) % 3600) AS run_at,
 CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (10 - CAST(floor(o_totalprice) AS BIGINT) % 60) END AS expected_at,
 CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate + INTERVAL '1' SECOND * (CAST(floor(o_totalprice) AS BIGINT) % 7200) END AS finished_at,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS published_at,
 CASE WHEN o_orderkey % 97 = 0 THEN o_orderdate END AS deleted_at,
 concat('job-', CAST(o_custkey % 20 AS STRING)) AS task_name, o_orderpriority AS task_type,
 concat('{"order":', CAST(o_orderkey AS STRING), ',"priority":"', o_orderpriority, '"}') AS payload,
 concat('q', CAST(o_custkey % 5 AS STRING)) AS queue,
 CASE WHEN o_custkey % 10 = 0 THEN '' ELSE concat('s', CAST(o_custkey AS STRING)) END AS schedule_id,
 CASE WHEN o_custkey % 10 = 0 THEN '' ELSE concat('s', CAST(o_custkey AS STRING), ':', CAST($UNIX(o_orderdate) AS STRING)) END AS schedule_occurrence_id,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE concat('k', CAST(o_orderkey - o_orderkey % 10 AS STRING)) END AS idempotency_key,
 CASE WHEN o_orderkey % 10 = 0 THEN 'SCAN_ERROR' WHEN o_orderkey % 10 < 4 THEN 'DETECTED' ELSE 'CLEAN' END AS scan_status,
 concat('t', CAST(o_orderkey AS STRING)) AS trace_id, '' AS source_run_id
FROM orders""",
    "attempts": """
SELECT attempt_id, job_id, worker_id, attempt_number, status, claimed_at, claimed_at AS created_at, started_at,
 CASE WHEN status IN ('Succeeded', 'Failed', 'Abandoned') THEN started_at + INTERVAL '1' MINUTE * minutes END AS finished_at, failure_category
FROM (SELECT concat('a', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
   CAST(CAST(l_quantity AS INT) AS STRING)) AS attempt_id,
  concat('j', CAST(l_orderkey AS STRING)) AS job_id, concat('w', CAST(l_suppkey % 100 AS STRING)) AS worker_id, l_linenumber AS attempt_number,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Claimed' WHEN l_returnflag = 'N' THEN 'Started' WHEN l_returnflag = 'A' THEN 'Succeeded'
       WHEN l_linestatus = 'F' THEN 'Failed' ELSE 'Abandoned' END AS status,
  l_shipdate AS claimed_at, CAST(l_quantity AS INT) AS minutes,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE l_shipdate + INTERVAL '5' SECOND END AS started_at,
  CASE l_suppkey % 4 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'INVALID_INPUT' WHEN 2 THEN ' dependency_error ' ELSE 'other' END AS failure_category
 FROM lineitem) AS x""",
    # run events with attempt detail: the run log plus what workers reported about their attempts
    "run_event_details": f"""
SELECT concat('e', CAST(event_id AS STRING)) AS event_id, concat('j', CAST(user_id * 31 + day(ts) AS STRING)) AS job_id,
 CASE WHEN event_type = 'signup' THEN 'task.created' WHEN event_type = 'view' THEN 'task.queued' WHEN event_type = 'click' THEN 'task.started'
      WHEN event_type = 'purchase' THEN 'task.completed' ELSE 'task.failed' END AS event_type, ts AS occurred_at,
 concat('p', CAST(user_id % 7 AS STRING)) AS producer_id, event_id AS producer_sequence, '' AS attempt_id, '' AS worker_id,
 CASE WHEN k < 10 THEN concat(CAST(event_id AS STRING), '-0') ELSE '' END AS stream_position
FROM {_EV} AS x
UNION ALL
SELECT concat('s', attempt_id), job_id, 'attempt.started', l_shipdate + INTERVAL '6' SECOND, 'worker', 1, attempt_id, worker_id, ''
FROM (SELECT *, concat('a', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
   CAST(CAST(l_quantity AS INT) AS STRING)) AS attempt_id, concat('j', CAST(l_orderkey AS STRING)) AS job_id,
   concat('w', CAST(l_suppkey % 100 AS STRING)) AS worker_id FROM lineitem) AS y WHERE l_linenumber % 2 = 0 AND NOT (l_returnflag = 'N' AND l_linestatus = 'O')
UNION ALL
SELECT concat('f', attempt_id), job_id, 'attempt.failed', l_shipdate + INTERVAL '1' HOUR, 'worker', 2, attempt_id, worker_id, ''
FROM (SELECT *, concat('a', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
   CAST(CAST(l_quantity AS INT) AS STRING)) AS attempt_id, concat('j', CAST(l_orderkey AS STRING)) AS job_id,
   concat('w', CAST(l_suppkey % 100 AS STRING)) AS worker_id FROM lineitem) AS y WHERE l_linenumber % 2 = 0 AND l_returnflag = 'R' AND l_linestatus = 'F'""",
    "heartbeats": f"""
SELECT event_id AS id, concat('w', CAST(user_id % 20 AS STRING)) AS worker_id, concat('i', CAST(user_id % 40 AS STRING)) AS instance_id,
 ts AS occurred_at, CAST(floor(value) AS INT) % 5 AS running_attempts, CASE WHEN user_id % 20 = 0 THEN 0 ELSE 5 END AS capacity
FROM events WHERE event_type IN ('click', 'view')""",
    "queue_samples": f"""
SELECT event_id AS id, concat('q', CAST(user_id % 5 AS STRING)) AS queue_name, k AS pending_count, k % 3 AS consumer_count, 2 * k AS stream_length,
 CAST(floor(value) AS BIGINT) AS oldest_pending_age_seconds, ts AS sampled_at
FROM {_EV} AS x WHERE event_type = 'purchase'""",
    "monitoring_healths": f"""
SELECT event_id AS id, CASE k % 4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'DEGRADED' ELSE 'UNKNOWN' END AS status,
 k % 8 AS failed_checks, ts AS sampled_at
FROM {_EV} AS x WHERE event_type = 'view'""",
    "alerts": f"""
SELECT event_id AS id, concat('al', CAST(event_id AS STRING)) AS alert_id,
 CASE k % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
 CASE user_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status,
 CASE k % 3 WHEN 0 THEN 'RUN' WHEN 1 THEN 'WORKER' ELSE 'QUEUE' END AS subject_type,
 CASE k % 3 WHEN 0 THEN concat('j', CAST(user_id * 31 + day(ts) AS STRING)) WHEN 1 THEN concat('w', CAST(user_id % 20 AS STRING))
      ELSE concat('q', CAST(user_id % 5 AS STRING)) END AS subject_id,
 CASE k % 6 WHEN 0 THEN 'RUN_FAILED' WHEN 1 THEN 'WORKER_OFFLINE' WHEN 2 THEN 'QUEUE_BACKLOG' WHEN 3 THEN 'RUN_STUCK' WHEN 4 THEN 'WORKER_OFFLINE'
      ELSE 'QUEUE_AGE_HIGH' END AS alert_type,
 CASE k % 6 WHEN 0 THEN 'run-failed-default' WHEN 1 THEN 'worker-offline-default' WHEN 2 THEN 'queue-backlog-default' WHEN 3 THEN 'run-stuck-default'
      WHEN 4 THEN 'retired-rule' ELSE 'queue-age-high-default' END AS rule_id,
 1 + k % 2 AS rule_version, CASE WHEN k % 6 = 3 THEN concat('an', CAST(event_id - 1 AS STRING)) ELSE '' END AS source_annotation_id,
 ts AS opened_at, CASE WHEN user_id % 3 = 0 THEN NULL ELSE ts + INTERVAL '10' MINUTE END AS acknowledged_at,
 CASE WHEN user_id % 3 = 2 THEN ts + INTERVAL '30' MINUTE END AS resolved_at, concat('alert ', CAST(event_id AS STRING)) AS summary,
 concat('{{"k":', CAST(k AS STRING), '}}') AS evidence, ts AS created_at
FROM {_EV} AS x WHERE event_type = 'error'""",
    "annotations": f"""
SELECT event_id AS id, concat('an', CAST(event_id AS STRING)) AS annotation_id,
 CASE k % 5 WHEN 0 THEN 'RUN_STUCK' WHEN 1 THEN 'RUN_LOST' WHEN 2 THEN 'RUN_DUPLICATE_SUSPECTED' WHEN 3 THEN 'SCHEDULE_MISSED' ELSE 'NOT_A_RULE' END AS type,
 CASE WHEN k % 5 = 3 THEN 'SCHEDULE' ELSE 'TASK' END AS subject_type,
 CASE WHEN k % 5 = 3 THEN concat('s', CAST(user_id AS STRING)) ELSE concat('j', CAST(user_id * 31 + day(ts) AS STRING)) END AS subject_id,
 ts AS derived_at, CASE WHEN user_id % 2 = 0 THEN ts + INTERVAL '1' HOUR END AS resolved_at, concat('{{"k":', CAST(k AS STRING), '}}') AS evidence
FROM {_EV} AS x WHERE event_type = 'signup'""",
    "findings": f"""
SELECT event_id AS id, concat('j', CAST(user_id * 31 + day(ts) AS STRING)) AS job_id,
 CASE k % 4 WHEN 0 THEN 'Email' WHEN 1 THEN 'Phone' WHEN 2 THEN 'SSN' ELSE 'CreditCard' END AS type,
 CASE k % 4 WHEN 0 THEN 'builtin-email' WHEN 1 THEN 'builtin-phone' WHEN 2 THEN 'builtin-ssn' ELSE 'builtin-creditcard' END AS detector_id,
 CAST(1.0 AS DOUBLE) AS confidence,
 CASE k % 3 WHEN 0 THEN 'JOB_PAYLOAD' WHEN 1 THEN 'JOB_RESULT' ELSE 'STRUCTURED_LOG' END AS source, 1 + k % 3 AS index,
 CASE k % 5 WHEN 0 THEN 'OBSERVE' WHEN 1 THEN 'REDACT' WHEN 2 THEN 'BLOCK' ELSE 'MASK' END AS policy_action,
 CASE k % 4 WHEN 0 THEN 'mask-email' WHEN 3 THEN 'mask-creditcard' ELSE 'redact-phone-ssn' END AS rule_id, ts AS created_at
FROM {_EV} AS x WHERE event_type IN ('purchase', 'signup')""",
    "workers": f"""
SELECT s_suppkey AS id, concat('w', CAST(s_suppkey % 80 AS STRING)) AS worker_id, concat('i', CAST(s_suppkey AS STRING)) AS instance_id,
 CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Worker' WHEN 2 THEN 'Scheduler' ELSE 'Alert Evaluator' END AS component_type,
 concat('host-', CAST(s_suppkey % 10 AS STRING)) AS hostname, TIMESTAMP '2024-01-15 00:00:00' + INTERVAL '1' HOUR * (s_suppkey % 384) AS started_at,
 CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2024-01-30 23:40:00' END AS stopped_at,
 CASE WHEN s_suppkey % 9 = 0 THEN TIMESTAMP '2024-01-30 23:57:00' END AS draining_at,
 CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' WHEN s_suppkey % 7 = 1 THEN ' ' ELSE concat('r', CAST(s_suppkey % 3 AS STRING)) END AS build_revision,
 CAST(4 + s_suppkey % 3 AS INT) AS configured_capacity
FROM supplier""",
    "notifications": f"""
SELECT event_id AS id, concat('n', CAST(event_id AS STRING)) AS notification_id, concat('al', CAST(event_id AS STRING)) AS alert_id, 'webhook' AS channel,
 CASE k % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FAILED' ELSE 'SENT' END AS status, k % 5 AS attempt_count,
 CASE WHEN k % 4 = 0 THEN NULL ELSE ts + INTERVAL '1' DAY * (k % 2) END AS last_attempt_at
FROM {_EV} AS x WHERE event_type = 'error'""",
    "policy_activations": f"""
SELECT event_id AS id, 'default' AS policy_name, CAST(event_id % 9 AS INT) AS policy_version, concat('sum', CAST(event_id * 7919 AS STRING)) AS checksum,
 ts AS activated_at, CASE WHEN k % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS result
FROM {_EV} AS x WHERE event_type = 'click' AND k < 20""",
    # recurring schedules and their last known snapshot
    "schedule_definitions": f"""
SELECT c_custkey AS id, concat('s', CAST(c_custkey AS STRING)) AS schedule_id, concat('job-', CAST(c_custkey % 20 AS STRING)) AS task_name,
 c_mktsegment AS task_type, concat('{{"name":"', c_name, '"}}') AS payload,
 CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE CAST(60 * (1 + c_custkey % 5) AS INT) END AS interval_seconds,
 TIMESTAMP '{NOW}' + INTERVAL '1' SECOND * (90 - 41 * (c_custkey % 50)) AS next_run_at, c_acctbal > 0 AS enabled
FROM customer""",
    "schedule_snapshots": """
SELECT concat('s', CAST(c_custkey AS STRING)) AS schedule_id,
 $SHA256(concat('job-', CAST(c_custkey % 20 AS STRING), $NUL, c_mktsegment, $NUL, concat('{"name":"', c_name, '"}'), $NUL,
  CASE WHEN c_custkey % 6 = 0 THEN '1' WHEN c_custkey % 11 = 0 THEN '0' ELSE CAST(60 * (1 + c_custkey % 5) AS STRING) END, $NUL)) AS definition_hash,
 CASE WHEN c_custkey % 7 = 0 THEN NOT (c_acctbal > 0) ELSE c_acctbal > 0 END AS enabled
FROM customer WHERE c_custkey % 4 <> 0""",
    "occurrence_events": """
SELECT o_orderkey * 4 AS id, 'schedule.occurrence_due' AS event_type, o_orderdate AS occurred_at, '' AS job_id, 0 AS retry_index,
 concat('s', CAST(o_custkey AS STRING)) AS schedule_id, concat('s', CAST(o_custkey AS STRING), ':', CAST($UNIX(o_orderdate) AS STRING)) AS schedule_occurrence_id,
 'scheduler:p0' AS producer_id, o_orderkey * 4 AS producer_sequence FROM orders
UNION ALL
SELECT o_orderkey * 4 + 1, 'schedule.occurrence_skipped', o_orderdate + INTERVAL '40' SECOND, '', 0,
 concat('s', CAST(o_custkey AS STRING)), concat('s', CAST(o_custkey AS STRING), ':', CAST($UNIX(o_orderdate) AS STRING)),
 'scheduler:p0', o_orderkey * 4 + 1 FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL
SELECT o_orderkey * 4 + 2, 'schedule.occurrence_run_created', o_orderdate + INTERVAL '1' SECOND * (CAST(floor(o_totalprice) AS BIGINT) % 60 - 5),
 concat('j', CAST(o_orderkey AS STRING)), 0,
 concat('s', CAST(o_custkey AS STRING)), concat('s', CAST(o_custkey AS STRING), ':', CAST($UNIX(o_orderdate) AS STRING)),
 'scheduler:p1', o_orderkey * 4 + 2 FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL
SELECT o_orderkey * 4 + 3, 'attempt.started', o_orderdate + INTERVAL '1' SECOND * (CAST(floor(o_totalprice) AS BIGINT) % 90),
 concat('j', CAST(o_orderkey AS STRING)), CAST(o_orderkey % 4 AS INT),
 concat('s', CAST(o_custkey AS STRING)), CASE WHEN o_orderkey % 8 = 1 THEN '' ELSE concat('s', CAST(o_custkey AS STRING), ':', CAST($UNIX(o_orderdate) AS STRING)) END,
 'worker:p2', o_orderkey * 4 + 3 FROM orders WHERE o_orderpriority <> '1-URGENT'""",
    # messages as a delivery queue hands them over: text fields of any shape
    "delivery_rows": f"""
SELECT event_id AS id, CASE WHEN k % 10 = 0 THEN 'bad id!' WHEN k % 10 = 1 THEN NULL ELSE concat('j', CAST(user_id AS STRING)) END AS job_id,
 CASE WHEN k % 4 = 0 THEN 'has space' ELSE concat('c', CAST(user_id AS STRING)) END AS correlation_id,
 CASE WHEN k % 6 = 0 THEN '' ELSE concat('t', CAST(event_id AS STRING)) END AS trace_id,
 CASE WHEN k % 5 = 0 THEN 'yesterday' ELSE concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), 'Z') END AS created_at,
 CASE WHEN k % 7 = 0 THEN 'version-too-long' ELSE '1.0' END AS schema_version, event_type AS unknown_key
FROM {_EV} AS x""",
    "access_log": """
SELECT page_id AS id, concat('/', CASE page_id % 5 WHEN 0 THEN 'runs' WHEN 1 THEN 'queues' WHEN 2 THEN 'pii/findings' WHEN 3 THEN 'alerts' ELSE 'unlisted' END,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('/', CAST(page_id AS STRING)) END, CASE WHEN page_id % 2 = 0 THEN concat('?q=', url) ELSE '/' END) AS path,
 page_id % 10 <> 0 AS ok, length(html) AS duration_ms
FROM pages""",
    # health rows of one snapshot, one per component instance
    "component_rows": """
SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Worker' WHEN 1 THEN 'Scheduler' ELSE 'Reclaimer' END AS component_type,
 concat('n', CAST(s_suppkey % 25 AS STRING)) AS display_name, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * s_suppkey AS started_at,
 CASE s_suppkey % 5 WHEN 0 THEN 'HEALTHY' WHEN 1 THEN 'DEGRADED' WHEN 2 THEN 'UNHEALTHY' WHEN 3 THEN 'OFFLINE' ELSE 'odd' END AS health,
 s_suppkey % 6 = 0 AS stopped, concat('reason ', CAST(s_suppkey AS STRING)) AS reason
FROM supplier""",
}

def render(sql: str, dialect: str) -> str:
    """``sql`` with the dialect-dependent function names filled in."""
    if dialect == "spark":
        return _close_sha(sql.replace("$UNIX(", "unix_seconds(").replace("$NUL", "char(0)"))
    return re.sub(r"\$UNIX\((\w+)\)", r"CAST(epoch(\1) AS BIGINT)", sql).replace("$SHA256(", "sha256(").replace("$NUL", "chr(0)")


def _close_sha(sql: str) -> str:
    """Rewrite ``$SHA256(x)`` to ``sha2(x, 256)``, matching the closing parenthesis."""
    start = sql.find("$SHA256(")
    if start < 0:
        return sql
    depth = 0
    for pos in range(start + len("$SHA256"), len(sql)):
        depth += {"(": 1, ")": -1}.get(sql[pos], 0)
        if depth == 0:
            return sql[:start] + "sha2" + sql[start + len("$SHA256") : pos] + ", 256" + sql[pos:]
    raise ValueError("unbalanced parentheses")


_RAW = ("events", "orders", "lineitem", "customer", "supplier", "pages")


def raw_inputs(view: str) -> list[str]:
    """Raw tables a view reads."""
    return [t for t in _RAW if re.search(rf"\bFROM {t}\b", VIEWS[view])]
