"""Live feed: scopes, visibility, classification, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.catalog.registry import query
from opswatch.functions import feed
from opswatch.operators import filters, folds, paging
from opswatch.sources.tables import Tables

RUN_FAMILY = "regexp_matches(event_type, '^(task|run|attempt)[.]')"


@query(
    "events_by_scope",
    f"""SELECT id, event_type, job_id FROM activity_log WHERE ({RUN_FAMILY} AND job_id = 'j1000') OR execution_chain_id = 'c1200' OR event_type LIKE 'queue.%' OR (event_type LIKE 'worker.%' AND job_id = 'w7')""",
)
def _(t: Tables) -> DataFrame:
    scopes = feed.parse_scopes(["run:j1000", "execution-chain:c1200", "queues", "worker:w7", "queues"])
    keep = feed.in_scopes(scopes, F.col("event_type"), F.col("job_id"), F.col("execution_chain_id"))
    return t.activity_log.filter(keep).select("id", "event_type", "job_id")


@query("visible_events", "SELECT id, event_type FROM activity_log WHERE NOT (event_type LIKE 'alert.%' OR (event_type LIKE 'pii.%' AND event_type NOT LIKE 'pii.policy%'))")
def _(t: Tables) -> DataFrame:
    return t.activity_log.filter(feed.visible_to(F.col("event_type"), ["pii.policy.read"])).select("id", "event_type")


def replayed(t: Tables) -> DataFrame:
    """Events after a cursor, in order."""
    kind = F.col("event_type")
    shown = t.activity_log.filter((F.col("id") > 4000) & ~feed.is_noise(kind) & feed.visible_to(kind, []))
    return shown.orderBy("id").select("id", "event_type", "job_id")


@query(
    "feed_replay",
    "SELECT id, event_type, job_id FROM activity_log WHERE id > 4000 AND event_type NOT IN ('task.progress', 'attempt.heartbeat') AND event_type NOT LIKE 'alert.%' AND event_type NOT LIKE 'pii.%' ORDER BY id LIMIT 501",
)
def _(t: Tables) -> DataFrame:
    """Replay after a cursor: one row more than the cap tells the reader to resynchronise."""
    return replayed(t).limit(paging.REPLAY_CAP + 1)


@query(
    "feed_replay_all",
    "SELECT id, event_type, job_id FROM activity_log WHERE id > 4000 AND event_type NOT IN ('task.progress', 'attempt.heartbeat') AND event_type NOT LIKE 'alert.%' AND event_type NOT LIKE 'pii.%'",
)
def _(t: Tables) -> DataFrame:
    return replayed(t)


@query("timeline_events", "SELECT id, event_type FROM activity_log WHERE NOT contains(event_type, 'progress') AND NOT contains(event_type, 'heartbeat')")
def _(t: Tables) -> DataFrame:
    return t.activity_log.filter(~feed.is_timeline_noise(F.col("event_type"))).select("id", "event_type")


@query("events_by_prefix", "SELECT id, event_type FROM activity_log WHERE event_type LIKE 'pii.%' OR event_type LIKE 'queue.%'")
def _(t: Tables) -> DataFrame:
    return filters.with_event_prefix(t.activity_log, ["pii.", "queue."]).select("id", "event_type")


@query(
    "run_scoped_events",
    """SELECT id, job_id <> 'system' AND (event_type = 'schedule.occurrence_run_created' OR NOT regexp_matches(event_type, '^(queue|worker|component|monitoring|redis|alert|retention|schedule)[.]')) AS run_scoped
FROM activity_log""",
)
def _(t: Tables) -> DataFrame:
    return t.activity_log.select("id", feed.is_run_scoped(F.col("job_id"), F.col("event_type")).alias("run_scoped"))


CATEGORY = """CASE split_part(event_type, '.', 1) WHEN 'task' THEN 'task' WHEN 'run' THEN 'task' WHEN 'attempt' THEN 'attempt' WHEN 'schedule' THEN 'schedule' WHEN 'alert' THEN 'alert' WHEN 'pii' THEN 'pii'
 WHEN 'queue' THEN 'system' WHEN 'worker' THEN 'system' WHEN 'component' THEN 'system' WHEN 'monitoring' THEN 'system' WHEN 'redis' THEN 'system' WHEN 'delivery' THEN 'system' WHEN 'retention' THEN 'system' ELSE 'other' END"""


@query(
    "feed_envelopes",
    f"""SELECT id, {CATEGORY} AS category,
 CASE split_part(event_type, '.', 1) WHEN 'task' THEN 'RUN' WHEN 'run' THEN 'RUN' WHEN 'attempt' THEN 'ATTEMPT' WHEN 'queue' THEN 'QUEUE' WHEN 'worker' THEN 'WORKER' WHEN 'schedule' THEN 'SCHEDULE' WHEN 'alert' THEN 'ALERT'
  WHEN 'pii' THEN CASE event_type WHEN 'pii.policy_activated' THEN 'PII_POLICY_ACTIVATED' WHEN 'pii.policy_drift_detected' THEN 'PII_POLICY_DRIFT_DETECTED' ELSE 'PII_FINDING_SUMMARY' END
  WHEN 'monitoring' THEN 'MONITORING_HEALTH' WHEN 'component' THEN 'COMPONENT' ELSE 'UNKNOWN' END AS resource_type,
 CASE WHEN event_type IN ('queue.degraded', 'queue.no_consumer', 'worker.online', 'worker.offline', 'monitoring.degraded', 'component.offline') THEN 'HEALTH_CHANGED' ELSE 'INVALIDATE' END AS change_type,
 CASE WHEN event_type = 'alert.opened' AND severity = 'WARNING' THEN 'NORMAL'
  WHEN event_type IN ('task.failed', 'run.lost', 'worker.offline', 'queue.no_consumer', 'alert.opened', 'schedule.missed', 'monitoring.degraded', 'component.offline') THEN 'CRITICAL'
  WHEN event_type IN ('task.progress', 'attempt.heartbeat', 'queue.read.batch', 'worker.heartbeat_age.sample') THEN 'INFORMATIONAL' ELSE 'NORMAL' END AS priority,
 greatest((epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(occurred_at)) // 1000, 0) AS projection_lag_ms,
 CASE WHEN id % 3 = 0 THEN 'REPLAYED' WHEN (epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(occurred_at)) // 1000 >= 5000 THEN 'LAGGING' ELSE 'FRESH' END AS freshness
FROM activity_log""",
)
def _(t: Tables) -> DataFrame:
    kind, now = F.col("event_type"), "2024-01-15 00:00:00"
    return t.activity_log.select(
        "id",
        feed.category(kind).alias("category"),
        feed.resource_type(kind).alias("resource_type"),
        feed.change_type(kind).alias("change_type"),
        feed.priority(kind, F.col("severity")).alias("priority"),
        feed.projection_lag_ms(F.col("occurred_at"), now).alias("projection_lag_ms"),
        feed.freshness(F.col("occurred_at"), now, F.col("id") % 3 == 0).alias("freshness"),
    )


@query("events_searched", f"SELECT id, event_type, job_id FROM activity_log WHERE {CATEGORY} IN ('task', 'system') AND contains(lower(job_id), 'j10')")
def _(t: Tables) -> DataFrame:
    return filters.search_events(t.activity_log, " J10 ", ["task", "system"]).select("id", "event_type", "job_id")


@query("ordered_events", "SELECT id, event_type, occurred_at, producer_id, producer_sequence FROM event_log")
def _(t: Tables) -> DataFrame:
    return folds.order_events(t.event_log).select("id", "event_type", "occurred_at", "producer_id", "producer_sequence")


PAGE = """SELECT id, job_id, created_at, to_base64(encode(concat(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), 'Z|', id))) AS cursor FROM tasks
WHERE created_at < TIMESTAMP '1997-03-01' OR (created_at = TIMESTAMP '1997-03-01' AND id < 7000) ORDER BY created_at DESC, id DESC LIMIT 200"""


@query("keyset_page", PAGE)
def _(t: Tables) -> DataFrame:
    page = paging.keyset_page(t.tasks, "created_at", "id", 500, ("1997-03-01 00:00:00", 7000))
    return page.select("id", "job_id", "created_at", "cursor")


@query("offset_page", "SELECT id, job_id, created_at FROM tasks ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 1000")
def _(t: Tables) -> DataFrame:
    return paging.offset_page(t.tasks, "created_at", "id", None, 1000).select("id", "job_id", "created_at")


@query("run_total", "SELECT count(*) AS total FROM tasks WHERE status = 'Failed'")
def _(t: Tables) -> DataFrame:
    return paging.total_rows(filters.filter_runs(t.tasks, execution_state="Failed"))


@query("sorted_runs", "SELECT job_id, finished_at FROM tasks ORDER BY finished_at DESC NULLS LAST, job_id")
def _(t: Tables) -> DataFrame:
    return paging.sort_rows(t.tasks, "-finished_at", ["finished_at"], "job_id").select("job_id", "finished_at")


