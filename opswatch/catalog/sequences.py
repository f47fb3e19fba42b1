"""Rules over ordered sequences: transitions, zero crossings, rate limits, stale updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.catalog.registry import query
from opswatch.functions import feed
from opswatch.functions.verdicts import queue_verdict
from opswatch.operators import sequences
from opswatch.sources.tables import Tables


@query(
    "transitions",
    """SELECT id, queue_name, sampled_at, health, previous, concat('queue.', lower(health)) AS event_type FROM (
 SELECT *, lag(health) OVER (PARTITION BY queue_name ORDER BY sampled_at, id) AS previous FROM (SELECT *, CASE WHEN pending_count > 20 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM queue_samples) AS x) AS y
WHERE previous <> health""",
)
def _(t: Tables) -> DataFrame:
    judged = t.queue_samples.withColumn("health", queue_verdict(F.col("pending_count")))
    changed = sequences.transitions(judged, ["queue_name"], "sampled_at", "id", "health")
    return changed.select("id", "queue_name", "sampled_at", "health", "previous", F.concat(F.lit("queue."), F.lower("health")).alias("event_type"))


@query(
    "monitoring_transitions",
    """SELECT id, status, previous, sampled_at FROM (SELECT *, lag(status) OVER (ORDER BY sampled_at, id) AS previous FROM monitoring_healths) AS x WHERE previous <> status""",
)
def _(t: Tables) -> DataFrame:
    named = t.monitoring_healths.withColumn("subject", F.lit("monitoring"))
    return sequences.transitions(named, ["subject"], "sampled_at", "id", "status").select("id", "status", "previous", "sampled_at")


@query(
    "worker_load_transitions",
    """SELECT id, worker_id, occurred_at, state, previous FROM (SELECT *, lag(state) OVER (PARTITION BY worker_id ORDER BY occurred_at, id) AS previous FROM (
 SELECT *, CASE WHEN running_attempts >= 3 THEN 'full' ELSE 'free' END AS state FROM heartbeats) AS x) AS y WHERE previous <> state""",
)
def _(t: Tables) -> DataFrame:
    full = F.when(F.col("running_attempts") >= 3, F.lit("full")).otherwise(F.lit("free"))
    return sequences.transitions(t.heartbeats.withColumn("state", full), ["worker_id"], "occurred_at", "id", "state").select(
        "id", "worker_id", "occurred_at", "state", "previous"
    )


@query(
    "zero_crossings",
    """SELECT id, queue_name, sampled_at, consumer_count, previous, CASE WHEN consumer_count = 0 THEN 'lost' ELSE 'restored' END AS change FROM (
 SELECT *, lag(consumer_count) OVER (PARTITION BY queue_name ORDER BY sampled_at, id) AS previous FROM queue_samples) AS x
WHERE (previous > 0 AND consumer_count = 0) OR (previous = 0 AND consumer_count > 0)""",
)
def _(t: Tables) -> DataFrame:
    return sequences.zero_crossings(t.queue_samples, ["queue_name"], "sampled_at", "id", "consumer_count").select(
        "id", "queue_name", "sampled_at", "consumer_count", "previous", "change"
    )


KEPT = """
WITH RECURSIVE numbered AS (SELECT {cols}, epoch_us(occurred_at) AS us, row_number() OVER (PARTITION BY {keys} ORDER BY occurred_at, id) AS rn FROM {source}),
walk AS (SELECT {names}, rn, us, us AS last, true AS kept FROM numbered WHERE rn = 1
 UNION ALL SELECT {qualified}, n.rn, n.us, CASE WHEN n.us - w.last >= {window} THEN n.us ELSE w.last END, n.us - w.last >= {window}
 FROM walk AS w JOIN numbered AS n ON {on} AND n.rn = w.rn + 1)
"""


def kept_sql(source: str, keys: list[str], window_us: int, select: str) -> str:
    """Sequential keep rule as a recursive walk along each key."""
    names = ", ".join(["id", "event_type", "occurred_at", *[k for k in keys if k != "event_type"]])
    return (
        KEPT.format(
            cols=names, keys=", ".join(keys), source=source, names=names, qualified=", ".join(f"n.{c}" for c in names.split(", ")),
            window=window_us, on=" AND ".join(f"n.{k} = w.{k}" for k in keys),
        )
        + select
    )


DAY = 86400


@query("rate_limited", kept_sql("activity_log", ["event_type", "producer"], DAY * 1_000_000, "SELECT id, event_type, producer, occurred_at FROM walk WHERE kept"))
def _(t: Tables) -> DataFrame:
    return sequences.rate_limited(t.activity_log, DAY).select("id", "event_type", "producer", "occurred_at")


CRITICAL = "event_type IN ('task.failed', 'run.lost', 'worker.offline', 'queue.no_consumer', 'alert.opened', 'schedule.missed', 'monitoring.degraded', 'component.offline')"


@query(
    "coalesced",
    kept_sql(
        f"(SELECT * FROM activity_log WHERE NOT {CRITICAL}) AS a", ["event_type", "job_id"], 6 * 3600 * 1_000_000,
        f"SELECT id, event_type, job_id, occurred_at FROM walk WHERE kept UNION ALL SELECT id, event_type, job_id, occurred_at FROM activity_log WHERE {CRITICAL}",
    ),
)
def _(t: Tables) -> DataFrame:
    critical = feed.is_critical(F.col("event_type"))
    return sequences.coalesced(t.activity_log, critical, 6 * 3600).select("id", "event_type", "job_id", "occurred_at")


@query(
    "burst_signals",
    """WITH RECURSIVE numbered AS (SELECT id, occurred_at, epoch_us(occurred_at) AS us, row_number() OVER (ORDER BY occurred_at, id) AS rn FROM activity_log),
walk AS (SELECT id, occurred_at, rn, us AS last, true AS kept FROM numbered WHERE rn = 1
 UNION ALL SELECT n.id, n.occurred_at, n.rn, CASE WHEN n.us - w.last >= 3600000000 THEN n.us ELSE w.last END, n.us - w.last >= 3600000000 FROM walk AS w JOIN numbered AS n ON n.rn = w.rn + 1)
SELECT id AS first_event_id, occurred_at AS first_event_at, occurred_at + INTERVAL '1' HOUR AS signal_at FROM walk WHERE kept""",
)
def _(t: Tables) -> DataFrame:
    return sequences.burst_signals(t.activity_log, 3600)


@query(
    "stale_guard",
    """SELECT id, resource, seq FROM (SELECT *, max(CASE WHEN seq > 0 THEN seq END) OVER (PARTITION BY resource ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM (SELECT id, concat('QUEUE:', queue_name) AS resource, CASE WHEN pending_count = 50 THEN 0 ELSE id - 40 * (pending_count % 5) END AS seq FROM queue_samples) AS x) AS y
WHERE seq <= 0 OR before IS NULL OR seq > before""",
)
def _(t: Tables) -> DataFrame:
    """Updates that arrive out of order: the sequence of a row may lag its arrival."""
    seq = F.when(F.col("pending_count") == 50, F.lit(0)).otherwise(F.col("id") - 40 * (F.col("pending_count") % 5))
    updates = t.queue_samples.select("id", F.concat(F.lit("QUEUE:"), "queue_name").alias("resource"), seq.alias("seq"))
    return sequences.newer_than_all_before(updates, ["resource"], "id", "seq", F.col("seq") <= 0, 512).select("id", "resource", "seq")
