"""Streaming queries, run to completion over the sample files and compared with the batch results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.catalog.alerts import FROM_ANNOTATIONS, FROM_METRICS, RESOLVED_SQL, SEVERITY_SQL, rules_values, samples_sql
from opswatch.catalog.feed import CATEGORY
from opswatch.catalog.health import LOST_SQL, NEW_SQL, STUCK_SQL, WORKER_STATES_SQL
from opswatch.catalog.pii import NUMBERED, POLICY, sanitized_sql
from opswatch.catalog.registry import ORACLES, stream_query
from opswatch.catalog.sequences import DAY
from opswatch.functions import feed
from opswatch.functions.verdicts import queue_verdict
from opswatch.plans import alerting
from opswatch.sources.sinks import overlaid, read_keyed
from opswatch.sources.tables import RECORDED_AT, Tables, as_of
from opswatch.sources.views import NOW
from opswatch.streaming import feeds, keyed, projections, sweeps
from opswatch.streaming.sources import drain, file_stream, fresh_folder

# every sample is a single file, so nothing is late; the watermark only closes windows
NEVER_LATE = "100 days"


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(drain(stream, name, mode))


@stream_query("run_projection_stream", same_as="run_projection")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    table = fresh_folder(spark, "run-projections")
    drain(projections.run_projection_stream(live.event_log), "run-projection", "update", projections.save_changes(table))
    return projections.read_run_projections(spark, table, stored.tasks)


def _drained_ledger(spark: SparkSession, live: Tables) -> tuple[str, str]:
    ledger, summary = fresh_folder(spark, "ledger"), fresh_folder(spark, "summary")
    drain(projections.occurrence_stream(live.occurrence_events), "occurrences", "update", projections.save_ledger(ledger, summary))
    return ledger, summary


@stream_query("occurrence_ledger_stream", same_as="occurrence_ledger")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    return read_keyed(spark, _drained_ledger(spark, live)[0], ["schedule_id", "occurrence_id"])


@stream_query("schedule_summary_stream", same_as="schedule_summary")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    return read_keyed(spark, _drained_ledger(spark, live)[1], ["schedule_id"])


@stream_query("rate_limited_stream", same_as="rate_limited")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    kept = keyed.rate_limited_stream(live.activity_log.select("id", "event_type", "producer", "occurred_at"), DAY, NEVER_LATE)
    return collected(kept, "rate-limited")


@stream_query("coalesced_stream", same_as="coalesced")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    events = live.activity_log.select("id", "event_type", "job_id", "occurred_at")
    critical = feed.is_critical(F.col("event_type"))
    return collected(keyed.coalesced_stream(events, critical, 6 * 3600, NEVER_LATE), "coalesced")


@stream_query("burst_signals_stream", same_as="burst_signals")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    return collected(keyed.burst_stream(live.activity_log, 3600, NEVER_LATE), "bursts")


@stream_query("transitions_stream", same_as="transitions")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    judged = live.queue_samples.select("id", "queue_name", "sampled_at", queue_verdict(F.col("pending_count")).alias("health"))
    changed = keyed.changes_stream(judged, ["queue_name"], "sampled_at", "id", "health")
    return collected(changed, "transitions").withColumn("event_type", F.concat(F.lit("queue."), F.lower("health")))


@stream_query("zero_crossings_stream", "SELECT id, queue_name, sampled_at, consumer_count, change FROM (" + ORACLES["zero_crossings"] + ") AS z")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    samples = live.queue_samples.select("id", "queue_name", "sampled_at", "consumer_count")
    return collected(keyed.zero_crossing_stream(samples, ["queue_name"], "sampled_at", "id", "consumer_count"), "zero-crossings")


@stream_query("feed_stream", "SELECT id, event_id, event_type, job_id FROM activity_log WHERE regexp_matches(event_type, '^(task|run|attempt|worker)[.]') AND event_type NOT IN ('task.progress', 'attempt.heartbeat')")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    shown = feeds.feed_stream(live.activity_log, ["runs", "workers"], [], NEVER_LATE)
    return collected(shown.select("id", "event_id", "event_type", "job_id"), "feed")


@stream_query(
    "throughput_stream",
    """SELECT e AS window_end, count(*) / 360.0::DOUBLE AS per_minute FROM (
 SELECT TIMESTAMP '1970-01-01' + INTERVAL '1' HOUR * (epoch_us(occurred_at) // 3600000000 + k) AS e FROM event_log, range(1, 7) AS r(k) WHERE event_type IN ('task.completed', 'task.failed')) AS x GROUP BY e""",
)
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    table = fresh_folder(spark, "throughput")
    windows = feeds.throughput_stream(live.event_log, "6 hours", "1 hour", NEVER_LATE)
    drain(windows, "throughput", "update", projections.save_changes(table))
    return read_keyed(spark, table, ["window_end"])


@stream_query("activity_stream", f"SELECT TIMESTAMP '1970-01-01' + INTERVAL '1' HOUR * (epoch_us(occurred_at) // 3600000000) AS bucket_start, {CATEGORY} AS category, count(*) AS n FROM activity_log GROUP BY 1, 2")
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    table = fresh_folder(spark, "activity")
    drain(feeds.activity_stream(live.activity_log, "1 hour", NEVER_LATE), "activity", "update", projections.save_changes(table))
    return read_keyed(spark, table, ["bucket_start", "category"])


@stream_query(
    "artifact_scan_stream",
    f"SELECT key AS page_id, CASE WHEN n > 0 THEN 'DETECTED' ELSE 'CLEAN' END AS scan_status, n AS finding_count FROM ({sanitized_sql('pages', 'page_id', 'html', NUMBERED)}) AS s",
)
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    pages = live.pages.select("page_id", F.col("html").alias("body"))
    scanned = feeds.artifact_stream(pages, POLICY, "ERROR_MESSAGE")
    return collected(scanned.select("page_id", "scan_status", "finding_count"), "artifacts")


# --- sweeps: three micro batches with a moving clock ---

CLOCKS = ("2024-01-30 22:00:00", "2024-01-30 23:00:00", NOW)
#: from the third batch on these rules have another severity
CHANGED = {"queue-backlog-default": "CRITICAL", "run-lost-default": "WARNING"}
CHANGED_RULES = [{**r, "severity": CHANGED.get(r["id"], r["severity"])} for r in alerting.DEFAULT_RULES]
CHANNELS = [("webhook", "https://example.invalid/hook"), ("pager", "on-call")]


def ticks(spark: SparkSession, stored: Tables) -> DataFrame:
    """A stream of three files: the heartbeats up to each clock and the time at which they are looked at."""
    folder = fresh_folder(spark, "ticks")
    for k, at in enumerate(CLOCKS):
        since = f"occurred_at > '{CLOCKS[k - 1]}'" if k else "true"
        beats = stored.heartbeats.filter(f"occurred_at <= '{at}' AND {since}").select("id")
        tick = beats.unionByName(spark.range(1)).withColumn("sweep_at", F.lit(at)).repartition(1)
        tick.write.mode("append").parquet(folder)
    return file_stream(spark, folder, tick.schema, files_per_trigger=1)


def clock(batch: DataFrame) -> str:
    return batch.agg(F.max("sweep_at")).first()[0]


def _at_sweep(sql: str, k: int) -> str:
    """``sql`` on the alerts, annotations, samples and rules that sweep ``k`` sees."""
    for name in ("alerts", "annotations", "samples", "rules"):
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}_{k}", sql)
    return sql.replace(f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{CLOCKS[k]}'")


def _sweep_views() -> dict[str, str]:
    columns = "alert_id, alert_type, severity, status, subject_type, subject_id, rule_id, source_annotation_id"
    views = {"alerts_0": f"SELECT {columns}, opened_at, resolved_at FROM alerts"}
    for k, at in enumerate(CLOCKS):
        views[f"annotations_{k}"] = f"SELECT annotation_id, type, subject_type, subject_id, CASE WHEN resolved_at <= TIMESTAMP '{at}' THEN resolved_at END AS resolved_at FROM annotations WHERE derived_at <= TIMESTAMP '{at}'"
        views[f"samples_{k}"] = samples_sql(at)
        views[f"rules_{k}"] = rules_values(alerting.DEFAULT_RULES if k < 2 else CHANGED_RULES)
        views[f"opened_{k}"] = _at_sweep(f"SELECT * FROM ({FROM_ANNOTATIONS} UNION ALL {FROM_METRICS}) AS o", k)
        views[f"resolved_{k}"] = _at_sweep(f"SELECT DISTINCT alert_id FROM ({RESOLVED_SQL}) AS o", k)
        views[f"ranked_{k}"] = _at_sweep(SEVERITY_SQL, k)
        views[f"alerts_{k + 1}"] = f"""SELECT {columns}, TIMESTAMP '{at}' AS opened_at, CAST(NULL AS TIMESTAMP) AS resolved_at FROM opened_{k}
 UNION ALL SELECT a.alert_id, a.alert_type, CASE WHEN r.alert_id IS NULL THEN coalesce(s.new_severity, a.severity) ELSE a.severity END,
 CASE WHEN r.alert_id IS NULL THEN a.status ELSE 'RESOLVED' END, a.subject_type, a.subject_id, a.rule_id, a.source_annotation_id, a.opened_at,
 CASE WHEN r.alert_id IS NULL THEN a.resolved_at ELSE TIMESTAMP '{at}' END
 FROM alerts_{k} AS a LEFT JOIN resolved_{k} AS r ON r.alert_id = a.alert_id LEFT JOIN ranked_{k} AS s ON s.alert_id = a.alert_id"""
    return views


SWEEPS = _sweep_views()
BY_BATCH = " UNION ALL ".join(f"SELECT {k} AS batch, 'opened' AS change, alert_id FROM opened_{k} UNION ALL SELECT {k}, 'resolved', alert_id FROM resolved_{k} UNION ALL SELECT {k}, new_severity, alert_id FROM ranked_{k}" for k in range(3))


def swept_alerts(spark: SparkSession, stored: Tables) -> str:
    target = fresh_folder(spark, "alerts")
    rules = {at: alerting.rules_frame(spark, None if k < 2 else CHANGED_RULES) for k, at in enumerate(CLOCKS)}
    drain(ticks(spark, stored), "alert-sweep", "append", sweeps.alert_sweep(lambda now: as_of(stored, now), rules.get, clock, target, channels=CHANNELS))
    return target


@stream_query("alert_sweep_stream", "SELECT * FROM alerts_3", views=SWEEPS)
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    """Every alert after three sweeps, each on what the one before left."""
    swept = read_keyed(spark, f"{swept_alerts(spark, stored)}/alerts", ["alert_id"])
    base = stored.alerts.select("alert_id", "alert_type", "severity", "status", "subject_type", "subject_id", "rule_id", "source_annotation_id", "opened_at", "resolved_at")
    return overlaid(base, swept.select(*base.columns), ["alert_id"])


@stream_query("alert_sweep_changes", BY_BATCH, views=SWEEPS)
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    """What each of three sweeps opened, resolved and re-ranked."""
    target = swept_alerts(spark, stored)

    def part(name: str, change) -> DataFrame:
        return spark.read.parquet(f"{target}/{name}").select(F.col("version").alias("batch"), change.alias("change"), "alert_id")

    return part("opened", F.lit("opened")).unionByName(part("resolved", F.lit("resolved"))).unionByName(part("severity_changed", F.col("new_severity")))


@stream_query(
    "alert_sweep_notifications",
    "SELECT alert_id, rule_id, channel, target, 'PENDING' AS status, 0 AS attempt_count FROM (" + " UNION ALL ".join(f"SELECT alert_id, rule_id, severity FROM opened_{k}" for k in range(3))
    + ") AS o, (VALUES ('webhook', 'https://example.invalid/hook'), ('pager', 'on-call')) AS c(channel, target) WHERE severity IN ('WARNING', 'CRITICAL')",
    views=SWEEPS,
)
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    """One notification for each loud alert and channel, however many sweeps see the alert."""
    queued = read_keyed(spark, f"{swept_alerts(spark, stored)}/notifications", ["notification_id"])
    return queued.select("alert_id", "rule_id", "channel", "target", "status", "attempt_count")


# --- monitoring sweeps ---

STATE_SQL = """SELECT 'worker' AS kind, worker_id AS subject_id, status AS state FROM ({workers}) AS w
UNION ALL SELECT 'monitoring', 'platform', lower(status) FROM (SELECT * FROM monitoring_healths WHERE sampled_at <= TIMESTAMP '{now}' ORDER BY sampled_at DESC, id DESC LIMIT 1) AS m"""


def _monitoring_views() -> dict[str, str]:
    views = {}
    for k, at in enumerate(CLOCKS):
        workers = WORKER_STATES_SQL.replace("$NOW", f"TIMESTAMP '{at}'").replace("FROM heartbeats", f"FROM (SELECT * FROM heartbeats WHERE occurred_at <= TIMESTAMP '{at}') AS b")
        views[f"states_{k}"] = STATE_SQL.format(workers=workers, now=at)
    return views


TRANSITIONS = " UNION ALL ".join(
    f"SELECT {k} AS batch, n.kind, n.subject_id, p.state AS previous, n.state, concat(n.kind, '.', n.state) AS event_type FROM states_{k} AS n JOIN states_{k - 1} AS p ON p.kind = n.kind AND p.subject_id = n.subject_id WHERE p.state <> n.state"
    for k in (1, 2)
)


def swept_monitoring(spark: SparkSession, stored: Tables) -> str:
    target = fresh_folder(spark, "monitoring")
    fixed = "attempts" not in RECORDED_AT  # then ``as_of`` gives all stored attempts at every time
    sweep = sweeps.monitoring_sweep(lambda now: as_of(stored, now), clock, target, same_attempts=fixed, stuck_window=DAY, lost_window=4 * 3600)
    drain(ticks(spark, stored), "monitoring-sweep", "append", sweep)
    return target


@stream_query("monitoring_sweep_transitions", TRANSITIONS, views=_monitoring_views())
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    """State changes that each of three sweeps reports against what the one before saw."""
    moved = spark.read.parquet(f"{swept_monitoring(spark, stored)}/transitions").filter("kind <> 'component'")
    return moved.select(F.col("version").alias("batch"), "kind", "subject_id", "previous", "state", "event_type")


def _monitored_views() -> dict[str, str]:
    """What sweep ``k`` sees, finds, opens and closes, and what it leaves."""
    columns = "annotation_id, type, subject_type, subject_id, derived_at, resolved_at"
    views = {"held_0": f"SELECT {columns} FROM annotations WHERE false"}
    for k, at in enumerate(CLOCKS):
        now = f"TIMESTAMP '{at}'"

        def then(sql: str) -> str:
            for name in ("event_log", "heartbeats"):
                sql = re.sub(rf"\bFROM {name}\b(?! WHERE event)", f"FROM (SELECT * FROM {name} WHERE occurred_at <= {now}) AS b", sql)
                sql = re.sub(rf"\bFROM {name} WHERE", f"FROM {name} WHERE occurred_at <= {now} AND", sql)
            return sql.replace("$NOW", now)

        views[f"seen_{k}"] = f"""SELECT {columns} FROM held_{k} UNION ALL SELECT annotation_id, type, subject_type, subject_id, derived_at, CASE WHEN resolved_at <= {now} THEN resolved_at END
 FROM annotations WHERE derived_at <= {now} AND annotation_id NOT IN (SELECT annotation_id FROM held_{k})"""
        views[f"stuck_{k}"], views[f"lost_{k}"] = then(STUCK_SQL), then(LOST_SQL)
        found = NEW_SQL.replace("FROM stuck", f"FROM stuck_{k}").replace("FROM lost", f"FROM lost_{k}").replace("FROM annotations", f"FROM seen_{k}").replace("$NOW", now)
        name = f"concat('an-', substr(sha256(concat_ws('|', type, subject_type, subject_id, CAST(epoch_us({now}) AS VARCHAR))), 1, 26))"
        progress = then("SELECT job_id, max(occurred_at) AS last_event_at FROM event_log WHERE event_type <> 'attempt.heartbeat' GROUP BY job_id")
        views[f"new_{k}"] = f"SELECT {name} AS annotation_id, type, subject_type, subject_id, {now} AS derived_at, CAST(NULL AS TIMESTAMP) AS resolved_at FROM ({found}) AS f"
        views[f"closed_{k}"] = f"""SELECT n.annotation_id FROM seen_{k} AS n LEFT JOIN tasks AS t ON t.job_id = n.subject_id LEFT JOIN ({progress}) AS e ON e.job_id = n.subject_id
 LEFT JOIN schedule_definitions AS s ON s.schedule_id = n.subject_id WHERE n.resolved_at IS NULL AND CASE
 WHEN n.type IN ('RUN_STUCK', 'RUN_LOST') THEN e.job_id IS NOT NULL AND (t.status IN ('Completed', 'Failed') OR t.job_id IS NOT NULL AND epoch_us({now}) - epoch_us(e.last_event_at) < 60000000)
 WHEN n.type = 'RUN_DUPLICATE_SUSPECTED' THEN n.subject_id NOT IN (SELECT job_id FROM attempts WHERE status IN ('Claimed', 'Started') GROUP BY job_id HAVING count(*) > 1)
 WHEN n.type = 'SCHEDULE_MISSED' THEN epoch_us({now}) - epoch_us(s.next_run_at) < 300000000 ELSE false END"""
        views[f"held_{k + 1}"] = f"""SELECT {columns} FROM new_{k} UNION ALL SELECT {columns} FROM held_{k} WHERE annotation_id NOT IN (SELECT annotation_id FROM closed_{k})
 UNION ALL SELECT annotation_id, type, subject_type, subject_id, derived_at, {now} FROM seen_{k} WHERE annotation_id IN (SELECT annotation_id FROM closed_{k})"""
    return views


@stream_query("monitoring_sweep_stream", "SELECT annotation_id, type, subject_type, subject_id, derived_at, resolved_at FROM held_3", views=_monitored_views())
def _(spark: SparkSession, live: Tables, stored: Tables) -> DataFrame:
    """Annotations that three sweeps open, and when they close them."""
    kept = read_keyed(spark, f"{swept_monitoring(spark, stored)}/annotations", ["annotation_id"])
    return kept.select("annotation_id", "type", "subject_type", "subject_id", "derived_at", "resolved_at")
