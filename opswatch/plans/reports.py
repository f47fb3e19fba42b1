"""Aggregated reports: system metrics, overview, cards, histograms, pages of workers, queues and schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions import verdicts as v
from opswatch.functions.feed import CATEGORIES, category
from opswatch.functions.status import alert_type_label
from opswatch.functions.timing import MICROS, age_seconds, instant, seconds_between, shift, whole
from opswatch.operators.filters import within_range
from opswatch.operators.folds import CREATED, DUE, SKIPPED
from opswatch.operators.latest import (
    latest_per_key,
    newest_heartbeats,
    newest_queue_samples,
    newest_workers,
)
from opswatch.operators.paging import page
from opswatch.sources.tables import Tables

LATE_START_SECONDS = 30
# The order in which components are shown.
COMPONENT_ORDER = (
    "API", "Query API", "Scheduler", "Redis Delivery", "Workers", "Monitoring Ingestor", "Monitoring Projector",
    "PII Scanner", "Alert Evaluator", "Real-Time Gateway",
)
# A combined row is dropped once every row that replaces it is present.
SUPERSEDED_BY = {"Monitoring Ingestor / Projector": ("Monitoring Ingestor", "Monitoring Projector")}
# Path segments that are route words; anything else is an identifier.
ROUTE_WORDS = (
    "alerts", "acknowledge", "runs", "execution-chains", "timeline", "queues", "workers", "schedules", "pii",
    "findings", "monitoring", "health", "overview", "live", "activity",
)


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One row from frames that each hold exactly one row (aggregates without keys), without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def count_where(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


# --- system ---


def system_metrics(tables: Tables, now, online_window: float = 60) -> DataFrame:
    runs = tables.tasks.agg(
        F.count(F.lit(1)).alias("runs_created_total"),
        count_where(F.col("status") == "Completed", "runs_completed_total"),
        count_where(F.col("status") == "Failed", "runs_failed_total"),
    )
    depth = tables.queue_samples.agg(F.max_by("pending_count", F.struct("sampled_at", "id")).alias("queue_depth"))
    online = tables.heartbeats.filter(F.col("occurred_at") > shift(now, -online_window)).agg(
        F.countDistinct("worker_id").alias("worker_online")
    )
    return side_by_side(runs, depth, online)


def overview(tables: Tables) -> DataFrame:
    """Headline counts; a queue is degraded by its newest sample, a worker offline when it never sent a heartbeat."""
    retrying = (F.coalesce("parent_run_id", F.lit("")) != "") & F.col("status").isin("Pending", "Queued", "Running")
    runs = tables.tasks.agg(
        count_where(F.col("status") == "Running", "active_runs"),
        count_where(F.col("status") == "Pending", "queued_runs"),
        F.countDistinct(F.when(retrying, F.col("execution_chain_id"))).alias("retrying_chains"),
    )
    alerts = tables.alerts.agg(count_where(F.col("status") == "OPEN", "open_alerts"))
    queues = newest_queue_samples(tables.queue_samples).agg(
        count_where(F.col("pending_count") > v.QUEUE_DEGRADED_PENDING, "degraded_queues")
    )
    silent = tables.workers.select("worker_id").distinct().join(tables.heartbeats, "worker_id", "left_anti")
    return side_by_side(runs, alerts, queues, silent.agg(F.count(F.lit(1)).alias("offline_workers")))


def throughput(events: DataFrame, now, window_seconds: float = 300) -> DataFrame:
    """Runs finished per minute over the last window."""
    done = events.filter(
        F.col("event_type").isin("task.completed", "task.failed")
        & (F.col("occurred_at") > shift(now, -window_seconds))
        & (F.col("occurred_at") <= instant(now))
    )
    return done.agg((F.count(F.lit(1)) / F.lit(window_seconds / 60)).alias("per_minute"))


# --- cards ---


def pii_breakdown(findings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Finding counts by type, action and rule, runs with findings and failed scans, as (dimension, value, n)."""
    sets = findings.groupingSets([["type"], ["policy_action"], ["rule_id"]], "type", "policy_action", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    )
    dimension = F.when(F.col("g") == 3, F.lit("type")).when(F.col("g") == 5, F.lit("action")).otherwise(F.lit("rule"))
    by = sets.select(dimension.alias("dimension"), F.coalesce("type", "policy_action", "rule_id").alias("value"), "n")
    runs = findings.agg(F.countDistinct("job_id").alias("n")).select(
        F.lit("runs_with_findings").alias("dimension"), F.lit("").alias("value"), "n"
    )
    failed = tasks.agg(F.count_if(F.col("scan_status") == "SCAN_ERROR").alias("n")).select(
        F.lit("scan_failures").alias("dimension"), F.lit("").alias("value"), "n"
    )
    return by.unionByName(runs).unionByName(failed)


def alert_cards(alerts: DataFrame, now, new_seconds: float = 900) -> DataFrame:
    """Unresolved alerts by severity, newly opened and acknowledged ones, as (card, n)."""
    active = F.col("status") != "RESOLVED"
    by = alerts.filter(active).groupBy(F.concat(F.lit("active_"), F.lower("severity")).alias("card")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rest = alerts.agg(
        F.count_if(age_seconds(F.col("opened_at"), now) < new_seconds).alias("new"),
        F.count_if(F.col("status") == "ACKNOWLEDGED").alias("acknowledged"),
    )
    return by.unionByName(rest.select(F.lit("new").alias("card"), F.col("new").alias("n"))).unionByName(
        rest.select(F.lit("acknowledged").alias("card"), F.col("acknowledged").alias("n"))
    )


def most_affected(alerts: DataFrame, n: int = 3) -> DataFrame:
    """Subjects with the most unresolved alerts."""
    counts = alerts.filter(F.col("status") != "RESOLVED").groupBy("subject_type", "subject_id").agg(
        F.count(F.lit(1)).alias("alerts")
    )
    return counts.orderBy(F.col("alerts").desc(), "subject_type", "subject_id").limit(n)


def priority_banner(alerts: DataFrame) -> DataFrame:
    """Level of the whole platform and the newest open alert behind it."""
    is_open = F.col("status") == "OPEN"
    order = F.struct("opened_at", "id")
    tops = {s: F.max_by("summary", F.when(is_open & (F.col("severity") == s), order)) for s in ("CRITICAL", "WARNING")}
    counts = alerts.agg(
        F.count_if(is_open & (F.col("severity") == "CRITICAL")).alias("critical"),
        F.count_if(is_open & (F.col("severity") == "WARNING")).alias("warning"),
        tops["CRITICAL"].alias("top_critical"),
        tops["WARNING"].alias("top_warning"),
    )
    critical, warning = F.col("critical") > 0, F.col("warning") > 0
    return counts.select(
        F.when(critical, F.lit("critical")).when(warning, F.lit("warning")).otherwise(F.lit("healthy")).alias("level"),
        "critical",
        "warning",
        F.when(critical, F.col("top_critical")).when(warning, F.col("top_warning")).alias("top_alert"),
    )


def queue_cards(samples: DataFrame) -> DataFrame:
    newest = newest_queue_samples(samples)
    age = F.col("oldest_pending_age_seconds")
    degraded = F.col("pending_count") > v.QUEUE_DEGRADED_PENDING
    return newest.agg(
        count_where(degraded, "degraded"),
        count_where(~degraded, "healthy"),
        F.sum("stream_length").alias("total_depth"),
        F.max(age).alias("worst_oldest_age"),
        F.min_by("queue_name", F.struct(-age, F.col("queue_name"))).alias("worst_queue"),
        count_where(F.col("consumer_count") == 0, "no_consumer"),
    )


def worker_list(tables: Tables, now, heartbeat_window: float = 86400) -> DataFrame:
    """Newest registration of every worker with its newest recent heartbeat and health."""
    newest = newest_workers(tables.workers)
    recent = tables.heartbeats.filter(F.col("occurred_at") >= shift(now, -heartbeat_window))
    beats = newest_heartbeats(recent).select(
        "worker_id", F.col("occurred_at").alias("last_heartbeat"), "running_attempts", "capacity"
    )
    seen, none = F.col("last_heartbeat"), F.lit(None).cast("timestamp")
    return newest.join(beats, "worker_id", "left").select(
        "worker_id",
        "instance_id",
        "hostname",
        "started_at",
        "configured_capacity",
        "last_heartbeat",
        F.coalesce("running_attempts", F.lit(0)).alias("running_attempts"),
        F.coalesce("capacity", F.lit(0)).alias("capacity"),
        v.instance_verdict(seen, none, none, now).alias("health"),
        v.instance_reason(none, seen, none, none, now).alias("health_reason"),
        "build_revision",
    )


def worker_cards(workers: DataFrame) -> DataFrame:
    """Counts, load and utilisation over a worker list."""
    running, capacity = F.sum("running_attempts"), F.sum("capacity")
    return workers.agg(
        count_where(F.col("health") == "HEALTHY", "online"),
        count_where(F.col("health") == "DEGRADED", "degraded"),
        count_where(F.col("health") == "OFFLINE", "offline"),
        running.alias("running"),
        capacity.alias("capacity"),
        F.coalesce(F.try_divide(running * 100.0, capacity), F.lit(0.0)).alias("utilization_percent"),
    )


def worker_details(tables: Tables, worker_id: str | None = None) -> DataFrame:
    """Per worker: newest registration and heartbeat, attempts by fate, alerts."""

    def only(df: DataFrame, key: str = "worker_id") -> DataFrame:
        return df if worker_id is None else df.filter(F.col(key) == worker_id)

    status = F.col("status")
    attempts = only(tables.attempts).groupBy("worker_id").agg(
        count_where(status.isin("Claimed", "Started"), "active_attempts"),
        count_where(status == "Succeeded", "recent_completions"),
        count_where(status.isin("Failed", "Abandoned"), "recent_failures"),
    )
    alerts = only(tables.alerts.filter(F.col("subject_type") == "WORKER"), "subject_id").groupBy(
        F.col("subject_id").alias("worker_id")
    ).agg(F.count(F.lit(1)).alias("alert_count"), count_where(status == "OPEN", "active_alert_count"))
    beats = newest_heartbeats(only(tables.heartbeats)).select(
        "worker_id", F.col("occurred_at").alias("last_heartbeat"), "running_attempts", "capacity"
    )
    joined = newest_workers(only(tables.workers)).join(beats, "worker_id", "left").join(attempts, "worker_id", "left").join(
        alerts, "worker_id", "left"
    )
    numbers = ("active_attempts", "recent_completions", "recent_failures", "alert_count", "active_alert_count")
    return joined.select(
        "worker_id", "instance_id", "hostname", "started_at", "configured_capacity", "last_heartbeat",
        "running_attempts", "capacity", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
    )


def worker_attempts(tables: Tables, worker_id: str) -> DataFrame:
    """Attempts of one worker as rows, newest start first, each with its group."""
    group = (
        F.when(F.col("status").isin("Claimed", "Started"), F.lit("active"))
        .when(F.col("status") == "Succeeded", F.lit("completed"))
        .when(F.col("status").isin("Failed", "Abandoned"), F.lit("failed"))
    )
    own = tables.attempts.filter(F.col("worker_id") == worker_id).withColumn("fate", group)
    return own.orderBy(F.col("started_at").desc_nulls_last(), "attempt_id")


def queue_list(tables: Tables, now, window: float = 3600) -> DataFrame:
    """Newest sample per queue in the last hour with its verdict."""
    recent = tables.queue_samples.filter(F.col("sampled_at") >= shift(now, -window))
    pending = F.col("pending_count")
    return newest_queue_samples(recent).select(
        "queue_name", "id", "pending_count", "consumer_count", "stream_length", "oldest_pending_age_seconds", "sampled_at",
        v.queue_verdict(pending).alias("health"), v.queue_reason(pending).alias("health_reason"),
    )


def queue_history(tables: Tables, queue: str, limit: int | None = None) -> DataFrame:
    """Samples of one queue, newest first, all or a page; the first row is its current state."""
    pending = F.col("pending_count")
    own = tables.queue_samples.filter(F.col("queue_name") == queue)
    return page(own, [F.col("sampled_at").desc(), F.col("id").desc()], limit).withColumn("health", v.queue_verdict(pending))


# --- schedules ---


def schedule_runs(tables: Tables, schedule_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs of a schedule (or of all) with creation and start drift in seconds; a page of the newest is flagged."""
    runs = tables.tasks.filter(F.coalesce("schedule_id", F.lit("")) != "")
    if schedule_id is not None:
        runs = runs.filter(F.col("schedule_id") == schedule_id)
    if limit is not None:
        runs = page(runs, [F.col("created_at").desc(), F.col("id").desc()], limit)
    started = tables.run_projections.select("job_id", "started_at")
    return runs.join(started, "job_id", "left").select(
        "schedule_id",
        "id",
        F.col("job_id").alias("run_id"),
        "status",
        "created_at",
        "expected_at",
        "started_at",
        seconds_between(F.col("created_at"), F.col("expected_at")).alias("creation_drift_seconds"),
        seconds_between(F.col("started_at"), F.col("expected_at")).alias("start_drift_seconds"),
        *([] if limit is None else ["truncated"]),
    )


def schedule_occurrences(ledger: DataFrame, schedule_id: str, limit: int | None = None) -> DataFrame:
    own = ledger.filter(F.col("schedule_id") == schedule_id)
    return page(own, [F.col("expected_at").desc(), F.col("occurrence_id").desc()], limit)


def schedule_cards(runs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per schedule: late starts, failures, worst and latest drift, missed or delayed annotations, result text."""
    drift = F.col("start_drift_seconds")
    latest = F.max_by(F.struct("creation_drift_seconds", "start_drift_seconds"), F.struct("created_at", "id"))
    ok = F.count_if(F.col("status").isin("Completed", "Succeeded"))
    failed = F.count_if(F.col("status") == "Failed")
    per = runs.groupBy("schedule_id").agg(
        count_where(drift > LATE_START_SECONDS, "late_starts"),
        failed.alias("recent_failures"),
        F.greatest(F.coalesce(F.max(drift), F.lit(0.0)), F.lit(0.0)).alias("worst_start_drift"),
        latest.alias("latest"),
        result_distribution(ok, failed, F.count(F.lit(1))).alias("results"),
    )
    about = annotations.filter((F.col("subject_type") == "SCHEDULE") & F.col("type").rlike("MISSED|DELAYED"))
    marks = about.groupBy(F.col("subject_id").alias("schedule_id")).agg(F.count(F.lit(1)).alias("missed_delayed"))
    return per.join(marks, "schedule_id", "left").select(
        "schedule_id", "late_starts", "recent_failures", "worst_start_drift",
        F.col("latest")["creation_drift_seconds"].alias("latest_creation_drift"),
        F.col("latest")["start_drift_seconds"].alias("latest_start_drift"),
        F.coalesce("missed_delayed", F.lit(0)).alias("missed_delayed"),
        "results",
    )


def result_distribution(ok: Column, failed: Column, total: Column) -> Column:
    """``x ok / y failed``, with ``/ z other`` when there are others; ``…`` for none."""
    other = total - ok - failed
    text = F.concat(ok.cast("string"), F.lit(" ok / "), failed.cast("string"), F.lit(" failed"))
    tail = F.when(other > 0, F.concat(F.lit(" / "), other.cast("string"), F.lit(" other"))).otherwise(F.lit(""))
    return F.when(total == 0, F.lit("…")).otherwise(F.concat(text, tail))


def outcome_counts(ledger: DataFrame) -> DataFrame:
    outcome = F.upper(F.coalesce("outcome", F.lit("")))
    return ledger.groupBy("schedule_id").agg(
        count_where(outcome == CREATED, "created"), count_where(outcome == SKIPPED, "skipped"), count_where(outcome == DUE, "due")
    )


def run_cards(tables: Tables, now, time_range: str | None = None) -> DataFrame:
    """Counts per status, retrying chains, lost and stuck alerts and the failure rate in percent."""
    status = F.col("status")
    runs = within_range(tables.tasks, now, time_range).agg(
        *[count_where(status == s, n) for s, n in [
            ("Completed", "succeeded"), ("Failed", "failed"), ("Running", "running"), ("Queued", "queued"), ("Blocked", "blocked"),
        ]]
    )
    in_retry = (F.coalesce("parent_run_id", F.lit("")) != "") & status.isin("Pending", "Queued", "Running")
    retrying = tables.tasks.agg(F.countDistinct(F.when(in_retry, F.col("execution_chain_id"))).alias("retrying"))
    alerts = within_range(tables.alerts, now, time_range).agg(
        count_where((status == "OPEN") & F.col("alert_type").isin("RUN_LOST", "RUN_STUCK"), "lost_stuck")
    )
    rate = F.try_divide(F.col("failed") * 100.0, F.col("succeeded") + F.col("failed"))
    return side_by_side(runs, retrying, alerts).withColumn("failure_rate", rate)


# --- activity ---


def category_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(category(F.col("event_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def activity_histogram(events: DataFrame, now, bucket_seconds: int, buckets: int) -> DataFrame:
    """Events per category in fixed buckets ending at ``now``'s bucket, empty buckets included.

    Older events are dropped; events from the future count in the last bucket.
    """
    size = bucket_seconds * MICROS
    last = F.floor(F.unix_micros(instant(now)) / F.lit(size)) * F.lit(size)
    first = last - F.lit((buckets - 1) * size)
    t = F.unix_micros("occurred_at")
    slot = F.least(F.floor((t - first) / F.lit(size)), F.lit(buckets - 1)).cast("long")
    counted = (
        events.filter(F.col("occurred_at") >= F.timestamp_micros(first.cast("long")))
        .groupBy(slot.alias("slot"))
        .agg(*[F.count_if(category(F.col("event_type")) == c).alias(c) for c in CATEGORIES], F.count(F.lit(1)).alias("total"))
    )
    frame = events.sparkSession.range(buckets).withColumnRenamed("id", "slot")
    start = F.timestamp_micros((first + F.col("slot") * F.lit(size)).cast("long"))
    return frame.join(counted, "slot", "left").select(
        start.alias("bucket_start"), *[F.coalesce(c, F.lit(0)).alias(c) for c in (*CATEGORIES, "total")]
    )


# --- components ---


def health_summary(rows: DataFrame) -> DataFrame:
    """Status counts over the newest instance per (type, name); deliberate stops are counted apart."""
    newest = latest_per_key(rows, ["component_type", "display_name"], ["started_at", "id"])
    status = v.status_from_health(F.col("health"))
    running = ~F.col("stopped")
    return newest.agg(
        *[count_where(running & (status == s), s) for s in ("healthy", "degraded", "unhealthy", "offline", "unknown")],
        count_where(F.col("stopped"), "stopped"),
    )


# How urgent each status is in the "needs attention" list.
ATTENTION = {"offline": 4, "unhealthy": 3, "degraded": 2, "unknown": 1}


def needs_attention(rows: DataFrame, n: int = 3) -> DataFrame:
    """The worst running components."""
    newest = latest_per_key(rows, ["component_type", "display_name"], ["started_at", "id"]).filter(~F.col("stopped"))
    status = v.status_from_health(F.col("health"))
    rank = reduce(lambda acc, kv: acc.when(F.col("status") == kv[0], kv[1]), ATTENTION.items(), F.when(F.lit(False), 0))
    listed = newest.select("component_type", "display_name", status.alias("status"), "reason").filter(F.col("status") != "healthy")
    return listed.withColumn("urgency", rank).orderBy(F.col("urgency").desc(), "component_type", "display_name").limit(n)


def worst_verdicts(rows: DataFrame, group: str) -> DataFrame:
    """Worst status per group with the reason of one row that has it; rows of no known status are ignored."""
    status = v.status_from_health(F.col("health"))
    worst = F.max_by(F.struct(status.alias("status"), "reason"), F.struct(v.verdict_severity(status), -F.col("id")))
    return rows.groupBy(group).agg(worst.alias("w")).select(group, "w.status", "w.reason")


def known_revisions(workers: DataFrame) -> DataFrame:
    """Distinct build revisions that are known."""
    revision = F.trim(F.coalesce("build_revision", F.lit("")))
    return workers.select(revision.alias("build_revision")).filter(~F.col("build_revision").isin("", "unknown")).distinct()


def merge_rows(first: DataFrame, second: DataFrame, key: str = "display_name") -> DataFrame:
    """Union by name in which ``second`` wins, superseded names go, and known names come first in fixed order."""
    kept = first.join(second.select(key), key, "left_anti")
    needs = F.create_map(*[x for old, new in SUPERSEDED_BY.items() for x in (F.lit(old), F.array(*[F.lit(n) for n in new]))])
    replaced = kept.select(key, F.explode(F.try_element_at(needs, F.col(key))).alias("need"))
    present = second.select(F.col(key).alias("need"), F.lit(True).alias("present")).distinct()
    gone = replaced.join(present, "need", "left").groupBy(key).agg(F.every(F.col("present").isNotNull()).alias("gone")).filter("gone")
    merged = second.unionByName(kept.join(gone, key, "left_anti").select(*second.columns))
    position = F.array_position(F.array(*[F.lit(n) for n in COMPONENT_ORDER]), F.col(key))
    return merged.withColumn("position", F.when(position > 0, position).otherwise(F.lit(len(COMPONENT_ORDER) + 1)).cast("int"))


# --- access log and policy ---


def endpoint_pattern(path: Column) -> Column:
    """Path without query and with identifiers replaced by ``:id``."""
    segments = F.filter(F.split(F.split_part(path, F.lit("?"), F.lit(1)), "/"), lambda s: s != "")
    named = F.transform(segments, lambda s: F.when(s.isin(*ROUTE_WORDS), s).otherwise(F.lit(":id")))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def endpoint_summary(access_log: DataFrame) -> DataFrame:
    return access_log.groupBy(endpoint_pattern(F.col("path")).alias("endpoint")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("failures"),
        whole(F.avg("duration_ms")).alias("avg_latency_ms"),
    )


def policy_history(activations: DataFrame, limit: int | None = None) -> DataFrame:
    return page(activations, [F.col("activated_at").desc(), F.col("id").desc()], limit)


def active_policy(activations: DataFrame) -> DataFrame:
    """Newest successful activation."""
    done = activations.filter(F.col("result") == "SUCCESS")
    return done.orderBy(F.col("activated_at").desc(), F.col("id").desc()).limit(1)


def alert_type_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per type with the readable label."""
    counts = alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("label", alert_type_label(F.col("alert_type")))
