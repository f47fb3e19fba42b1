"""Run health checks, annotations, component health and subsystem freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions import verdicts as v
from opswatch.functions.status import ACTIVE_ATTEMPTS
from opswatch.functions.timing import (
    age_seconds,
    duration_text,
    instant,
    literal_duration,
    millis_between,
    seconds_between,
    shift,
    whole,
)
from opswatch.operators.filters import work_in_flight
from opswatch.operators.latest import (
    latest_per_key,
    newest_heartbeats,
    newest_queue_samples,
    newest_workers,
)
from opswatch.plans.reports import side_by_side
from opswatch.sources.tables import Tables, visible

SILENT_AFTER = 60
STUCK_HEARTBEAT_WINDOW = 300
LOST_HEARTBEAT_WINDOW = 30
WATERMARK_MARGIN = 5

ANNOTATION_COLUMNS = ("type", "subject_type", "subject_id", "derived_at", "evidence")


def annotation(kind: str | Column, subject_type: str, subject: str, now, evidence: Column) -> list[Column]:
    return [
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        F.lit(subject_type).alias("subject_type"),
        F.col(subject).alias("subject_id"),
        instant(now).alias("derived_at"),
        evidence.alias("evidence"),
    ]


def not_already_open(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New annotations whose (subject, type) has no unresolved one."""
    open_ones = existing.filter(F.col("resolved_at").isNull()).select("subject_id", "type")
    return new.join(open_ones, ["subject_id", "type"], "left_anti").select(*ANNOTATION_COLUMNS)


def newest_progress(events: DataFrame) -> DataFrame:
    """Time of the newest event per run that proves progress; the periodic heartbeat does not."""
    return (
        events.filter(F.col("event_type") != "attempt.heartbeat")
        .groupBy("job_id")
        .agg(F.max("occurred_at").alias("last_event_at"))
    )


def silent_runs(tables: Tables, now, silent_after: float = SILENT_AFTER) -> DataFrame:
    """Running runs without progress for a while, with the newest attempt's worker and its newest heartbeat."""
    running = tables.tasks.filter(F.col("status") == "Running").select("job_id")
    progress = tables.derived("run_progress", lambda t: newest_progress(t.event_log))
    quiet = progress.filter(age_seconds(F.col("last_event_at"), now) > silent_after)
    attempt = tables.derived("newest_attempts", lambda t: latest_per_key(t.attempts, ["job_id"], ["created_at", "attempt_id"], ["worker_id"]))
    beat = tables.heartbeats.groupBy("worker_id").agg(F.max("occurred_at").alias("last_heartbeat_at"))
    return running.join(quiet, "job_id").join(attempt, "job_id").join(beat, "worker_id", "left")


def silence_evidence(silent_after: float) -> Column:
    return F.to_json(F.struct(F.col("last_event_at"), F.lit(int(silent_after)).alias("threshold_seconds")))


SILENT_COLUMNS = ("job_id", "worker_id", "last_event_at", "last_heartbeat_at")


def worker_alive(now, window: float) -> Column:
    return age_seconds(F.col("last_heartbeat_at"), now) < window


def worker_gone(now, window: float) -> Column:
    return F.col("last_heartbeat_at").isNull() | (age_seconds(F.col("last_heartbeat_at"), now) > window)


def stuck_runs(
    tables: Tables, now, silent_after: float = SILENT_AFTER, heartbeat_window: float = STUCK_HEARTBEAT_WINDOW
) -> DataFrame:
    """Silent runs whose worker is alive."""
    return silent_runs(tables, now, silent_after).filter(worker_alive(now, heartbeat_window)).select(*SILENT_COLUMNS)


def lost_runs(
    tables: Tables, now, silent_after: float = SILENT_AFTER, heartbeat_window: float = LOST_HEARTBEAT_WINDOW
) -> DataFrame:
    """Silent runs whose worker never sent a heartbeat or stopped sending them."""
    return silent_runs(tables, now, silent_after).filter(worker_gone(now, heartbeat_window)).select(*SILENT_COLUMNS)


def duplicate_executions(attempts: DataFrame) -> DataFrame:
    """Runs with more than one attempt in hand."""
    active = attempts.filter(F.col("status").isin(*ACTIVE_ATTEMPTS))
    counts = active.groupBy("job_id").agg(F.count(F.lit(1)).alias("active_attempt_count"))
    return counts.filter(F.col("active_attempt_count") > 1)


def run_attempts(attempts: DataFrame) -> DataFrame:
    """One row per run with all that the checks of a sweep ask of its attempts, from one pass.

    The newest and the latest attempt are maxima of rows that begin with their order, so the shuffle carries each order once.
    """
    newest, latest = F.col("newest"), F.col("latest")
    return attempts.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.count_if(F.col("status").isin(*ACTIVE_ATTEMPTS)).alias("active_attempt_count"),
        F.max(F.struct("created_at", "attempt_id", "worker_id")).alias("newest"),
        F.max(F.struct("attempt_number", "attempt_id", "status", "worker_id")).alias("latest"),
    ).select(
        "job_id",
        "attempt_count",
        "active_attempt_count",
        newest["worker_id"].alias("worker_id"),
        F.struct(*[latest[c].alias(c) for c in ("attempt_id", "status", "worker_id")]).alias("latest"),
    )


def shared_tables(attempts: DataFrame, progress: DataFrame) -> dict[str, DataFrame]:
    """What the checks of a sweep derive from ``run_attempts`` and ``newest_progress``, under the names they look for."""
    return {
        "run_progress": progress,
        "newest_attempts": attempts.select("job_id", "worker_id"),
        "duplicate_runs": attempts.filter(F.col("active_attempt_count") > 1).select("job_id", "active_attempt_count"),
        "attempt_summary": attempts.select("job_id", "attempt_count", "latest"),
    }


def missed_schedules(schedules: DataFrame, now, threshold: float = 300) -> DataFrame:
    """Enabled schedules whose next run time is well past."""
    overdue = seconds_between(now, F.col("next_run_at"))
    return schedules.filter(F.col("enabled") & (F.col("next_run_at") < shift(now, -threshold))).select(
        "schedule_id", "next_run_at", overdue.alias("overdue_seconds")
    )


def new_annotations(
    tables: Tables,
    now,
    silent_after: float = SILENT_AFTER,
    stuck_window: float = STUCK_HEARTBEAT_WINDOW,
    lost_window: float = LOST_HEARTBEAT_WINDOW,
) -> DataFrame:
    """Annotations one monitoring pass adds: stuck, lost, duplicated runs and missed schedules."""
    # stuck and lost are two looks at the same silent runs, and a run may be both
    looks = F.array(
        F.when(worker_alive(now, stuck_window), F.lit("RUN_STUCK")), F.when(worker_gone(now, lost_window), F.lit("RUN_LOST"))
    )
    silent = silent_runs(tables, now, silent_after).withColumn("look", F.explode(F.array_compact(looks)))
    found = [
        silent.select(*annotation(F.col("look"), "TASK", "job_id", now, silence_evidence(silent_after))),
        tables.derived("duplicate_runs", lambda t: duplicate_executions(t.attempts)).select(
            *annotation(
                "RUN_DUPLICATE_SUSPECTED", "TASK", "job_id", now, F.to_json(F.struct("active_attempt_count"))
            )
        ),
        missed_schedules(tables.schedule_definitions, now).select(
            *annotation("SCHEDULE_MISSED", "SCHEDULE", "schedule_id", now, F.to_json(F.struct("overdue_seconds")))
        ),
    ]
    return not_already_open(reduce(DataFrame.unionByName, found), tables.annotations)


def with_annotation_id(found: DataFrame) -> DataFrame:
    """Name each annotation by what it says and when it was derived, so that a repeated pass gives the same ones."""
    about = F.concat_ws("|", "type", "subject_type", "subject_id", F.unix_micros("derived_at").cast("string"))
    return found.select(F.concat(F.lit("an-"), F.substring(F.sha2(about, 256), 1, 26)).alias("annotation_id"), "*")


def open_annotations(annotations: DataFrame, *kinds: str) -> DataFrame:
    return annotations.filter(F.col("resolved_at").isNull() & F.col("type").isin(*kinds))


def cleared_silence(tables: Tables, now, kinds: str | tuple[str, ...], silent_after: float = SILENT_AFTER) -> DataFrame:
    """Open annotations of these kinds, stuck or lost, whose run finished or shows progress again."""
    kinds = (kinds,) if isinstance(kinds, str) else kinds
    status = tables.tasks.select(F.col("job_id").alias("subject_id"), "status")
    progress = tables.derived("run_progress", lambda t: newest_progress(t.event_log)).withColumnRenamed("job_id", "subject_id")
    done = F.col("status").isin("Completed", "Failed") | (age_seconds(F.col("last_event_at"), now) < silent_after)
    joined = open_annotations(tables.annotations, *kinds).join(status, "subject_id").join(progress, "subject_id")
    return joined.filter(done)


def cleared_duplicates(tables: Tables) -> DataFrame:
    """Open duplicate annotations whose run has at most one attempt in hand."""
    still = tables.derived("duplicate_runs", lambda t: duplicate_executions(t.attempts)).select(F.col("job_id").alias("subject_id"))
    return open_annotations(tables.annotations, "RUN_DUPLICATE_SUSPECTED").join(still, "subject_id", "left_anti")


def recovered_schedules(tables: Tables, now, threshold: float = 300) -> DataFrame:
    """Open missed-schedule annotations whose schedule is on time again."""
    schedule = tables.schedule_definitions.select(F.col("schedule_id").alias("subject_id"), "next_run_at")
    on_time = seconds_between(now, F.col("next_run_at")) < threshold
    return open_annotations(tables.annotations, "SCHEDULE_MISSED").join(schedule, "subject_id").filter(on_time)


def resolved_annotations(tables: Tables, now, silent_after: float = SILENT_AFTER) -> DataFrame:
    """Annotations one monitoring pass closes, with their ``resolved_at`` set."""
    keep = tables.annotations.columns
    cleared = [
        cleared_silence(tables, now, ("RUN_STUCK", "RUN_LOST"), silent_after),
        cleared_duplicates(tables),
        recovered_schedules(tables, now),
    ]
    union = reduce(DataFrame.unionByName, [c.select(*keep) for c in cleared])
    return union.withColumn("resolved_at", instant(now))


# --- attempt ownership and recovery ---


def attempt_owners(tables: Tables, now, heartbeat_window: float = LOST_HEARTBEAT_WINDOW) -> DataFrame:
    """Unfinished attempts with whether their owner is gone."""
    unfinished = tables.attempts.filter(F.col("status").isin(*ACTIVE_ATTEMPTS)).select(
        "attempt_id", "job_id", "worker_id", "claimed_at"
    )
    beats = tables.heartbeats.groupBy("worker_id").agg(F.max("occurred_at").alias("last_heartbeat_at"))
    instances = tables.workers.groupBy("worker_id").agg(F.max("started_at").alias("instance_started_at"))
    gone = (
        F.coalesce(F.col("instance_started_at") > F.col("claimed_at"), F.lit(False))
        | F.col("last_heartbeat_at").isNull()
        | (age_seconds(F.col("last_heartbeat_at"), now) > heartbeat_window)
    )
    return (
        unfinished.join(beats, "worker_id", "left")
        .join(instances, "worker_id", "left")
        .withColumn("owner_gone", F.coalesce(gone, F.lit(False)))
    )


def recovery_plan(tables: Tables, now, heartbeat_window: float = LOST_HEARTBEAT_WINDOW) -> DataFrame:
    """Per run: PROCEED, WAIT while a live worker holds an attempt, or ABANDON when every owner is gone."""
    owners = attempt_owners(tables, now, heartbeat_window).groupBy("job_id").agg(
        F.every("owner_gone").alias("all_gone"), F.count(F.lit(1)).alias("unfinished_attempts")
    )
    finished = F.col("status").isin("Completed", "Failed")
    plan = (
        F.when(finished | F.col("all_gone").isNull(), F.lit("PROCEED"))
        .when(F.col("all_gone"), F.lit("ABANDON"))
        .otherwise(F.lit("WAIT"))
    )
    return tables.tasks.select("job_id", "status").join(owners, "job_id", "left").select(
        "job_id", F.coalesce("unfinished_attempts", F.lit(0)).alias("unfinished_attempts"), plan.alias("plan")
    )


def retry_candidates(tables: Tables, now, max_retries: int = 3, delay_seconds: float = 10) -> DataFrame:
    """Runs that failed in a way worth retrying and have no child: the child to create, or EXHAUSTED at the limit.

    A retryable failure is told by its ``task.retry_scheduled`` event. The child keeps chain, trace, name and payload.
    """
    retryable = tables.event_log.filter(F.col("event_type") == "task.retry_scheduled").select("job_id")
    children = tables.tasks.filter(F.coalesce("parent_run_id", F.lit("")) != "").select(
        F.col("parent_run_id").alias("job_id")
    )
    failed = (
        tables.tasks.filter(F.col("status") == "Failed")
        .join(retryable, "job_id", "left_semi")
        .join(children, "job_id", "left_anti")
    )
    exhausted = F.col("retry_index") >= max_retries
    return failed.select(
        F.col("job_id").alias("parent_run_id"),
        "execution_chain_id",
        "trace_id",
        "task_name",
        F.lit("Default").alias("task_type"),
        "payload",
        F.when(exhausted, F.lit("EXHAUSTED")).otherwise(F.lit("RETRY")).alias("decision"),
        F.when(~exhausted, F.col("retry_index") + 1).alias("retry_index"),
        F.when(~exhausted, shift(now, delay_seconds)).alias("run_at"),
    )


# --- component instances ---


def component_instances(tables: Tables) -> DataFrame:
    """One row per component instance (its newest registration) with its newest heartbeat time."""
    registered = newest_workers(tables.workers, "instance_id")
    seen = tables.heartbeats.groupBy("instance_id").agg(F.max("occurred_at").alias("last_seen_at"))
    kind = F.when(F.coalesce("component_type", F.lit("")) == "", F.lit("Worker")).otherwise(F.col("component_type"))
    return registered.join(seen, "instance_id", "left").select(
        kind.alias("component_type"),
        "instance_id",
        F.col("worker_id").alias("display_name"),
        "started_at",
        "last_seen_at",
        "stopped_at",
        "draining_at",
        "build_revision",
    )


def component_report(
    tables: Tables,
    now,
    degraded_after: int = v.HEARTBEAT_DEGRADED_AFTER,
    offline_after: int = v.HEARTBEAT_OFFLINE_AFTER,
) -> DataFrame:
    """Health, reason, lag and evidence of every component instance."""
    started, seen, stopped, drain = (F.col(c) for c in ("started_at", "last_seen_at", "stopped_at", "draining_at"))
    verdict = v.instance_verdict(seen, stopped, drain, now, degraded_after, offline_after)
    reason = v.instance_reason(started, seen, stopped, drain, now, degraded_after, offline_after)
    evidence = v.instance_evidence(started, seen, stopped, drain, now, degraded_after, offline_after)
    return component_instances(tables).select(
        "component_type",
        v.component_kind(F.col("component_type")).alias("component_kind"),
        "instance_id",
        "display_name",
        "build_revision",
        "started_at",
        "last_seen_at",
        verdict.alias("health"),
        reason.alias("reason"),
        v.observed_lag_ms(seen, now).alias("observed_lag_ms"),
        v.threshold_ms(verdict, seen, degraded_after, offline_after).alias("threshold_ms"),
        evidence.alias("evidence"),
        v.gracefully_stopped(stopped, seen).alias("stopped"),
    )


def component_state(now) -> Column:
    """State used for transitions: the verdict, with draining and deliberate stop told apart."""
    seen, stopped, drain = (F.col(c) for c in ("last_seen_at", "stopped_at", "draining_at"))
    return (
        F.when(v.gracefully_stopped(stopped, seen), F.lit("stopped"))
        .when(v.draining(drain, stopped, seen, now), F.lit("draining"))
        .otherwise(F.lower(v.instance_verdict(seen, stopped, drain, now)))
    )


def worker_states(tables: Tables, now) -> DataFrame:
    """Current status word of every worker from its newest heartbeat."""
    beats = newest_heartbeats(tables.heartbeats)
    marks = tables.workers.groupBy("instance_id").agg(
        F.max(F.col("stopped_at").isNotNull()).alias("stopped"),
        F.max(
            F.col("draining_at").isNotNull() & F.col("stopped_at").isNull() & (F.col("draining_at") > shift(now, -v.DRAIN_WINDOW))
        ).alias("draining"),
    )
    status = (
        F.when(F.col("stopped"), F.lit("stopped"))
        .when(F.col("draining"), F.lit("draining"))
        .otherwise(v.worker_status(age_seconds(F.col("occurred_at"), now)))
    )
    return beats.join(marks, "instance_id", "left").select("worker_id", "instance_id", "occurred_at", status.alias("status"))


def observed_states(tables: Tables, now) -> DataFrame:
    """(kind, subject_id, state) of every worker, component instance and of monitoring itself."""
    workers = worker_states(tables, now).select(F.lit("worker").alias("kind"), F.col("worker_id").alias("subject_id"), F.col("status").alias("state"))
    components = component_instances(tables).select(F.lit("component").alias("kind"), F.col("instance_id").alias("subject_id"), component_state(now).alias("state"))
    newest = tables.monitoring_healths.agg(F.max_by("status", F.struct("sampled_at", "id")).alias("state")).filter("state IS NOT NULL")
    own = newest.select(F.lit("monitoring").alias("kind"), F.lit("platform").alias("subject_id"), F.lower("state").alias("state"))
    return workers.unionByName(components).unionByName(own)


def state_changes(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Observed states that are new or differ from the known ones, with ``previous``: NULL at a first sighting."""
    before = known.select("kind", "subject_id", F.col("state").alias("previous"))
    return observed.join(before, ["kind", "subject_id"], "left").filter(~F.col("state").eqNullSafe(F.col("previous")))


# --- freshness ---


def newest_observations(tables: Tables, last_alert_sweep=None) -> DataFrame:
    """Newest timestamp per subsystem, one row each."""
    probes = [
        ("Event Ingestion", tables.event_log, "ingested_at"),
        ("Projection", tables.run_projections, "last_event_at"),
        ("Redis Queue Inspection", tables.queue_samples, "sampled_at"),
        ("PII Scanner", tables.tasks, "created_at"),
    ]
    rows = [
        df.agg(F.max(column).alias("last_observed_at")).select(F.lit(name).alias("subsystem"), "last_observed_at")
        for name, df, column in probes
    ]
    if last_alert_sweep is not None:
        sweep = tables.tasks.sparkSession.range(1).select(
            F.lit("Alert Evaluation").alias("subsystem"), instant(last_alert_sweep).alias("last_observed_at")
        )
        rows.append(sweep)
    return reduce(DataFrame.unionByName, rows)


def subsystem_freshness(tables: Tables, now, last_alert_sweep=None) -> DataFrame:
    seen = F.col("last_observed_at")
    return newest_observations(tables, last_alert_sweep).select(
        "subsystem",
        "last_observed_at",
        age_seconds(seen, now).alias("lag_seconds"),
        seen.isNotNull().alias("available"),
        v.pipeline_lag_level(age_seconds(seen, now)).alias("level"),
    )


def log_watermark(events: DataFrame, margin: int = WATERMARK_MARGIN) -> DataFrame:
    """Highest event id that is safe to resume from."""
    top = F.coalesce(F.max("id"), F.lit(0))
    return events.agg(F.greatest(top - margin, F.lit(0)).alias("watermark"))


def pipeline_lag(events: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Last and worst time from occurrence to ingestion, and how many stored events are not yet published."""
    lag = F.greatest(millis_between(F.col("ingested_at"), F.col("occurred_at")), F.lit(0))
    out = events.agg(
        F.max_by(lag, F.struct("ingested_at", "id")).alias("last_lag_ms"),
        F.max(lag).alias("max_lag_ms"),
        F.count(F.lit(1)).alias("recorded"),
    )
    if published is None:
        return out
    done = published.agg(F.count(F.lit(1)).alias("published"))
    return side_by_side(out, done).withColumn("backlog", F.greatest(F.col("recorded") - F.col("published"), F.lit(0)))


def derived_components(tables: Tables, now, last_alert_sweep=None) -> DataFrame:
    """Report rows for the parts of the platform that have no instance of their own, judged by their data."""
    fed = [
        ("MONITORING_INGESTOR", "Monitoring Ingestor", "event ingestion", tables.event_log, "ingested_at"),
        ("MONITORING_PROJECTOR", "Monitoring Projector", "projection", tables.run_projections, "last_event_at"),
        ("PII_SCANNER", "PII Scanner", "PII scan", tables.tasks, "created_at"),
    ]
    newest = [df.agg(F.max(column).alias(kind)) for kind, _, _, df, column in fed]
    rows = F.array(
        *[
            F.struct(F.lit(kind).alias("component_kind"), F.lit(name).alias("display_name"), F.lit(label).alias("label"), F.col(kind).alias("at"))
            for kind, name, label, _, _ in fed
        ]
    )
    observed = side_by_side(work_in_flight(visible(tables.tasks), now), *newest).select("busy", F.inline(rows))
    at = F.col("at")
    activity = observed.select(
        "component_kind",
        "display_name",
        v.activity_verdict(at, now, F.col("busy")).alias("health"),
        v.activity_reason(F.col("label"), at, now, F.col("busy")).alias("reason"),
        millis_between(now, at).alias("observed_lag_ms"),
    )
    without = newest_queue_samples(tables.queue_samples).agg(F.count_if(F.col("consumer_count") == 0).alias("n"))
    delivery = without.select(
        F.lit("REDIS_DELIVERY").alias("component_kind"),
        F.lit("Redis Delivery").alias("display_name"),
        F.when(F.col("n") > 0, F.lit("DEGRADED")).otherwise(F.lit("HEALTHY")).alias("health"),
        F.when(F.col("n") > 0, F.format_string("%d queue(s) have no consumer", F.col("n")))
        .otherwise(F.lit("every sampled queue has a consumer"))
        .alias("reason"),
        F.lit(None).cast("long").alias("observed_lag_ms"),
    )
    sweep = instant(last_alert_sweep) if last_alert_sweep is not None else F.lit(None).cast("timestamp")
    evaluator = tables.tasks.sparkSession.range(1).select(sweep.alias("at")).select(
        F.lit("ALERT_EVALUATOR").alias("component_kind"),
        F.lit("Alert Evaluator").alias("display_name"),
        v.timer_verdict(at, now).alias("health"),
        timer_reason(at, now).alias("reason"),
        millis_between(now, at).alias("observed_lag_ms"),
    )
    return activity.unionByName(delivery).unionByName(evaluator)


def timer_reason(at: Column, now) -> Column:
    age = age_seconds(at, now)
    ago = F.concat(F.lit("last alert sweep "), duration_text(whole(age)), F.lit(" ago"))
    offline, degraded = v.HEARTBEAT_OFFLINE_AFTER, v.HEARTBEAT_DEGRADED_AFTER
    return (
        F.when(at.isNull(), F.lit("no alert sweep has completed yet"))
        .when(age > offline, F.concat(ago, F.lit(f" (offline after {literal_duration(offline)})")))
        .when(age > degraded, F.concat(ago, F.lit(f" (degraded after {literal_duration(degraded)})")))
        .otherwise(ago)
    )

