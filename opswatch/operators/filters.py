"""Optional filters of the investigation queries. A parameter that is None adds no condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions.feed import category, has_prefix
from opswatch.functions.timing import instant, seconds_between, shift
from opswatch.sources.tables import Tables

RUN_COLUMNS = {
    "run_id": "job_id",
    "execution_chain_id": "execution_chain_id",
    "parent_run_id": "parent_run_id",
    "job_type": "task_type",
    "execution_state": "status",
    "retry_index": "retry_index",
    "schedule_id": "schedule_id",
    "pii_scan_status": "scan_status",
    "queue": "queue",
}
ALERT_COLUMNS = {c: c for c in ("status", "severity", "subject_type", "subject_id", "rule_id")}
FINDING_COLUMNS = {
    "pii_type": "type",
    "source": "source",
    "policy_action": "policy_action",
    "run_id": "job_id",
    "detector_id": "detector_id",
    "rule_id": "rule_id",
}
TIME_RANGES = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}
# annotations store a run as TASK, alerts as RUN; both mean the same subject
RUN_SUBJECTS = ("RUN", "TASK")


def equal_filters(df: DataFrame, columns: dict[str, str], **wanted) -> DataFrame:
    """AND of ``column = value`` for every supplied parameter."""
    for name, value in wanted.items():
        if value is not None and value != "":
            df = df.filter(F.col(columns[name]) == F.lit(value))
    return df


def range_filters(df: DataFrame, column: str, at_least=None, at_most=None) -> DataFrame:
    if at_least is not None:
        df = df.filter(F.col(column) >= instant(at_least))
    if at_most is not None:
        df = df.filter(F.col(column) <= instant(at_most))
    return df


def within_range(df: DataFrame, now, time_range: str | None, column: str = "created_at") -> DataFrame:
    """Rows newer than a named range before ``now``; an unknown range adds no condition."""
    seconds = TIME_RANGES.get(time_range or "")
    return df if seconds is None else df.filter(F.col(column) >= shift(now, -seconds))


def filter_runs(tasks: DataFrame, created_from=None, created_to=None, **wanted) -> DataFrame:
    return range_filters(equal_filters(tasks, RUN_COLUMNS, **wanted), "created_at", created_from, created_to)


def runs_related_to(
    tables: Tables,
    runs: DataFrame,
    worker_id: str | None = None,
    started_time=None,
    started_from=None,
    started_to=None,
    attempt_count: int | None = None,
    failure_category: str | None = None,
    pii_type: str | None = None,
    monitoring_annotation: str | None = None,
    alert_type: str | None = None,
    alert_severity: str | None = None,
    duration_from: float | None = None,
    duration_to: float | None = None,
) -> DataFrame:
    """Runs kept by conditions on other tables, each a semi join on the run id."""

    def keep(df: DataFrame, other: DataFrame, key: str = "job_id") -> DataFrame:
        return df.join(other.select(F.col(key).alias("job_id")), "job_id", "left_semi")

    if worker_id is not None:
        runs = keep(runs, tables.attempts.filter(F.col("worker_id") == worker_id))
    if started_time is not None:
        runs = keep(runs, tables.run_projections.filter(F.col("started_at") == instant(started_time)))
    if started_from is not None or started_to is not None:
        runs = keep(runs, range_filters(tables.run_projections, "started_at", started_from, started_to))
    if attempt_count is not None:
        counts = tables.attempts.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
        runs = keep(runs, counts.filter(F.col("n") == int(attempt_count)))
    if failure_category is not None:
        runs = keep(runs, tables.attempts.filter(F.col("failure_category") == failure_category))
    if pii_type is not None:
        runs = keep(runs, tables.findings.filter(F.col("type") == pii_type))
    if monitoring_annotation is not None:
        about_runs = tables.annotations.filter(F.col("subject_type").isin(*RUN_SUBJECTS))
        runs = keep(runs, about_runs.filter(F.col("type") == monitoring_annotation), "subject_id")
    if alert_type is not None:
        about_runs = tables.alerts.filter(F.col("subject_type").isin(*RUN_SUBJECTS))
        runs = keep(runs, about_runs.filter(F.col("alert_type") == alert_type), "subject_id")
    if alert_severity is not None:
        about_runs = tables.alerts.filter(F.col("subject_type").isin(*RUN_SUBJECTS))
        runs = keep(runs, about_runs.filter(F.col("severity") == alert_severity), "subject_id")
    took = seconds_between(F.col("finished_at"), F.col("started_at"))
    if duration_from is not None:
        runs = keep(runs, tables.attempts.filter(took >= float(duration_from)))
    if duration_to is not None:
        runs = keep(runs, tables.attempts.filter(took <= float(duration_to)))
    return runs


def filter_alerts(
    alerts: DataFrame, alert_type: str | None = None, rule_version: int | None = None, opened_from=None, opened_to=None, **wanted
) -> DataFrame:
    """Alert search; ``alert_type`` may be a comma list."""
    alerts = equal_filters(alerts, ALERT_COLUMNS, **wanted)
    if alert_type:
        alerts = alerts.filter(F.col("alert_type").isin(*alert_type.split(",")))
    if rule_version is not None:
        alerts = alerts.filter(F.col("rule_version") == int(rule_version))
    return range_filters(alerts, "opened_at", opened_from, opened_to)


def filter_findings(findings: DataFrame, **wanted) -> DataFrame:
    """Finding search, newest first."""
    return equal_filters(findings, FINDING_COLUMNS, **wanted).orderBy(F.col("created_at").desc(), F.col("id").desc())


def filter_schedules(schedules: DataFrame, enabled: bool | None = None, schedule_id: str | None = None) -> DataFrame:
    if enabled is not None:
        schedules = schedules.filter(F.col("enabled") == F.lit(enabled))
    return equal_filters(schedules, {"schedule_id": "schedule_id"}, schedule_id=schedule_id)


def with_event_prefix(events: DataFrame, prefixes: list[str]) -> DataFrame:
    return events.filter(has_prefix(F.col("event_type"), prefixes))


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive substring test on trimmed search text; blank text accepts everything."""
    wanted = text.strip().lower()
    return F.lower(column).contains(wanted) if wanted else F.lit(True)


def search_events(events: DataFrame, subject: str = "", categories: list[str] | None = None) -> DataFrame:
    """Events of the shown categories whose subject contains the text."""
    shown = events if categories is None else events.filter(category(F.col("event_type")).isin(*categories))
    return shown.filter(contains_text(F.col("job_id"), subject))


def search_workers(workers: DataFrame, worker_id: str = "", status: str | None = None, hostname: str = "") -> DataFrame:
    out = workers.filter(contains_text(F.col("worker_id"), worker_id) & contains_text(F.col("hostname"), hostname))
    return out if not status else out.filter(F.col("status") == status)


def search_queues(queues: DataFrame, name: str = "", status: str | None = None, no_consumers: bool = False) -> DataFrame:
    out = queues.filter(contains_text(F.col("queue_name"), name))
    if status:
        out = out.filter(F.col("health") == status)
    return out.filter(F.col("consumer_count") == 0) if no_consumers else out


def search_schedules(schedules: DataFrame, schedule_id: str = "", enabled: bool | None = None) -> DataFrame:
    return filter_schedules(schedules.filter(contains_text(F.col("schedule_id"), schedule_id)), enabled)


# --- work selection ---


def due_tasks(tasks: DataFrame, now) -> DataFrame:
    return tasks.filter((F.col("status") == "Pending") & (F.col("run_at") <= instant(now)))


def stranded_tasks(tasks: DataFrame, now, idle_seconds: float = 30, limit: int | None = None) -> DataFrame:
    """Queued runs that were never published, oldest first."""
    stuck = (F.col("status") == "Queued") & F.col("published_at").isNull() & (F.col("updated_at") < shift(now, -idle_seconds))
    found = tasks.filter(stuck).orderBy(F.col("updated_at"), F.col("id"))
    return found if limit is None else found.limit(limit)


def due_schedules(schedules: DataFrame, now) -> DataFrame:
    return schedules.filter(F.col("enabled") & (F.col("next_run_at") <= instant(now)))


def sendable_notifications(
    notifications: DataFrame, now, max_attempts: int = 3, retry_seconds: float = 300, limit: int | None = None
) -> DataFrame:
    """Pending notifications, and failed ones whose retry is due."""
    retry_due = F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") < shift(now, -retry_seconds))
    retry = (F.col("status") == "FAILED") & (F.col("attempt_count") < max_attempts) & retry_due
    found = notifications.filter((F.col("status") == "PENDING") | retry).orderBy("id")
    return found if limit is None else found.limit(limit)


def in_flight(tasks: DataFrame, now) -> DataFrame:
    """Runs that mean the system has work: queued, running, or pending and due."""
    due = (F.col("status") == "Pending") & (F.col("run_at") <= instant(now))
    return tasks.filter(F.col("status").isin("Queued", "Running") | due)


def work_in_flight(tasks: DataFrame, now) -> DataFrame:
    """One row, ``busy``."""
    return in_flight(tasks, now).select("job_id").limit(1).agg((F.count(F.lit(1)) > 0).alias("busy"))


