"""Run status, failure and alert vocabulary as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The status an event type asserts, and how far through its life each status is.
ASSERTED_STATUS = {
    "task.created": "Pending",
    "task.rerun_created": "Pending",
    "task.queued": "Queued",
    "task.started": "Running",
    "task.completed": "Completed",
    "task.failed": "Failed",
    "task.blocked": "Blocked",
}
STATUS_RANK = {"Pending": 10, "Queued": 20, "Running": 30, "Completed": 40, "Failed": 40, "Blocked": 40}
TERMINAL = ("Completed", "Failed", "Blocked")
FAILURE_CATEGORIES = (
    "APPLICATION_ERROR",
    "INVALID_INPUT",
    "DEPENDENCY_ERROR",
    "TIMEOUT",
    "WORKER_FAILURE",
    "INFRASTRUCTURE_ERROR",
    "UNKNOWN",
)
# Retry budget, statuses of attempts in hand, severities that notify.
MAX_RETRIES = 3
ACTIVE_ATTEMPTS = ("Claimed", "Started")
NOTIFIED_SEVERITIES = ("WARNING", "CRITICAL")


def lookup(key: Column, values: dict, default=None) -> Column:
    """A small fixed mapping as a ``CASE`` expression."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def blank(x: Column) -> Column:
    """True for NULL and empty text."""
    return x.isNull() | (x == "")


def trimmed(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def asserted_status(event_type: Column) -> Column:
    """Status an event type asserts; NULL for the many events that say nothing about run state."""
    return lookup(event_type, ASSERTED_STATUS)


def status_rank(status: Column) -> Column:
    return lookup(status, STATUS_RANK, 0)


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def failure_category(category: Column) -> Column:
    """Trimmed upper-case category, or UNKNOWN when it is not one of the known seven."""
    c = F.upper(trimmed(category))
    return F.when(c.isin(*FAILURE_CATEGORIES), c).otherwise(F.lit("UNKNOWN"))


def run_state_name(status: Column, category: Column, retry_index: Column) -> Column:
    """Public state name of a run; a spent retry budget (DEAD) wins over a timeout."""
    failed = (
        F.when(retry_index >= MAX_RETRIES, F.lit("DEAD"))
        .when(~blank(category) & (failure_category(category) == "TIMEOUT"), F.lit("TIMED_OUT"))
        .otherwise(F.lit("FAILED"))
    )
    return (
        F.when(blank(status) | (status == "Pending"), F.lit("SCHEDULED"))
        .when(status == "Queued", F.lit("QUEUED"))
        .when(status == "Running", F.lit("RUNNING"))
        .when(status == "Completed", F.lit("SUCCEEDED"))
        .when(status == "Failed", failed)
        .when(status == "Blocked", F.lit("FAILED"))
        .otherwise(F.lit("UNKNOWN"))
    )


def status_of(status: Column, current_status: Column) -> Column:
    """The run's own status, or the projected one when it has none."""
    return F.when(trimmed(status) != "", trimmed(status)).otherwise(trimmed(current_status))


def status_class(status: Column) -> Column:
    s = F.lower(trimmed(status))
    return F.when(s.isin(*[x.lower() for x in STATUS_RANK]), s).otherwise(F.lit("unknown"))


def status_label(status: Column) -> Column:
    return F.when(trimmed(status) == "", F.lit("Unknown")).otherwise(trimmed(status))


def status_disagrees(status: Column, current_status: Column) -> Column:
    """True when both statuses are known and differ."""
    a, b = trimmed(status), trimmed(current_status)
    return (a != "") & (b != "") & (a != b)


def attempt_kind(event_type: Column) -> Column:
    """``claimed``, ``started`` or ``finished`` for attempt events, NULL for the rest."""
    return (
        F.when(event_type == "attempt.claimed", F.lit("claimed"))
        .when(event_type == "attempt.started", F.lit("started"))
        .when(
            event_type.isin("attempt.finished", "attempt.succeeded", "attempt.failed", "attempt.abandoned"),
            F.lit("finished"),
        )
    )


def latest_transition(completed_at: Column, started_at: Column, queued_at: Column) -> Column:
    """Struct (label, at) of the newest known transition; on a tie the later stage wins. NULL when none."""
    known = [
        F.when(F.year(ts) > 1970, F.struct(ts.alias("at"), F.lit(order).alias("stage"), F.lit(label).alias("label")))
        for order, (label, ts) in enumerate(
            [("Run queued", queued_at), ("Run started", started_at), ("Run completed", completed_at)]
        )
    ]
    best = F.array_max(F.array(*known))
    return F.when(best.isNotNull(), F.struct(best["label"].alias("label"), best["at"].alias("at")))


# --- alerts ---


def alert_subject_type(annotation_subject_type: Column) -> Column:
    """Annotations call a run TASK; alerts call it RUN."""
    return F.when(annotation_subject_type == "TASK", F.lit("RUN")).otherwise(annotation_subject_type)


def alert_summary(what: Column, subject_type: Column, subject_id: Column) -> Column:
    return F.concat(what, F.lit(" on "), subject_type, F.lit(" "), subject_id)


def should_notify(severity: Column) -> Column:
    return F.coalesce(severity.isin(*NOTIFIED_SEVERITIES), F.lit(False))


def alert_type_label(alert_type: Column) -> Column:
    """``RUN_LOST`` becomes ``Run lost``."""
    words = F.trim(F.regexp_replace(F.lower(alert_type), "_+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))


def short_checksum(checksum: Column) -> Column:
    c = trimmed(checksum)
    return F.when(c == "", F.lit("—")).otherwise(F.substring(c, 1, 8))


def notification_payload(alert: dict[str, Column]) -> Column:
    """JSON text sent for an alert. ``evidence`` is embedded as JSON when it is a JSON object, else left out."""
    fields = ("alert_id", "alert_type", "severity", "status", "summary", "subject_type", "subject_id")
    base = F.to_json(F.struct(*[F.coalesce(alert[f], F.lit("")).alias(f) for f in fields]))
    evidence = F.trim(F.coalesce(alert["evidence"], F.lit("")))
    is_object = evidence.startswith("{") & F.try_parse_json(evidence).isNotNull()
    keep = is_object & (F.regexp_replace(evidence, r"\s", "") != "{}")
    with_evidence = F.concat(base.substr(F.lit(1), F.length(base) - 1), F.lit(',"evidence":'), evidence, F.lit("}"))
    return F.when(keep, with_evidence).otherwise(base)
