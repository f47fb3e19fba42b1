"""Health verdicts and their reason texts as columns. Ages are in seconds; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opswatch.functions.timing import (
    age_label,
    age_seconds,
    duration_text,
    literal_duration,
    millis_between,
    utc_text,
    whole,
)

QUEUE_DEGRADED_PENDING = 20
HEARTBEAT_DEGRADED_AFTER = 60
HEARTBEAT_OFFLINE_AFTER = 300
STARTUP_GRACE = 30
STOP_TOLERANCE = 2
DRAIN_WINDOW = 300
ACTIVITY_DEGRADED_AFTER = 60
SUBSYSTEM_DEGRADED_AFTER = 120
PIPELINE_SLOW_AFTER = 60

# How bad each verdict is when one must be picked for a group. NULL never takes part.
VERDICT_SEVERITY = {"healthy": 0, "degraded": 1, "unknown": 2, "unhealthy": 3, "offline": 4}


def queue_verdict(pending: Column) -> Column:
    return F.when(pending > QUEUE_DEGRADED_PENDING, F.lit("DEGRADED")).otherwise(F.lit("HEALTHY"))


def queue_reason(pending: Column) -> Column:
    return F.format_string(f"%d messages pending (degraded above {QUEUE_DEGRADED_PENDING})", pending)


def gracefully_stopped(stopped_at: Column, last_seen_at: Column) -> Column:
    """A stop counts as deliberate when no heartbeat came more than the tolerance after it."""
    late = age_seconds(stopped_at, last_seen_at) > STOP_TOLERANCE
    return stopped_at.isNotNull() & ~F.coalesce(late, F.lit(False))


def draining(draining_at: Column, stopped_at: Column, last_seen_at: Column, now) -> Column:
    recent = age_seconds(draining_at, now) < DRAIN_WINDOW
    return draining_at.isNotNull() & ~gracefully_stopped(stopped_at, last_seen_at) & F.coalesce(recent, F.lit(False))


def starting(started_at: Column, last_seen_at: Column, now) -> Column:
    recent = age_seconds(started_at, now) < STARTUP_GRACE
    return last_seen_at.isNull() & F.coalesce(recent, F.lit(False))


def age_verdict(age: Column, degraded_after: float, offline_after: float) -> Column:
    return (
        F.when(age > offline_after, F.lit("OFFLINE"))
        .when(age > degraded_after, F.lit("DEGRADED"))
        .otherwise(F.lit("HEALTHY"))
    )


def instance_verdict(
    last_seen_at: Column,
    stopped_at: Column,
    draining_at: Column,
    now,
    degraded_after: int = HEARTBEAT_DEGRADED_AFTER,
    offline_after: int = HEARTBEAT_OFFLINE_AFTER,
) -> Column:
    return (
        F.when(gracefully_stopped(stopped_at, last_seen_at), F.lit("OFFLINE"))
        .when(draining(draining_at, stopped_at, last_seen_at, now), F.lit("HEALTHY"))
        .when(last_seen_at.isNull(), F.lit("UNKNOWN"))
        .otherwise(age_verdict(age_seconds(last_seen_at, now), degraded_after, offline_after))
    )


def instance_reason(
    started_at: Column,
    last_seen_at: Column,
    stopped_at: Column,
    draining_at: Column,
    now,
    degraded_after: int = HEARTBEAT_DEGRADED_AFTER,
    offline_after: int = HEARTBEAT_OFFLINE_AFTER,
) -> Column:
    thresholds = f" ago (degraded after {literal_duration(degraded_after)}, offline after {literal_duration(offline_after)})"
    return (
        F.when(
            gracefully_stopped(stopped_at, last_seen_at),
            F.concat(F.lit("stopped gracefully at "), utc_text(stopped_at)),
        )
        .when(
            draining(draining_at, stopped_at, last_seen_at, now),
            F.concat(
                F.lit("draining since "),
                utc_text(draining_at),
                F.lit(": finishing the work it holds, not claiming new tasks"),
            ),
        )
        .when(
            starting(started_at, last_seen_at, now),
            F.concat(
                F.lit("starting up (registered "),
                duration_text(whole(age_seconds(started_at, now))),
                F.lit(" ago, no heartbeat yet)"),
            ),
        )
        .when(last_seen_at.isNull(), F.lit("no heartbeat has ever been recorded"))
        .otherwise(
            F.concat(
                F.lit("last heartbeat "), duration_text(whole(age_seconds(last_seen_at, now))), F.lit(thresholds)
            )
        )
    )


def instance_evidence(
    started_at: Column,
    last_seen_at: Column,
    stopped_at: Column,
    draining_at: Column,
    now,
    degraded_after: int = HEARTBEAT_DEGRADED_AFTER,
    offline_after: int = HEARTBEAT_OFFLINE_AFTER,
) -> Column:
    """JSON text; a key is present only when it applies."""
    stopped = gracefully_stopped(stopped_at, last_seen_at)
    drains = draining(draining_at, stopped_at, last_seen_at, now)
    yes = F.lit(True)
    return F.to_json(
        F.struct(
            F.lit(degraded_after).alias("degraded_after_seconds"),
            F.when(drains, yes).alias("draining"),
            F.when(drains, utc_text(draining_at)).alias("draining_at"),
            age_seconds(last_seen_at, now).cast("long").alias("last_seen_age_seconds"),
            F.lit(offline_after).alias("offline_after_seconds"),
            F.when(starting(started_at, last_seen_at, now), yes).alias("starting"),
            F.when(stopped, yes).alias("stopped"),
            F.when(stopped, utc_text(stopped_at)).alias("stopped_at"),
        )
    )


def observed_lag_ms(last_seen_at: Column, now) -> Column:
    return millis_between(now, last_seen_at)


def threshold_ms(
    verdict: Column,
    last_seen_at: Column,
    degraded_after: int = HEARTBEAT_DEGRADED_AFTER,
    offline_after: int = HEARTBEAT_OFFLINE_AFTER,
) -> Column:
    limit = F.when(verdict == "OFFLINE", F.lit(offline_after * 1000)).otherwise(F.lit(degraded_after * 1000))
    return F.when(last_seen_at.isNotNull(), limit.cast("long"))


def component_kind(component_type: Column) -> Column:
    """Upper-case code of a component type, blanks as underscores."""
    return F.upper(F.replace(component_type, F.lit(" "), F.lit("_")))


def worker_status(age: Column) -> Column:
    """Heartbeat age to online, degraded or offline."""
    return (
        F.when(age > HEARTBEAT_OFFLINE_AFTER, F.lit("offline"))
        .when(age > HEARTBEAT_DEGRADED_AFTER, F.lit("degraded"))
        .otherwise(F.lit("online"))
    )


def activity_verdict(observed_at: Column, now, busy: Column) -> Column:
    """Silence is a fault only while there is work in flight."""
    age = age_seconds(observed_at, now)
    return (
        F.when(observed_at.isNull(), F.lit("UNKNOWN"))
        .when((age <= ACTIVITY_DEGRADED_AFTER) | ~busy, F.lit("HEALTHY"))
        .otherwise(F.lit("DEGRADED"))
    )


def activity_reason(label: Column, observed_at: Column, now, busy: Column) -> Column:
    age = age_seconds(observed_at, now)
    ago = duration_text(whole(age))
    return (
        F.when(observed_at.isNull(), F.concat(label, F.lit(": nothing observed yet")))
        .when(age <= ACTIVITY_DEGRADED_AFTER, F.concat(label, F.lit(": last observation "), ago, F.lit(" ago")))
        .when(
            ~busy,
            F.concat(
                label, F.lit(": idle, last observation "), ago, F.lit(" ago (no work in flight, not a fault)")
            ),
        )
        .otherwise(
            F.concat(
                label,
                F.lit(" lag high: "),
                ago,
                F.lit(f" with work in flight (degraded after {literal_duration(ACTIVITY_DEGRADED_AFTER)})"),
            )
        )
    )


def subsystem_verdict(newest: Column, now) -> Column:
    return (
        F.when(newest.isNull(), F.lit("unavailable"))
        .when(age_seconds(newest, now) > SUBSYSTEM_DEGRADED_AFTER, F.lit("degraded"))
        .otherwise(F.lit("available"))
    )


def soften_when_idle(subsystem: Column, verdict: Column, busy: Column) -> Column:
    """Subsystems fed by activity have nothing new to show on an idle system."""
    fed_by_activity = subsystem.isin("event-ingestion", "projection")
    return F.when((verdict == "degraded") & ~busy & fed_by_activity, F.lit("available")).otherwise(verdict)


def timer_verdict(observed_at: Column, now) -> Column:
    age = age_seconds(observed_at, now)
    return F.when(observed_at.isNull(), F.lit("UNKNOWN")).otherwise(
        age_verdict(age, HEARTBEAT_DEGRADED_AFTER, HEARTBEAT_OFFLINE_AFTER)
    )


def pipeline_lag_level(lag_seconds: Column) -> Column:
    return (
        F.when(lag_seconds.isNull(), F.lit("unknown"))
        .when(lag_seconds > PIPELINE_SLOW_AFTER, F.lit("slow"))
        .otherwise(F.lit("ok"))
    )


def sweep_status(failed: Column, total) -> Column:
    """Status of a check run from how many of its checks failed."""
    n = total if isinstance(total, Column) else F.lit(total)
    return (
        F.when(failed == 0, F.lit("COMPLETE"))
        .when(failed == n, F.lit("UNKNOWN"))
        .when(failed < F.floor(n / 2), F.lit("PARTIAL"))
        .otherwise(F.lit("DEGRADED"))
    )


def verdict_from_age(age: Column, degraded_after: float, offline_after: float | None, label: str = "last signal") -> Column:
    """Struct (status, reason) from an age."""
    text = age_label(age)

    def verdict(status: str, reason: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    def limit_text(word: str, limit: float) -> Column:
        return F.concat(F.lit(f"{label} "), text, F.lit(f" ago ({word} after "), age_label(F.lit(limit)), F.lit(")"))

    out = F.when(age.isNull(), verdict("unknown", F.lit(f"no {label} observed yet")))
    if offline_after is not None:
        out = out.when(age > offline_after, verdict("offline", limit_text("offline", offline_after)))
    out = out.when(age > degraded_after, verdict("degraded", limit_text("degraded", degraded_after)))
    return out.otherwise(verdict("healthy", F.concat(F.lit(f"{label} "), text, F.lit(" ago"))))


def verdict_from_count(count: Column, degraded_at: int, unhealthy_at: int | None, label: str = "count") -> Column:
    """Struct (status, reason) from a count."""
    shown = F.concat(F.lit(f"{label} is "), count.cast("string"))

    def verdict(status: str, suffix: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.concat(shown, F.lit(suffix)).alias("reason"))

    healthy = verdict("healthy", "")
    degraded = F.when(count >= degraded_at, verdict("degraded", f" (degraded at {degraded_at}+)")).otherwise(healthy)
    if unhealthy_at is None:
        return degraded
    return F.when(count >= unhealthy_at, verdict("unhealthy", f" (unhealthy at {unhealthy_at}+)")).otherwise(degraded)


def verdict_severity(status: Column) -> Column:
    out = None
    for name, rank in VERDICT_SEVERITY.items():
        out = F.when(status == name, F.lit(rank)) if out is None else out.when(status == name, F.lit(rank))
    return out


def status_from_health(health: Column) -> Column:
    """Server health word to the lower-case verdict; anything unknown is ``unknown``."""
    h = F.lower(F.coalesce(health, F.lit("")))
    return F.when(h.isin("healthy", "degraded", "unhealthy", "offline"), h).otherwise(F.lit("unknown"))
