"""Event families, scopes, visibility, priority and freshness of the live event feed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from opswatch.functions.status import lookup
from opswatch.functions.timing import instant, millis_between

# --- Fixed values of the feed vocabulary ---
NOISE_TYPES = ("task.progress", "attempt.heartbeat")
NON_RUN_PREFIXES = ("queue.", "worker.", "component.", "monitoring.", "redis.", "alert.", "retention.", "schedule.")
SYSTEM_FAMILIES = ("queue", "worker", "component", "monitoring", "redis", "delivery", "retention")
CATEGORIES = ("task", "attempt", "schedule", "alert", "pii", "system", "other")
CRITICAL_TYPES = (
    "task.failed",
    "run.lost",
    "worker.offline",
    "queue.no_consumer",
    "alert.opened",
    "schedule.missed",
    "monitoring.degraded",
    "component.offline",
    "pii.policy_violated",
    "pii.policy_reload_failed",
    "pii.policy_validation_failed",
)
INFORMATIONAL_PREFIXES = (
    "task.progress",
    "attempt.heartbeat",
    "queue.pending_count",
    "queue.oldest_age",
    "queue.consumer_count",
    "queue.read",
    "worker.heartbeat_age",
    "worker.capacity_used",
)
HEALTH_CHANGES = (
    "queue.degraded",
    "queue.healthy",
    "queue.no_consumer",
    "queue.consumer_restored",
    "worker.online",
    "worker.degraded",
    "worker.offline",
    "worker.stopped",
    "worker.draining",
)
LAGGING_AFTER_MS = 5000
MAX_SCOPES = 16
MAX_SCOPE_ID = 200
# which permission opens an event family; the first matching prefix owns an event
VISIBILITY_RULES = (
    ("alert.", "alerts.read"),
    ("pii.policy", "pii.policy.read"),
    ("pii.", "pii.findings.read"),
)
SCOPE_PREFIXES = {
    "runs": ("task.", "run.", "attempt."),
    "run": ("task.", "run.", "attempt."),
    "queues": ("queue.",),
    "queue": ("queue.",),
    "workers": ("worker.",),
    "worker": ("worker.",),
    "schedules": ("schedule.",),
    "alerts": ("alert.",),
    "pii.summary": ("pii.",),
    "monitoring.health": ("monitoring.",),
    "components": ("component.",),
}
SCOPES_WITH_ID = ("run", "execution-chain", "queue", "worker")
SUMMARY_TYPE = "platform.summary"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_prefix(event_type: Column, prefixes) -> Column:
    """True when the type starts with one of the prefixes; an empty list accepts everything."""
    prefixes = list(prefixes)
    return any_of([event_type.startswith(p) for p in prefixes]) if prefixes else F.lit(True)


# --- scopes ---


class ScopeError(ValueError):
    """A feed scope that cannot be understood."""


@dataclass(frozen=True)
class Scope:
    kind: str
    id: str = ""

    def condition(self, event_type: Column, subject: Column, chain: Column) -> Column:
        if self.kind == SUMMARY_TYPE:
            return event_type == SUMMARY_TYPE
        if self.kind == "execution-chain":
            return F.coalesce(chain == self.id, F.lit(False))
        by_family = has_prefix(event_type, SCOPE_PREFIXES[self.kind])
        return by_family & (subject == self.id) if self.id else by_family


def parse_scopes(raw: list[str]) -> list[Scope]:
    """Scopes from text such as ``runs`` or ``run:j1``; repeats are dropped."""
    scopes: list[Scope] = []
    for text in raw:
        kind, colon, ident = text.strip().partition(":")
        if kind in SCOPES_WITH_ID:
            if not ident:
                raise ScopeError(f"{kind!r} is about one subject: write {kind}:<id>")
            if len(ident.encode()) > MAX_SCOPE_ID:
                raise ScopeError(f"the id after {kind!r} takes more than {MAX_SCOPE_ID} bytes")
        elif kind == SUMMARY_TYPE or kind in SCOPE_PREFIXES:
            if colon:
                raise ScopeError(f"{kind!r} covers a whole family: leave out what follows the colon")
        else:
            raise ScopeError(f"{text.strip()!r} names no family of events")
        scope = Scope(kind, ident)
        if scope not in scopes:
            scopes.append(scope)
    if len(scopes) > MAX_SCOPES:
        raise ScopeError(f"{len(scopes)} different scopes were asked for, {MAX_SCOPES} are allowed")
    return scopes


def in_scopes(scopes: list[Scope], event_type: Column, subject: Column, chain: Column) -> Column:
    """True when any scope accepts the event; no scopes accept everything."""
    return any_of([s.condition(event_type, subject, chain) for s in scopes]) if scopes else F.lit(True)


def required_permission(event_type: Column) -> Column:
    out = None
    for prefix, permission in VISIBILITY_RULES:
        hit = event_type.startswith(prefix)
        out = F.when(hit, F.lit(permission)) if out is None else out.when(hit, F.lit(permission))
    return out


def visible_to(event_type: Column, permissions) -> Column:
    """False for events whose family needs a permission the reader lacks."""
    needed = required_permission(event_type)
    held = [p for _, p in VISIBILITY_RULES if p in set(permissions)]
    return needed.isNull() | (needed.isin(*held) if held else F.lit(False))


def is_noise(event_type: Column) -> Column:
    return event_type.isin(*NOISE_TYPES)


def is_timeline_noise(event_type: Column) -> Column:
    return event_type.contains("progress") | event_type.contains("heartbeat")


def is_run_scoped(subject: Column, event_type: Column) -> Column:
    """Whether the subject of an event can be a run."""
    return (
        F.when(subject == "system", F.lit(False))
        .when(event_type == "schedule.occurrence_run_created", F.lit(True))
        .otherwise(~has_prefix(event_type, NON_RUN_PREFIXES))
    )


# --- classification ---


def category(event_type: Column) -> Column:
    family = F.split_part(event_type, F.lit("."), F.lit(1))
    return (
        F.when(family.isin("task", "run"), F.lit("task"))
        .when(family.isin("attempt", "schedule", "alert", "pii"), family)
        .when(family.isin(*SYSTEM_FAMILIES), F.lit("system"))
        .otherwise(F.lit("other"))
    )


# Resource classes by the first segment of an event type, and of single types.
FAMILY_RESOURCES = {
    "alert": "ALERT",
    "attempt": "ATTEMPT",
    "component": "COMPONENT",
    "monitoring": "MONITORING_HEALTH",
    "pii": "PII_FINDING_SUMMARY",
    "queue": "QUEUE",
    "run": "RUN",
    "schedule": "SCHEDULE",
    "task": "RUN",
    "worker": "WORKER",
}
TYPE_RESOURCES = {
    SUMMARY_TYPE: "PLATFORM_SUMMARY",
    "pii.policy_activated": "PII_POLICY_ACTIVATED",
    "pii.policy_drift_detected": "PII_POLICY_DRIFT_DETECTED",
    "pii.policy_reload_failed": "PII_POLICY_RELOAD_FAILED",
}


def resource_type(event_type: Column) -> Column:
    """Class of the resource an event is about: by its type, else by the family before its first dot, else UNKNOWN."""
    family = F.when(event_type.contains("."), F.split_part(event_type, F.lit("."), F.lit(1)))
    return F.coalesce(lookup(event_type, TYPE_RESOURCES), lookup(family, FAMILY_RESOURCES), F.lit("UNKNOWN"))


def change_type(event_type: Column) -> Column:
    health = event_type.isin(*HEALTH_CHANGES) | has_prefix(event_type, ("monitoring.", "component."))
    return F.when(health, F.lit("HEALTH_CHANGED")).otherwise(F.lit("INVALIDATE"))


def priority(event_type: Column, severity: Column | None = None) -> Column:
    """CRITICAL, NORMAL or INFORMATIONAL; an opened alert of lower severity is NORMAL."""
    informational = event_type.isin(*INFORMATIONAL_PREFIXES) | has_prefix(
        event_type, [p + "." for p in INFORMATIONAL_PREFIXES]
    )
    plain = (
        F.when(is_critical(event_type), F.lit("CRITICAL"))
        .when(informational, F.lit("INFORMATIONAL"))
        .otherwise(F.lit("NORMAL"))
    )
    if severity is None:
        return plain
    minor = (event_type == "alert.opened") & ~F.coalesce(severity, F.lit("")).isin("", "CRITICAL")
    return F.when(minor, F.lit("NORMAL")).otherwise(plain)


def is_critical(event_type: Column) -> Column:
    """Types that are critical whatever their severity."""
    return event_type.isin(*CRITICAL_TYPES)


def projection_lag_ms(observed_at: Column, now) -> Column:
    return F.greatest(millis_between(now, F.coalesce(observed_at, instant(now))), F.lit(0))


def freshness(observed_at: Column, now, replayed: Column) -> Column:
    lagging = projection_lag_ms(observed_at, now) >= LAGGING_AFTER_MS
    return F.when(replayed, F.lit("REPLAYED")).when(lagging, F.lit("LAGGING")).otherwise(F.lit("FRESH"))


def is_gap_bucket(bucket_start: Column, last_confirmed_at: Column) -> Column:
    """A histogram bucket from which no data was confirmed."""
    return F.coalesce(bucket_start >= last_confirmed_at, F.lit(False))
