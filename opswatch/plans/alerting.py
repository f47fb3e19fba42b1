"""Alert rules, metric samples and alert evaluation.

A rule document is configuration: a list of dicts in driver memory, bounded by ``MAX_RULES``. It becomes a small
rules DataFrame, which Spark broadcasts by its size; everything else is joined by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.functions.schedules import lateness
from opswatch.functions.status import alert_subject_type, alert_summary, should_notify
from opswatch.functions.timing import age_seconds, instant, number_text, shift
from opswatch.functions.verdicts import DRAIN_WINDOW
from opswatch.operators.latest import latest_per_key, newest_heartbeats, newest_queue_samples
from opswatch.sources.tables import Tables

MAX_RULES = 10_000
RULE_SCHEMA = (
    "id STRING, enabled BOOLEAN, priority INT, source STRING, annotation_type STRING, metric STRING,"
    " operator STRING, threshold DOUBLE, text_value STRING, alert_type STRING, severity STRING,"
    " scope_type STRING, scope_values ARRAY<STRING>"
)


def annotation_rule(rule_id: str, kind: str, severity: str, **more) -> dict:
    return {"id": rule_id, "source": "ANNOTATION", "annotation_type": kind, "alert_type": kind, "severity": severity, **more}


def metric_rule(rule_id: str, metric: str, operator: str, limit, alert_type: str, severity: str, **more) -> dict:
    value = {"text_value": limit} if isinstance(limit, str) else {"threshold": float(limit)}
    return {
        "id": rule_id, "source": "METRIC", "metric": metric, "operator": operator, "alert_type": alert_type,
        "severity": severity, **value, **more,
    }


# The default rule set, version 1.
DEFAULT_RULES_VERSION = 1
DEFAULT_RULES = [
    annotation_rule("run-stuck-default", "RUN_STUCK", "CRITICAL"),
    annotation_rule("run-lost-default", "RUN_LOST", "CRITICAL"),
    annotation_rule("run-duplicate-default", "RUN_DUPLICATE_SUSPECTED", "WARNING"),
    annotation_rule("schedule-missed-default", "SCHEDULE_MISSED", "CRITICAL"),
    metric_rule("queue-backlog-default", "queue.pending_count", "GT", 20, "QUEUE_BACKLOG", "WARNING"),
    metric_rule("worker-offline-default", "worker.heartbeat_age", "GT", 60, "WORKER_OFFLINE", "CRITICAL"),
    metric_rule("queue-no-consumer-default", "queue.consumer_count", "EQ", "0", "QUEUE_NO_CONSUMER", "CRITICAL"),
    metric_rule("queue-age-high-default", "queue.oldest_age", "GT", 300, "QUEUE_AGE_HIGH", "WARNING"),
    metric_rule(
        "pii-policy-violated", "pii.policy_action", "EQ", "BLOCK", "PII_POLICY_VIOLATED", "CRITICAL",
        scope_type="PII_CATEGORY", scope_values=["SSN", "CreditCard"],
    ),
    metric_rule("run-failed-default", "run.failed_age", "LTE", 900, "RUN_FAILED", "WARNING"),
    metric_rule("run-retry-exhausted-default", "run.retries_exhausted_age", "LTE", 900, "RUN_RETRY_EXHAUSTED", "CRITICAL"),
    metric_rule("run-timeout-default", "run.timed_out_age", "LTE", 900, "RUN_TIMEOUT", "WARNING"),
    metric_rule("pii-scan-failed-default", "pii.scan_failed_age", "LTE", 900, "PII_SCAN_FAILED", "WARNING"),
    metric_rule("schedule-delayed-default", "schedule.creation_lateness", "GT", 30, "SCHEDULE_DELAYED", "WARNING"),
    metric_rule("monitoring-gap-default", "monitoring.status", "NEQ", "COMPLETE", "MONITORING_GAP", "WARNING"),
    metric_rule("worker-capacity-high-default", "worker.capacity_used", "GT", 90, "WORKER_CAPACITY_HIGH", "WARNING", enabled=False),
    metric_rule("pii-detected-default", "pii.policy_action", "NEQ", "BLOCK", "PII_DETECTED", "INFO", enabled=False),
]


def rules_frame(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """Rules as a DataFrame; absent fields take their neutral value."""
    rules = DEFAULT_RULES if rules is None else rules
    if len(rules) > MAX_RULES:
        raise ValueError(f"a rule set holds at most {MAX_RULES} rules, got {len(rules)}")
    neutral = {"enabled": True, "priority": 0, "scope_type": "GLOBAL", "scope_values": []}
    names = [field.split()[0] for field in RULE_SCHEMA.split(", ")]
    rows = [tuple({**neutral, **r}.get(n) for n in names) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def best_annotation_rule(rules: DataFrame) -> DataFrame:
    """The rule that answers each annotation type: highest priority, then smallest id."""
    usable = rules.filter(F.col("enabled") & (F.col("source") == "ANNOTATION"))
    best = F.min_by(F.struct("id", "alert_type", "severity"), F.struct(-F.col("priority"), F.col("id")))
    return usable.groupBy(F.col("annotation_type").alias("type")).agg(best.alias("rule"))


# --- metric samples ---

MetricResolver = Callable[[Tables, object], DataFrame]


@dataclass(frozen=True)
class OfFamily:
    """A metric read from the same rows as the other metrics of its family: whichever are wanted, one pass gives them all."""

    family: Callable[[Tables, object, list[str]], DataFrame]
    metric: str

    def __call__(self, tables: Tables, now) -> DataFrame:
        return self.family(tables, now, [self.metric])


def sample(metric: str | Column, subject_type: str, subject: Column, numeric: Column, evidence: list, text: Column | None = None, scope: Column | None = None) -> list[Column]:
    numeric = numeric.cast("double")
    return [
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
        F.lit(subject_type).alias("subject_type"),
        subject.cast("string").alias("subject_id"),
        (F.lit("") if scope is None else scope).alias("scope_value"),
        numeric.alias("numeric"),
        (number_text(numeric) if text is None else text).alias("text"),
        F.to_json(F.struct(*evidence)).alias("evidence"),
    ]


def samples_of_row(found: list[tuple[Column, list[Column]]]) -> Column:
    """One row for each sample of a source row whose condition holds."""
    return F.inline(F.array_compact(F.array(*[F.when(holds, F.struct(*columns)) for holds, columns in found])))


def recent(df: DataFrame, column: str, now, seconds: float) -> DataFrame:
    return df.filter(F.col(column) >= shift(now, -seconds))


def worker_metrics(tables: Tables, now, wanted: list[str]) -> DataFrame:
    """Newest heartbeat per worker in the last hour: its age, unless that instance stopped or drains, and its used capacity."""
    newest = newest_heartbeats(recent(tables.heartbeats, "occurred_at", now, 3600))
    age, used = age_seconds(F.col("occurred_at"), now), F.col("running_attempts") / F.col("capacity") * 100
    found = []
    if "worker.heartbeat_age" in wanted:
        quiet = tables.workers.filter(F.col("stopped_at").isNotNull() | (F.col("draining_at") > shift(now, -DRAIN_WINDOW)))
        newest = newest.join(quiet.select("instance_id", F.lit(True).alias("quiet")).distinct(), "instance_id", "left")
        evidence = [age.alias("age_seconds"), "capacity", "instance_id", "occurred_at", "running_attempts"]
        found.append((F.col("quiet").isNull(), sample("worker.heartbeat_age", "WORKER", F.col("worker_id"), age, evidence)))
    if "worker.capacity_used" in wanted:
        evidence = ["capacity", used.alias("capacity_used_percent"), "instance_id", "occurred_at", "running_attempts"]
        found.append((F.col("capacity") > 0, sample("worker.capacity_used", "WORKER", F.col("worker_id"), used, evidence)))
    return newest.select(samples_of_row(found))


QUEUE_COLUMNS = {
    "queue.oldest_age": "oldest_pending_age_seconds",
    "queue.pending_count": "pending_count",
    "queue.consumer_count": "consumer_count",
}


def queue_metrics(tables: Tables, now, wanted: list[str]) -> DataFrame:
    """Newest sample per queue in the last hour, a column of it for each metric."""
    newest = newest_queue_samples(recent(tables.queue_samples, "sampled_at", now, 3600))
    evidence = ["consumer_count", "oldest_pending_age_seconds", "pending_count", "sampled_at", "stream_length"]
    found = [(F.lit(True), sample(m, "QUEUE", F.col("queue_name"), F.col(QUEUE_COLUMNS[m]), evidence)) for m in wanted]
    return newest.select(samples_of_row(found))


def monitoring_status(tables: Tables, now) -> DataFrame:
    """Newest sweep health in the last hour; no sample when there is none."""
    newest = (
        recent(tables.monitoring_healths, "sampled_at", now, 3600)
        .orderBy(F.col("sampled_at").desc(), F.col("id").desc())
        .limit(1)
    )
    evidence = ["failed_checks", "sampled_at", "status"]
    return newest.select(
        *sample("monitoring.status", "PLATFORM", F.lit("platform"), F.col("failed_checks"), evidence, F.col("status"))
    )


def pii_policy_action(tables: Tables, now) -> DataFrame:
    found = recent(tables.findings, "created_at", now, 900)
    evidence = [
        "confidence", F.col("created_at").alias("detected_at"), "detector_id", "job_id",
        F.col("type").alias("pii_type"), "policy_action", "source",
    ]
    return found.select(
        *sample(
            "pii.policy_action", "PII_FINDING", F.col("id"), F.col("confidence"), evidence,
            F.col("policy_action"), F.col("type"),
        )
    )


AGED_EVENTS = {
    "run.failed_age": "task.failed",
    "run.retries_exhausted_age": "task.retries_exhausted",
    "run.timed_out_age": "task.timed_out",
    "pii.scan_failed_age": "pii.scan_failed",
}


def ages_of_events(tables: Tables, now, event_types: dict[str, str]) -> DataFrame:
    """Seconds since the newest event of each metric's type per run, within a day; the log is read once."""
    chosen = tables.event_log.filter(F.col("event_type").isin(*event_types.values()))
    columns = ["event_id", "occurred_at", "execution_chain_id"]
    newest = latest_per_key(recent(chosen, "occurred_at", now, 86400), ["job_id", "event_type"], ["occurred_at", "id"], columns)
    age = age_seconds(F.col("occurred_at"), now)
    evidence = [age.alias("age_seconds"), "event_id", "event_type", "execution_chain_id", "occurred_at"]
    found = [(F.col("event_type") == kind, sample(m, "RUN", F.col("job_id"), age, evidence)) for m, kind in event_types.items()]
    return newest.select(samples_of_row(found))


def event_ages(tables: Tables, now, wanted: list[str]) -> DataFrame:
    return ages_of_events(tables, now, {m: AGED_EVENTS[m] for m in wanted})


def event_age(metric: str, event_type: str) -> MetricResolver:
    """A metric of the age of some other type of event."""
    return lambda tables, now: ages_of_events(tables, now, {metric: event_type})


def worst_creation_lateness(tasks: DataFrame, now, window: float = 3600) -> DataFrame:
    """Per schedule, the run created latest after its expected time."""
    known = (F.coalesce("schedule_id", F.lit("")) != "") & (F.col("expected_at") > instant("2000-01-01 00:00:00"))
    late = recent(tasks, "created_at", now, window).filter(known).select(
        "schedule_id",
        "id",
        F.col("job_id").alias("run_id"),
        "expected_at",
        "created_at",
        lateness(F.col("created_at"), F.col("expected_at")).alias("lateness_seconds"),
    )
    worst = late.groupBy("schedule_id").agg(
        F.max_by(
            F.struct("lateness_seconds", "run_id", "expected_at", "created_at"),
            F.struct(F.col("lateness_seconds"), -F.col("id")),
        ).alias("w")
    )
    return worst.select("schedule_id", "w.lateness_seconds", "w.run_id", "w.expected_at", "w.created_at")


def schedule_creation_lateness(tables: Tables, now) -> DataFrame:
    evidence = ["created_at", "expected_at", "lateness_seconds", "run_id"]
    return worst_creation_lateness(tables.tasks, now).select(
        *sample("schedule.creation_lateness", "SCHEDULE", F.col("schedule_id"), F.col("lateness_seconds"), evidence)
    )


RESOLVERS: dict[str, MetricResolver] = {
    **{m: OfFamily(worker_metrics, m) for m in ("worker.heartbeat_age", "worker.capacity_used")},
    **{m: OfFamily(queue_metrics, m) for m in QUEUE_COLUMNS},
    "monitoring.status": monitoring_status,
    "pii.policy_action": pii_policy_action,
    **{m: OfFamily(event_ages, m) for m in AGED_EVENTS},
    "schedule.creation_lateness": schedule_creation_lateness,
}


def metric_samples(
    tables: Tables, now, metrics: list[str] | None = None, resolvers: dict[str, MetricResolver] | None = None
) -> DataFrame:
    """Samples of the wanted metrics, each source read once. Pass ``resolvers`` to add metrics of your own."""
    available = RESOLVERS if resolvers is None else resolvers
    wanted = list(available) if metrics is None else [m for m in metrics if m in available]
    families: dict[Callable, list[str]] = {}
    alone = []
    for name in wanted:
        resolver = available[name]
        if isinstance(resolver, OfFamily):
            families.setdefault(resolver.family, []).append(resolver.metric)
        else:
            alone.append(resolver(tables, now))
    return reduce(DataFrame.unionByName, [family(tables, now, names) for family, names in families.items()] + alone)


# --- rule matching ---


def scope_matches() -> Column:
    """Whether a sample falls in its rule's scope."""
    kind = F.coalesce("scope_type", F.lit(""))
    return (
        F.when(kind.isin("", "GLOBAL"), F.lit(True))
        .when(kind.isin("QUEUE", "SCHEDULE"), F.array_contains("scope_values", F.col("subject_id")))
        .when(kind.isin("JOB_TYPE", "PII_CATEGORY"), F.array_contains("scope_values", F.col("scope_value")))
        .otherwise(F.lit(False))
    )


def condition_matches() -> Column:
    op, x, limit = F.col("operator"), F.col("numeric"), F.col("threshold")
    return F.coalesce(
        F.when(op == "GT", x > limit)
        .when(op == "GTE", x >= limit)
        .when(op == "LT", x < limit)
        .when(op == "LTE", x <= limit)
        .when(op == "EQ", F.col("text") == F.col("text_value"))
        .when(op == "NEQ", F.col("text") != F.col("text_value")),
        F.lit(False),
    )


def metric_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("enabled") & (F.col("source") == "METRIC"))


def breaches(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples joined with each enabled rule of their metric they breach."""
    return samples.join(metric_rules(rules), "metric").filter(scope_matches() & condition_matches())


def unresolved(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status") != "RESOLVED")


def with_alert_id(opened: DataFrame) -> DataFrame:
    """Name each alert by what it is about and when it opened, so that a repeated pass gives the same alerts."""
    about = F.concat_ws("|", "rule_id", "subject_type", "subject_id", "source_annotation_id", F.unix_micros("opened_at").cast("string"))
    return opened.select(F.concat(F.lit("al-"), F.substring(F.sha2(about, 256), 1, 26)).alias("alert_id"), "*")


def open_from_annotations(annotations: DataFrame, rules: DataFrame, alerts: DataFrame, now, version: int) -> DataFrame:
    """New alerts for unresolved annotations that a rule answers and no unresolved alert covers."""
    covered = unresolved(alerts).select(F.col("source_annotation_id").alias("annotation_id"))
    open_ones = annotations.filter(F.col("resolved_at").isNull())
    matched = open_ones.join(best_annotation_rule(rules), "type").join(covered, "annotation_id", "left_anti")
    subject_type = alert_subject_type(F.col("subject_type"))
    opened = matched.select(
        F.col("rule")["alert_type"].alias("alert_type"),
        F.col("rule")["severity"].alias("severity"),
        F.lit("OPEN").alias("status"),
        instant(now).alias("opened_at"),
        subject_type.alias("subject_type"),
        "subject_id",
        F.col("rule")["id"].alias("rule_id"),
        F.lit(version).alias("rule_version"),
        "evidence",
        alert_summary(F.col("type"), subject_type, F.col("subject_id")).alias("summary"),
        F.col("annotation_id").alias("source_annotation_id"),
    )
    return with_alert_id(opened)


def open_from_metrics(samples: DataFrame, rules: DataFrame, alerts: DataFrame, now, version: int) -> DataFrame:
    """New alerts for breaching samples without an unresolved alert of the same rule and subject."""
    covered = unresolved(alerts).select("rule_id", "subject_type", "subject_id")
    hits = breaches(samples, rules).withColumnRenamed("id", "rule_id")
    fresh = hits.join(covered, ["rule_id", "subject_type", "subject_id"], "left_anti")
    numeric = F.concat(F.lit(',"threshold":'), number_text(F.col("threshold")), F.lit("}"))
    textual = F.concat(F.lit(',"threshold":'), F.substr(F.to_json(F.struct(F.col("text_value").alias("v"))), F.lit(6)))
    body = F.col("evidence").substr(F.lit(1), F.length("evidence") - 1)
    evidence = F.concat(
        body, F.lit(',"operator":"'), F.col("operator"), F.lit('"'),
        F.when(F.col("operator").isin("EQ", "NEQ"), textual).otherwise(numeric),
    )
    opened = fresh.select(
        "alert_type",
        "severity",
        F.lit("OPEN").alias("status"),
        instant(now).alias("opened_at"),
        "subject_type",
        "subject_id",
        "rule_id",
        F.lit(version).alias("rule_version"),
        evidence.alias("evidence"),
        alert_summary(F.col("alert_type"), F.col("subject_type"), F.col("subject_id")).alias("summary"),
        F.lit("").alias("source_annotation_id"),
    )
    return with_alert_id(opened)


def resolved_by_annotations(alerts: DataFrame, annotations: DataFrame, now) -> DataFrame:
    """Unresolved alerts whose source annotation is resolved."""
    done = annotations.filter(F.col("resolved_at").isNotNull()).select(F.col("annotation_id").alias("source_annotation_id"))
    still = unresolved(alerts).filter(F.coalesce("source_annotation_id", F.lit("")) != "")
    hit = still.join(done, "source_annotation_id", "left_semi").select(*alerts.columns)
    return hit.withColumn("status", F.lit("RESOLVED")).withColumn("resolved_at", instant(now))


def resolved_by_metrics(alerts: DataFrame, samples: DataFrame, rules: DataFrame, now) -> DataFrame:
    """Unresolved metric alerts whose subject has a sample that no longer breaches.

    No sample, or a rule that is gone or disabled, leaves the alert open.
    """
    metric_alerts = unresolved(alerts).filter(F.coalesce("source_annotation_id", F.lit("")) == "")
    rule = metric_rules(rules).select(
        F.col("id").alias("rule_id"), "metric", "operator", "threshold", "text_value", "scope_type", "scope_values"
    )
    seen = samples.select("metric", "subject_type", "subject_id", "scope_value", "numeric", "text")
    judged = metric_alerts.join(rule, "rule_id").join(seen, ["metric", "subject_type", "subject_id"])
    quiet = judged.filter(~(scope_matches() & condition_matches())).select(*alerts.columns)
    return quiet.withColumn("status", F.lit("RESOLVED")).withColumn("resolved_at", instant(now))


def severity_changes(
    alerts: DataFrame, annotations: DataFrame, samples: DataFrame, rules: DataFrame
) -> DataFrame:
    """Unresolved alerts still raised by their source whose rule now carries another severity."""
    current = unresolved(alerts).select("alert_id", "severity", "subject_type", "subject_id", "rule_id", "source_annotation_id")
    by_rule = breaches(samples, rules).select(
        F.col("id").alias("rule_id"), "subject_type", "subject_id", F.col("severity").alias("new_severity")
    )
    from_metrics = current.join(by_rule, ["rule_id", "subject_type", "subject_id"])
    by_annotation = (
        annotations.filter(F.col("resolved_at").isNull())
        .join(best_annotation_rule(rules), "type")
        .select(F.col("annotation_id").alias("source_annotation_id"), F.col("rule")["severity"].alias("new_severity"))
    )
    from_annotations = current.join(by_annotation, "source_annotation_id")
    out = ("alert_id", "severity", "new_severity")
    return (
        from_metrics.select(*out)
        .unionByName(from_annotations.select(*out))
        .filter(F.col("severity") != F.col("new_severity"))
        .distinct()
    )


def notification_rows(new_alerts: DataFrame, channels: list[tuple[str, str]]) -> DataFrame:
    """A pending notification per alert worth one and per configured (channel, target)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(t).alias("target")) for c, t in channels])
    loud = new_alerts.filter(should_notify(F.col("severity"))).drop("status")
    return loud.select("*", F.explode(pairs).alias("to")).select(
        *[c for c in ("alert_id", "rule_id", "subject_type", "subject_id") if c in new_alerts.columns],
        "to.channel",
        "to.target",
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempt_count"),
    )


def evaluate(tables: Tables, rules: DataFrame, now, version: int = DEFAULT_RULES_VERSION, samples: DataFrame | None = None) -> dict[str, DataFrame]:
    """One alert pass: opened, resolved and re-ranked alerts. Persist ``samples`` to share them across the parts."""
    measured = metric_samples(tables, now) if samples is None else samples
    opened = open_from_annotations(tables.annotations, rules, tables.alerts, now, version).unionByName(
        open_from_metrics(measured, rules, tables.alerts, now, version)
    )
    resolved = resolved_by_annotations(tables.alerts, tables.annotations, now).unionByName(
        resolved_by_metrics(tables.alerts, measured, rules, now)
    )
    return {
        "opened": opened,
        "resolved": resolved,
        "severity_changed": severity_changes(tables.alerts, tables.annotations, measured, rules),
    }
