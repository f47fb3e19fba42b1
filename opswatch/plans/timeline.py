"""Investigation timeline: one ordered list of everything that happened to the runs of a chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions.status import attempt_kind
from opswatch.operators.blocks import stored
from opswatch.operators.filters import RUN_SUBJECTS
from opswatch.operators.paging import page
from opswatch.sources.tables import Tables

DETAIL = {
    "attempt_id": "string", "worker_id": "string", "attempt_number": "int", "stream_position": "string", "status": "string",
    "failure_category": "string", "pii_type": "string", "detector_id": "string", "policy_action": "string",
    "severity": "string", "rule_id": "string", "summary": "string", "annotation_type": "string", "evidence": "string",
}
ATTEMPT_STEPS = ("claimed", "started", "finished")
SOURCES = ("EVENT", "ATTEMPT", "PII", "ALERT", "ANNOTATION")


def padded(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.lpad(F.coalesce(p.cast("string"), F.lit("")), 24, "0") for p in parts])


def entry(source: str, at: Column, kind: Column, run: Column, sequence: Column, **detail: Column) -> list[Column]:
    return [
        at.alias("occurred_at"),
        kind.alias("event_type"),
        run.alias("run_id"),
        F.lit(source).alias("source"),
        F.lit(SOURCES.index(source)).alias("source_rank"),
        sequence.alias("sequence"),
        *[detail.get(n, F.lit(None)).cast(t).alias(n) for n, t in DETAIL.items()],
    ]


def steps(df: DataFrame, moments: list[tuple[Column, Column]]) -> DataFrame:
    """Unpivot (event type, time) pairs into rows, leaving out unknown times."""
    pairs = F.array(*[F.struct(F.lit(i).alias("step"), kind.alias("kind"), at.alias("at")) for i, (kind, at) in enumerate(moments)])
    return df.select("*", F.explode(pairs).alias("m")).filter(F.col("m.at").isNotNull())


def event_entries(tables: Tables) -> DataFrame:
    """Events, attempt events enriched with their attempt number; events about no attempt are not joined."""
    numbers = tables.attempts.select(F.col("attempt_id").alias("_attempt"), "attempt_number")
    details = tables.run_event_details
    about = details.filter(F.col("attempt_id") != "").join(numbers, F.col("attempt_id") == F.col("_attempt"), "left").drop("_attempt")
    rest = details.filter(F.col("attempt_id").isNull() | (F.col("attempt_id") == "")).withColumn("attempt_number", F.lit(None).cast(numbers.schema["attempt_number"].dataType))
    events = about.unionByName(rest)
    blank_to_null = F.nullif
    return events.select(
        *entry(
            "EVENT", F.col("occurred_at"), F.col("event_type"), F.col("job_id"),
            F.concat_ws("|", F.col("producer_id"), padded(F.col("producer_sequence")), F.col("event_id")),
            attempt_id=blank_to_null(F.col("attempt_id"), F.lit("")),
            worker_id=F.when(F.col("attempt_id") != "", F.col("worker_id")),
            attempt_number=F.col("attempt_number"),
            stream_position=blank_to_null(F.col("stream_position"), F.lit("")),
        )
    )


def untold_attempts(tables: Tables) -> DataFrame:
    """Attempts with the times of those steps that no event already tells; attempts without such a step are left out."""
    kind = attempt_kind(F.col("event_type"))
    events = tables.run_event_details.filter(F.col("attempt_id") != "").select(F.col("attempt_id").alias("_told"), kind.alias("kind"))
    told = events.filter("kind IS NOT NULL").groupBy("_told").agg(*[F.max(F.col("kind") == k).alias(f"_{k}") for k in ATTEMPT_STEPS])
    joined = tables.attempts.join(told, F.col("attempt_id") == F.col("_told"), "left")
    untold = {f"{k}_at": F.when(~F.coalesce(f"_{k}", F.lit(False)), F.col(f"{k}_at")) for k in ATTEMPT_STEPS}
    return joined.withColumns(untold).filter(F.coalesce(*untold).isNotNull()).drop("_told", *[f"_{k}" for k in ATTEMPT_STEPS])


def attempt_entries(attempts: DataFrame, *more: str) -> DataFrame:
    """One entry for each step of an attempt whose time is known; ``more`` columns come along."""
    each = steps(attempts, [(F.lit(k), F.col(f"{k}_at")) for k in ATTEMPT_STEPS])
    finished = F.col("m.kind") == "finished"
    return each.select(
        *entry(
            "ATTEMPT", F.col("m.at"), F.concat(F.lit("attempt."), F.col("m.kind")), F.col("job_id"),
            padded(F.col("attempt_number"), F.col("attempt_id"), F.col("m.step")),
            attempt_id=F.col("attempt_id"), worker_id=F.col("worker_id"), attempt_number=F.col("attempt_number"),
            status=F.when(finished, F.col("status")), failure_category=F.when(finished, F.col("failure_category")),
        ),
        *more,
    )


def finding_entries(tables: Tables) -> DataFrame:
    return tables.findings.select(
        *entry(
            "PII", F.col("created_at"), F.lit("pii.detected"), F.col("job_id"), padded(F.col("id")),
            pii_type=F.col("type"), detector_id=F.col("detector_id"), policy_action=F.col("policy_action"),
        )
    )


def alert_entries(tables: Tables) -> DataFrame:
    moments = [
        (F.lit("alert.opened"), F.col("opened_at")),
        (F.lit("alert.acknowledged"), F.col("acknowledged_at")),
        (F.lit("alert.resolved"), F.col("resolved_at")),
    ]
    return steps(tables.alerts.filter(F.col("subject_type") == "RUN"), moments).select(
        *entry(
            "ALERT", F.col("m.at"), F.col("m.kind"), F.col("subject_id"), padded(F.col("id"), F.col("m.step")),
            severity=F.col("severity"), rule_id=F.col("rule_id"), summary=F.col("summary"),
        )
    )


def annotation_entries(tables: Tables) -> DataFrame:
    moments = [
        (F.concat(F.lit("annotation."), F.col("type")), F.col("derived_at")),
        (F.lit("annotation.resolved"), F.col("resolved_at")),
    ]
    return steps(tables.annotations.filter(F.col("subject_type").isin(*RUN_SUBJECTS)), moments).select(
        *entry(
            "ANNOTATION", F.col("m.at"), F.col("m.kind"), F.col("subject_id"), padded(F.col("id"), F.col("m.step")),
            annotation_type=F.col("type"), evidence=F.col("evidence"),
        )
    )


SUBJECT = {"run_event_details": "job_id", "attempts": "job_id", "findings": "job_id", "alerts": "subject_id", "annotations": "subject_id"}


def only_about(tables: Tables, runs: DataFrame) -> Tables:
    """Every source of the timeline cut to the given runs by a semi join.

    The runs are stored first: Spark then knows how few they are and sends them to the sources instead of shuffling these.
    """
    runs = stored(runs)
    cut = {
        name: tables[name].join(runs.select(F.col("job_id").alias(key)), key, "left_semi") for name, key in SUBJECT.items()
    }
    return tables.with_tables(tasks=runs, **cut)


def timeline_entries(tables: Tables, can_read_pii: bool = True) -> DataFrame:
    """Entries of every run, with the chain they belong to. Attempts find their run before their steps become rows."""
    parts = [event_entries(tables)]
    if can_read_pii:
        parts.append(finding_entries(tables))
    parts += [alert_entries(tables), annotation_entries(tables)]
    runs = tables.tasks.select(F.col("job_id").alias("run_id"), "execution_chain_id")
    attempts = untold_attempts(tables).join(runs, F.col("job_id") == F.col("run_id"))
    steps_of = attempt_entries(attempts.drop("run_id"), "execution_chain_id")
    return reduce(DataFrame.unionByName, parts).join(runs, "run_id").unionByName(steps_of)


def timeline_order() -> list[Column]:
    return [F.col(c).asc() for c in ("occurred_at", "source_rank", "sequence")]


def ordered(entries: DataFrame, cap: int | None) -> DataFrame:
    found = page(entries, timeline_order(), cap)
    return found.withColumn("truncated", F.lit(False)) if cap is None else found


def chain_timeline(tables: Tables, chain_id: str, can_read_pii: bool = True, cap: int | None = None) -> DataFrame:
    """Entries of a chain in time order; with a ``cap`` the first ones, flagged when there are more."""
    members = tables.tasks.filter(F.col("execution_chain_id") == chain_id)
    return ordered(timeline_entries(only_about(tables, members), can_read_pii), cap)


def run_timeline(tables: Tables, job_id: str, can_read_pii: bool = True, cap: int | None = None) -> DataFrame:
    """Timeline of the chain a run belongs to."""
    own = stored(tables.tasks.filter(F.col("job_id") == job_id).select("execution_chain_id").distinct())
    members = tables.tasks.join(own, "execution_chain_id", "left_semi")
    return ordered(timeline_entries(only_about(tables, members), can_read_pii), cap)
