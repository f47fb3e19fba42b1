"""Folds of event logs into projections, as plain aggregates.

Every accumulator is a minimum or maximum (of a time, or of the event order key), so partial results combine in
any order. The same expressions serve batch and streaming, late and repeated events change nothing, and no
group of events is ever collected or sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions.feed import is_run_scoped
from opswatch.functions.schedules import expected_from_occurrence_id, lateness, occurrence_id
from opswatch.functions.status import TERMINAL, asserted_status

RECOVERY = "task.recovery_started"
RUN_KEY = "job_id"


def event_order() -> Column:
    """Total order of events: time, producer, producer sequence, id."""
    return F.struct("occurred_at", "producer_id", "producer_sequence", "id")


def order_events(events: DataFrame) -> DataFrame:
    return events.orderBy("occurred_at", "producer_id", "producer_sequence", "id")


# --- run projection ---


def run_events(events: DataFrame) -> DataFrame:
    """Events a run projection is built from: about a run, and not the periodic attempt heartbeat."""
    about_run = is_run_scoped(F.col("job_id"), F.col("event_type"))
    return events.filter(about_run & (F.col("event_type") != "attempt.heartbeat"))


def run_accumulators() -> list[Column]:
    status = asserted_status(F.col("event_type"))
    at, order = F.col("occurred_at"), event_order()
    recovery = F.col("event_type") == RECOVERY
    first = [F.min(F.when(status == s, order)).alias(f"first_{s.lower()}") for s in TERMINAL]
    last = [F.max(F.when(status == s, order)).alias(f"last_{s.lower()}") for s in ("Pending", "Queued", "Running")]
    return [
        F.max(at).alias("last_event_at"),
        F.min(F.when(status == "Queued", at)).alias("queued_at"),
        F.min(F.when(status == "Running", at)).alias("started_at"),
        F.min(F.when(status.isin("Completed", "Failed"), at)).alias("completed_at"),
        F.max(F.when(recovery, order)).alias("last_recovery"),
        *first,
        *last,
    ]


def run_projection_columns() -> list[Column]:
    """Projection columns from the accumulators.

    The first terminal status stays; a later different one is noted. Without a terminal status the run is at the
    highest status seen since its last recovery, which itself puts it back to Queued.
    """
    terminals = F.array_sort(
        F.filter(
            F.array(
                *[
                    F.when(
                        F.col(f"first_{s.lower()}").isNotNull(),
                        F.struct(F.col(f"first_{s.lower()}").alias("order"), F.lit(s).alias("status")),
                    )
                    for s in TERMINAL
                ]
            ),
            lambda x: x.isNotNull(),
        )
    )
    winner = F.try_element_at(terminals, F.lit(1))["status"]
    later = F.slice(terminals, 2, len(TERMINAL))
    notes = F.transform(later, lambda t: F.concat(F.lower(t["status"]), F.lit(" after "), winner))
    recovered = F.col("last_recovery").isNotNull()

    def since_recovery(name: str) -> Column:
        seen = F.col(f"last_{name}")
        return seen.isNotNull() & (~recovered | (seen > F.col("last_recovery")))

    open_status = (
        F.when(since_recovery("running"), F.lit("Running"))
        .when(since_recovery("queued") | recovered, F.lit("Queued"))
        .when(since_recovery("pending"), F.lit("Pending"))
    )
    return [
        F.coalesce(winner, open_status).alias("event_status"),
        "queued_at",
        "started_at",
        "completed_at",
        "last_event_at",
        recovered.alias("recovery_started"),
        recovered.alias("was_reclaimed"),
        (F.size(terminals) > 1).alias("contradicted"),
        F.array_join(notes, "; ").alias("contradiction_note"),
    ]


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per run from its events. Works on a batch and on a stream (update mode)."""
    folded = run_events(events).groupBy(RUN_KEY).agg(*run_accumulators())
    return folded.select(RUN_KEY, *run_projection_columns())


def run_projections(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Projection of every run that has events; the run's own status stands in when no event asserts one."""
    own = tasks.select(RUN_KEY, F.col("status").alias("task_status"))
    joined = fold_runs(events).join(own, RUN_KEY, "left")
    status = F.coalesce("event_status", "task_status", F.lit("")).alias("current_status")
    rest = [c for c in joined.columns if c not in (RUN_KEY, "event_status", "task_status")]
    return joined.select(RUN_KEY, status, *rest)


# --- schedule occurrences ---

DUE, CREATED, SKIPPED = "DUE", "CREATED", "SKIPPED"
OCCURRENCE_KEYS = ("schedule_id", "occurrence_id")


def occurrence_events(events: DataFrame) -> DataFrame:
    """Events the occurrence ledger reads; an attempt start counts for the first run of an occurrence only."""
    ledger = F.col("event_type").isin(
        "schedule.occurrence_due", "schedule.occurrence_run_created", "schedule.occurrence_skipped"
    )
    first_start = (F.col("event_type") == "attempt.started") & (F.col("retry_index") == 0)
    named = (F.coalesce("schedule_id", F.lit("")) != "") & (F.coalesce("schedule_occurrence_id", F.lit("")) != "")
    return events.filter((ledger | first_start) & named).withColumnRenamed("schedule_occurrence_id", "occurrence_id")


def occurrence_accumulators() -> list[Column]:
    kind, at, order = F.col("event_type"), F.col("occurred_at"), event_order()
    created = kind == "schedule.occurrence_run_created"
    started = kind == "attempt.started"
    skipped = kind == "schedule.occurrence_skipped"
    run = F.when((created | started) & (F.coalesce("job_id", F.lit("")) != ""), F.struct(order.alias("order"), F.col("job_id")))
    return [
        F.min(at).alias("recorded_at"),
        F.max(at).alias("last_event_at"),
        F.max(kind == "schedule.occurrence_due").alias("any_due"),
        F.min(F.when(skipped, order)).alias("first_skipped"),
        F.min(F.when(created, order)).alias("first_created"),
        F.min(F.when(started, order)).alias("first_started"),
        F.min(run).alias("first_run"),
    ]


def occurrence_columns() -> list[Column]:
    """Ledger columns: the first decisive event settles the outcome."""
    expected = expected_from_occurrence_id(F.col("occurrence_id"))
    first_created = F.least("first_created", "first_started")
    was_created = first_created.isNotNull() & (F.col("first_skipped").isNull() | (first_created < F.col("first_skipped")))
    outcome = (
        F.when(was_created, F.lit(CREATED))
        .when(F.col("first_skipped").isNotNull(), F.lit(SKIPPED))
        .when(F.col("any_due"), F.lit(DUE))
    )
    return [
        expected.alias("expected_at"),
        outcome.alias("outcome"),
        F.when(was_created, F.col("first_run")["job_id"]).alias("run_id"),
        F.when(was_created, lateness(F.col("first_created")["occurred_at"], expected)).alias("creation_lateness_seconds"),
        F.when(was_created, lateness(F.col("first_started")["occurred_at"], expected)).alias("start_lateness_seconds"),
        "recorded_at",
        "last_event_at",
    ]


def fold_occurrences(events: DataFrame) -> DataFrame:
    """One ledger row per schedule occurrence. Works on a batch and on a stream (update mode)."""
    folded = occurrence_events(events).groupBy(*OCCURRENCE_KEYS).agg(*occurrence_accumulators())
    return folded.select(*OCCURRENCE_KEYS, *occurrence_columns())


def occurrences_from_tasks(tasks: DataFrame, projections: DataFrame) -> DataFrame:
    """What first runs with an expected time say about their occurrence, one row per occurrence."""
    started = projections.select("job_id", "started_at")
    stored_id = F.when(F.coalesce("schedule_occurrence_id", F.lit("")) != "", F.col("schedule_occurrence_id"))
    first_runs = (
        tasks.filter(
            (F.coalesce("schedule_id", F.lit("")) != "") & F.col("expected_at").isNotNull() & (F.col("retry_index") == 0)
        )
        .withColumn("occurrence_id", F.coalesce(stored_id, occurrence_id(F.col("schedule_id"), F.col("expected_at"))))
        .join(started, "job_id", "left")
    )
    run = F.struct("id", "job_id", "expected_at", "created_at", "schedule_id")
    with_start = F.when(F.col("started_at").isNotNull(), F.struct("id", "started_at"))
    return first_runs.groupBy("occurrence_id").agg(F.min(run).alias("t"), F.min(with_start).alias("s"))


def occurrence_ledger(
    events: DataFrame, tasks: DataFrame | None = None, projections: DataFrame | None = None
) -> DataFrame:
    """Ledger from events; with tasks and run projections it is completed by runs the events do not cover.

    A run settles a DUE occurrence and fills the gaps of a CREATED one; a SKIPPED occurrence is left alone.
    """
    ledger = fold_occurrences(events)
    if tasks is None or projections is None:
        return ledger
    joined = ledger.join(occurrences_from_tasks(tasks, projections), "occurrence_id", "full_outer")
    t, known = F.col("t"), F.col("recorded_at").isNotNull()
    expected = F.when(known, F.col("expected_at")).otherwise(t["expected_at"])
    fills = t.isNotNull() & F.coalesce(F.col("outcome") != SKIPPED, F.lit(True))

    def filled(name: str, value: Column) -> Column:
        return F.when(fills, F.coalesce(F.col(name), value)).otherwise(F.col(name)).alias(name)

    return joined.select(
        F.coalesce("schedule_id", t["schedule_id"]).alias("schedule_id"),
        "occurrence_id",
        expected.alias("expected_at"),
        F.when(fills, F.lit(CREATED)).otherwise(F.col("outcome")).alias("outcome"),
        filled("run_id", t["job_id"]),
        filled("creation_lateness_seconds", lateness(t["created_at"], expected)),
        filled("start_lateness_seconds", lateness(F.col("s")["started_at"], expected)),
        F.coalesce("recorded_at", t["created_at"]).alias("recorded_at"),
        F.coalesce("last_event_at", t["created_at"]).alias("last_event_at"),
    )


def summarize_schedules(ledger: DataFrame) -> DataFrame:
    """One row per schedule: counts, last occurrence, last created run and its lateness."""
    created, skipped = F.col("outcome") == CREATED, F.col("outcome") == SKIPPED
    last = F.max(F.struct("expected_at", "occurrence_id"))
    last_run = F.max(
        F.when(
            created,
            F.struct("expected_at", "occurrence_id", "run_id", "creation_lateness_seconds", "start_lateness_seconds"),
        )
    )
    summary = ledger.groupBy("schedule_id").agg(
        last.alias("last"),
        last_run.alias("last_run"),
        F.count_if(created).alias("occurrences_created"),
        F.count_if(skipped).alias("occurrences_skipped"),
        F.max(F.when(skipped, F.col("recorded_at"))).alias("last_skipped_at"),
        F.max("last_event_at").alias("last_event_at"),
    )
    return summary.select(
        "schedule_id",
        F.col("last")["expected_at"].alias("last_expected_at"),
        F.col("last")["occurrence_id"].alias("last_occurrence_id"),
        F.col("last_run")["run_id"].alias("last_run_id"),
        F.col("last_run")["creation_lateness_seconds"].alias("last_creation_lateness_seconds"),
        F.col("last_run")["start_lateness_seconds"].alias("last_start_lateness_seconds"),
        "occurrences_created",
        "occurrences_skipped",
        "last_skipped_at",
        "last_event_at",
    )
