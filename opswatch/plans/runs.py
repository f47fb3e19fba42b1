"""Run pages and run detail: hydration, correlation, counts, metrics, chains, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions.feed import is_run_scoped
from opswatch.functions.status import run_state_name, status_disagrees
from opswatch.functions.timing import seconds_between
from opswatch.operators.blocks import numbered, stored
from opswatch.operators.filters import RUN_SUBJECTS
from opswatch.operators.folds import run_projections
from opswatch.operators.latest import latest_per_key
from opswatch.operators.skew import spread_blank
from opswatch.sources.sinks import append_batch
from opswatch.sources.tables import Tables

COUNT_COLUMNS = (
    "attempt_count", "latest_attempt_id", "latest_attempt_status", "latest_worker_id", "pii_finding_count",
    "active_annotation_count", "open_alert_count",
)


def zero_if_missing(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).alias(name)


# --- correlation of new events ---


def fill_correlation(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Events with their correlation fields filled from the run they are about, or from their own subject.

    Run-scoped events take chain, parent, retry index and trace from the run; a chain or trace already on the
    event wins, and schedule, occurrence and queue are filled only where empty.
    """
    run = tasks.select(
        "job_id",
        F.col("execution_chain_id").alias("t_chain"),
        F.col("parent_run_id").alias("t_parent"),
        F.col("retry_index").alias("t_retry"),
        F.col("trace_id").alias("t_trace"),
        F.col("schedule_id").alias("t_schedule"),
        F.col("schedule_occurrence_id").alias("t_occurrence"),
        F.col("queue").alias("t_queue"),
    )
    scoped = F.col("run_scoped")
    kind, subject = F.col("event_type"), F.col("job_id")
    keyed = events.withColumn("run_scoped", is_run_scoped(subject, kind)).withColumn(
        "_run", spread_blank(F.when(F.col("run_scoped"), subject), F.col("event_id"))
    )
    joined = keyed.join(run.withColumnRenamed("job_id", "_run"), "_run", "left")

    def given(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    def from_subject(name: str, prefix: str) -> Column:
        return F.when(~scoped & kind.startswith(prefix), F.coalesce(given(name), subject)).otherwise(given(name))

    filled = {
        "execution_chain_id": F.coalesce(given("execution_chain_id"), F.col("t_chain"), F.lit("")),
        "correlation_id": F.coalesce(F.col("t_chain"), F.lit("")),
        "parent_run_id": F.coalesce(F.col("t_parent"), F.lit("")),
        "retry_index": F.coalesce(F.col("t_retry"), F.lit(0)),
        "trace_id": F.coalesce(given("trace_id"), F.col("t_trace"), F.lit("")),
        "schedule_id": F.coalesce(from_subject("schedule_id", "schedule."), F.col("t_schedule"), F.lit("")),
        "schedule_occurrence_id": F.coalesce(given("schedule_occurrence_id"), F.col("t_occurrence"), F.lit("")),
        "queue_name": F.coalesce(from_subject("queue_name", "queue."), F.col("t_queue"), F.lit("")),
        "worker_id": F.coalesce(from_subject("worker_id", "worker."), F.lit("")),
    }
    kept = [c for c in events.columns if c not in filled]
    return joined.select(*kept, "run_scoped", *[c.alias(n) for n, c in filled.items()])


# --- counts and projections ---


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Per run: number of attempts and the one with the highest number."""
    newest = F.max_by(
        F.struct("attempt_id", "status", "worker_id", "failure_category", "started_at", "finished_at"),
        F.struct("attempt_number", "attempt_id"),
    )
    return attempts.groupBy("job_id").agg(F.count(F.lit(1)).alias("attempt_count"), newest.alias("latest"))


def run_counts(tables: Tables, runs: DataFrame) -> DataFrame:
    """Source counts of each run, recomputed from their tables rather than incremented."""
    attempts = tables.derived("attempt_summary", lambda t: attempt_summary(t.attempts)).select(
        "job_id",
        "attempt_count",
        F.col("latest.attempt_id").alias("latest_attempt_id"),
        F.col("latest.status").alias("latest_attempt_status"),
        F.col("latest.worker_id").alias("latest_worker_id"),
    )
    findings = tables.findings.groupBy("job_id").agg(F.count(F.lit(1)).alias("pii_finding_count"))
    about_run = F.col("subject_type").isin(*RUN_SUBJECTS)
    annotations = (
        tables.annotations.filter(about_run & F.col("resolved_at").isNull())
        .groupBy(F.col("subject_id").alias("job_id"))
        .agg(F.count(F.lit(1)).alias("active_annotation_count"))
    )
    alerts = (
        tables.alerts.filter(about_run & (F.col("status") == "OPEN"))
        .groupBy(F.col("subject_id").alias("job_id"))
        .agg(F.count(F.lit(1)).alias("open_alert_count"))
    )
    joined = runs.select("job_id")
    for part in (attempts, findings, annotations, alerts):
        joined = joined.join(part, "job_id", "left")
    return joined.select(
        "job_id",
        zero_if_missing("attempt_count"),
        "latest_attempt_id",
        "latest_attempt_status",
        "latest_worker_id",
        zero_if_missing("pii_finding_count"),
        zero_if_missing("active_annotation_count"),
        zero_if_missing("open_alert_count"),
    )


def full_run_projections(tables: Tables) -> DataFrame:
    """Projection of every run from its events, with its recomputed counts."""
    folded = run_projections(tables.event_log, tables.tasks)
    every = tables.tasks.select("job_id", "status").join(folded, "job_id", "left")
    status = F.coalesce("current_status", "status").alias("current_status")
    no = F.lit(False)
    projected = every.select(
        "job_id",
        status,
        "queued_at",
        "started_at",
        "completed_at",
        "last_event_at",
        F.coalesce("recovery_started", no).alias("recovery_started"),
        F.coalesce("was_reclaimed", no).alias("was_reclaimed"),
        F.coalesce("contradicted", no).alias("contradicted"),
        F.coalesce("contradiction_note", F.lit("")).alias("contradiction_note"),
    )
    return projected.join(run_counts(tables, tables.tasks), "job_id")


def append_events(events: DataFrame, tasks: DataFrame, path: str, writer: str, batch: int) -> None:
    """Append events with their correlation filled; a batch that is written again leaves no second row."""
    append_batch(fill_correlation(events, tasks), path, writer, batch)


# --- reconciliation ---


def reconcile(wanted: DataFrame, stored: DataFrame, key: str, compared: list[str], tolerances: dict[str, float] | None = None) -> DataFrame:
    """Class of every key: MISSING (not stored), JUNK (stored but not wanted), WRONG (differs) or OK."""
    tolerances = tolerances or {}
    left = wanted.select(key, F.lit(True).alias("_wanted"), *[F.col(c).alias(f"w_{c}") for c in compared])
    right = stored.select(key, F.lit(True).alias("_stored"), *[F.col(c).alias(f"s_{c}") for c in compared])
    same: Column = F.lit(True)
    for c in compared:
        w, s = F.col(f"w_{c}"), F.col(f"s_{c}")
        if c in tolerances:
            close = F.coalesce(F.abs(w - s) < tolerances[c], F.lit(False))
            same = same & ((w.isNull() & s.isNull()) | close)
        else:
            same = same & w.eqNullSafe(s)
    verdict = (
        F.when(F.col("_stored").isNull(), F.lit("MISSING"))
        .when(F.col("_wanted").isNull(), F.lit("JUNK"))
        .when(same, F.lit("OK"))
        .otherwise(F.lit("WRONG"))
    )
    return left.join(right, key, "full_outer").select(key, verdict.alias("class"))


PROJECTION_COMPARED = [
    "current_status", "queued_at", "started_at", "completed_at", "last_event_at", "recovery_started", "was_reclaimed",
    "contradicted", "contradiction_note", *COUNT_COLUMNS,
]


def reconcile_runs(tables: Tables, stored: DataFrame) -> DataFrame:
    return reconcile(full_run_projections(tables), stored, "job_id", PROJECTION_COMPARED)


LEDGER_COMPARED = ["outcome", "run_id", "expected_at", "creation_lateness_seconds", "start_lateness_seconds"]


def reconcile_occurrences(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    close = {"creation_lateness_seconds": 0.001, "start_lateness_seconds": 0.001}
    return reconcile(ledger, stored, "occurrence_id", LEDGER_COMPARED, close)


SUMMARY_COMPARED = [
    "last_expected_at", "last_occurrence_id", "last_run_id", "last_creation_lateness_seconds",
    "last_start_lateness_seconds", "occurrences_created", "occurrences_skipped", "last_skipped_at", "last_event_at",
]


def reconcile_schedules(summary: DataFrame, stored: DataFrame) -> DataFrame:
    close = {"last_creation_lateness_seconds": 0.001, "last_start_lateness_seconds": 0.001}
    return reconcile(summary, stored, "schedule_id", SUMMARY_COMPARED, close)


def reconcile_report(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def orphans(projections: DataFrame, tasks: DataFrame) -> DataFrame:
    """Projections that belong to no run."""
    return projections.join(tasks.select("job_id"), "job_id", "left_anti")


# --- hydration ---


def hydrate_runs(tables: Tables, runs: DataFrame, page: bool = False) -> DataFrame:
    """Runs with projection, newest attempt, chain findings, open alerts, annotations and schedule.

    Every child table is aggregated to one row per run (or chain) before the join. For a page the children are
    first cut to the page's runs, so only those rows are aggregated.
    """

    def related(df: DataFrame, key: str = "job_id") -> DataFrame:
        return df.join(runs.select(F.col("job_id").alias(key)), key, "left_semi") if page else df

    def counted(df: DataFrame, name: str) -> DataFrame:
        return related(df, "subject_id").groupBy(F.col("subject_id").alias("job_id")).agg(F.count(F.lit(1)).alias(name))

    attempts = attempt_summary(related(tables.attempts))
    projected = related(tables.run_projections).select(
        "job_id", "current_status", "queued_at", "started_at", "completed_at", "last_event_at", "was_reclaimed"
    )
    alerts = counted(
        tables.alerts.filter((F.col("subject_type") == "RUN") & (F.col("status") == "OPEN")), "active_alert_count"
    )
    annotations = counted(tables.annotations.filter(F.col("subject_type").isin(*RUN_SUBJECTS)), "annotation_count")
    findings = findings_per_chain(tables, runs if page else None)
    schedules = tables.schedule_definitions.select(
        F.col("schedule_id").alias("_schedule"),
        F.col("enabled").alias("schedule_enabled"),
        F.col("next_run_at").alias("schedule_next_run_at"),
    )
    keyed = runs.withColumn("_schedule", spread_blank(F.col("schedule_id"), F.col("id"))).withColumn(
        "_chain", spread_blank(F.col("execution_chain_id"), F.col("id"))
    )
    joined = (
        keyed.join(projected, "job_id", "left")
        .join(attempts, "job_id", "left")
        .join(alerts, "job_id", "left")
        .join(annotations, "job_id", "left")
        .join(findings.withColumnRenamed("execution_chain_id", "_chain"), "_chain", "left")
        .join(schedules, "_schedule", "left")
    )
    latest = F.col("latest")
    return joined.select(
        "id",
        "job_id",
        "execution_chain_id",
        "status",
        "retry_index",
        "created_at",
        "current_status",
        "queued_at",
        "started_at",
        "completed_at",
        "last_event_at",
        F.coalesce("was_reclaimed", F.lit(False)).alias("was_reclaimed"),
        F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"),
        latest["worker_id"].alias("latest_worker"),
        seconds_between(latest["finished_at"], latest["started_at"]).alias("attempt_duration_s"),
        seconds_between(F.col("completed_at"), F.col("started_at")).alias("run_duration_s"),
        F.coalesce("chain_finding_count", F.lit(0)).alias("chain_finding_count"),
        F.coalesce("active_alert_count", F.lit(0)).alias("active_alert_count"),
        F.coalesce("annotation_count", F.lit(0)).alias("annotation_count"),
        "schedule_enabled",
        "schedule_next_run_at",
        run_state_name(F.col("status"), latest["failure_category"], F.col("retry_index")).alias("state"),
        F.coalesce(status_disagrees(F.col("status"), F.col("current_status")), F.lit(False)).alias("status_disagrees"),
        F.octet_length("payload").alias("payload_size_bytes"),
    )


def chain_findings(tables: Tables, runs: DataFrame | None = None) -> DataFrame:
    """Findings with the chain of the run they were found in; findings of runs without a chain are dropped.

    ``runs`` limits the chains. One row per finding: a chain's list is shared by its runs, not copied to each.
    """
    members = tables.tasks.filter(F.coalesce("execution_chain_id", F.lit("")) != "").select("job_id", "execution_chain_id")
    if runs is not None:
        members = members.join(runs.select("execution_chain_id"), "execution_chain_id", "left_semi")
    return tables.findings.join(members, "job_id").select(
        "execution_chain_id", "job_id", F.col("id").alias("finding_id"), "type", "detector_id", "confidence", "source", "index", "policy_action"
    )


def findings_per_chain(tables: Tables, runs: DataFrame | None = None) -> DataFrame:
    return chain_findings(tables, runs).groupBy("execution_chain_id").agg(F.count(F.lit(1)).alias("chain_finding_count"))


def page_findings(tables: Tables, page: DataFrame) -> DataFrame:
    """The chain's findings attached to each run of a page (at most one page of runs)."""
    found = chain_findings(tables, page).withColumnRenamed("job_id", "found_in")
    return page.select("job_id", "execution_chain_id").join(found, "execution_chain_id")


def page_attempts(tables: Tables, page: DataFrame) -> DataFrame:
    """Attempts of the page's runs as rows, in attempt order within a run."""
    return tables.attempts.join(page.select("job_id"), "job_id", "left_semi")


def run_detail(tables: Tables, job_id: str) -> DataFrame:
    """One hydrated run."""
    return hydrate_runs(tables, tables.tasks.filter(F.col("job_id") == job_id), page=True)


#: nested lists of a run: fields of an item, and what the items are ordered by
ITEM_LISTS = {
    "attempts": (("attempt_id", "attempt_number", "worker_id", "status", "started_at", "finished_at", "failure_category"), ("attempt_number", "attempt_id")),
    "findings": (("finding_id", "found_in", "type", "detector_id", "confidence", "source", "index", "policy_action"), ("finding_id", "found_in")),
    "open_alerts": (("alert_id", "alert_type", "severity", "opened_at", "summary"), ("opened_at", "alert_id")),
    "annotations": (("annotation_id", "type", "derived_at", "resolved_at", "evidence"), ("derived_at", "annotation_id")),
}
PART_ITEMS = 1000


def page_children(tables: Tables, page: DataFrame) -> dict[str, DataFrame]:
    """The rows behind each nested list, cut to the runs of the page."""
    jobs = page.select("job_id")

    def about_run(df: DataFrame, subjects: tuple[str, ...]) -> DataFrame:
        rows = df.filter(F.col("subject_type").isin(*subjects)).withColumn("job_id", F.col("subject_id"))
        return rows.join(jobs, "job_id", "left_semi")

    return {
        "attempts": page_attempts(tables, page),
        "findings": page_findings(tables, page),
        "open_alerts": about_run(tables.alerts.filter(F.col("status") == "OPEN"), ("RUN",)),
        "annotations": about_run(tables.annotations, tuple(RUN_SUBJECTS)),
    }


def run_items(tables: Tables, page: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """Hydrated runs of a page with attempts, chain findings, open alerts and annotations as nested lists.

    A list of more than ``part_items`` items goes on in further rows of its run, numbered by ``part`` from 0, so no row grows
    with a run. Lists are in the order of ``ITEM_LISTS``; a run without items has one row with empty lists. The children are
    cut to the page first; their numbers come from blocks of rows, whatever share of them one run holds.
    """
    children = page_children(tables, page)
    parts = []
    for name, (fields, (first, second)) in ITEM_LISTS.items():
        rank = F.unix_micros(first) if first.endswith("_at") else F.col(first).cast("bigint")
        nested = [
            (F.struct(*other) if other_name == name else F.lit(None)).alias(other_name)
            for other_name, (other, _) in ITEM_LISTS.items()
        ]
        order = (F.lit(name).alias("_list"), rank.alias("_rank"), F.col(second).cast("string").alias("_second"))
        parts.append(children[name].select("job_id", *order, *nested))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    ordered = numbered(stored(together), ["job_id", "_list"], ["_rank", "_second"], "_number")

    def in_order(name: str) -> Column:
        item = F.when(F.col("_list") == name, F.struct("_number", name))
        return F.transform(F.array_sort(F.collect_list(item)), lambda x: x[name]).alias(name)

    lists = ordered.groupBy("job_id", F.floor(F.col("_number") / part_items).alias("part")).agg(*[in_order(n) for n in ITEM_LISTS])
    joined = hydrate_runs(tables, page, page=True).join(lists, "job_id", "left")
    empty = [F.coalesce(n, F.array().cast(lists.schema[n].dataType)).alias(n) for n in ITEM_LISTS]
    return joined.select(*[c for c in joined.columns if c not in (*ITEM_LISTS, "part")], zero_if_missing("part"), *empty)


def run_detail_items(tables: Tables, job_id: str) -> DataFrame:
    """One hydrated run with its nested lists."""
    return run_items(tables, tables.tasks.filter(F.col("job_id") == job_id))


def item_rows(items: DataFrame, name: str, part_items: int = PART_ITEMS) -> DataFrame:
    """The items of one nested list as rows, with their position in the whole list of the run."""
    rows = items.select("job_id", "part", F.posexplode(name).alias("_at", "item"))
    return rows.select("job_id", (F.col("part") * part_items + F.col("_at")).alias("position"), "item.*")


# --- run and chain metrics ---


def run_metrics(tables: Tables) -> DataFrame:
    """Latency and duration of every finished run, with its chain's retries and total time."""
    chain = tables.tasks.groupBy("execution_chain_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min_by("created_at", F.struct("retry_index", "id")).alias("first_created_at"),
        F.max_by(F.struct("finished_at"), F.struct("retry_index", "id")).alias("last"),
    )
    attempt = latest_per_key(
        tables.attempts, ["job_id"], ["attempt_number", "attempt_id"], ["started_at"]
    ).withColumnRenamed("started_at", "attempt_started_at")
    projected = tables.run_projections.select("job_id", "queued_at")
    finished = tables.tasks.filter(F.col("finished_at").isNotNull())
    joined = finished.join(projected, "job_id").join(attempt, "job_id").join(chain, "execution_chain_id")
    return joined.select(
        "job_id",
        "execution_chain_id",
        "retry_index",
        seconds_between(F.col("queued_at"), F.col("created_at")).alias("queue_latency_s"),
        seconds_between(F.col("finished_at"), F.col("attempt_started_at")).alias("execution_duration_s"),
        seconds_between(F.col("finished_at"), F.col("created_at")).alias("run_duration_s"),
        (F.col("members") - 1).alias("retry_count"),
        seconds_between(F.col("last")["finished_at"], F.col("first_created_at")).alias("chain_total_duration_s"),
        F.coalesce(seconds_between(F.col("created_at"), F.col("expected_at")), F.lit(0.0)).alias("creation_drift_s"),
    )


def chain_events(tables: Tables, chain_id: str | None = None) -> DataFrame:
    """Runs of a chain (or of all chains) with their events as rows; order with ``order_chain``."""
    runs = tables.tasks if chain_id is None else tables.tasks.filter(F.col("execution_chain_id") == chain_id)
    events = tables.event_log.select(
        "job_id", "event_type", "occurred_at", "producer_id", "producer_sequence", F.col("id").alias("event_row")
    )
    return runs.select("execution_chain_id", "retry_index", "job_id", "status").join(events, "job_id", "left")


def order_chain(rows: DataFrame) -> DataFrame:
    return rows.orderBy("execution_chain_id", "retry_index", "job_id", "occurred_at", "producer_id", "producer_sequence", "event_row")


def first_per_idempotency_key(tasks: DataFrame) -> DataFrame:
    """Of runs that share a non-empty idempotency key the earliest stays; runs without a key all stay."""
    blank = F.coalesce("idempotency_key", F.lit("")) == ""
    keyed = tasks.filter(~blank)
    winners = keyed.groupBy("idempotency_key").agg(F.min(F.struct("created_at", "id")).alias("w"))
    kept = winners.select(F.col("w.id").alias("id"))
    return tasks.filter(blank).unionByName(keyed.join(kept, "id", "left_semi"))


def new_idempotent(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming runs whose key is not stored yet, first of each key."""
    known = stored.filter(F.coalesce("idempotency_key", F.lit("")) != "").select("idempotency_key")
    return first_per_idempotency_key(incoming).join(known, "idempotency_key", "left_anti")


