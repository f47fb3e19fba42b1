"""Periodic sweeps as batch functions of a stream.

A sweep reads the tables and what earlier sweeps left, and leaves what the next one needs: its alerts and notifications, its annotations and
the states it saw. All of it is kept in keyed tables whose versions are batch ids. A sweep reads versions below
its own only, and what it opens is named by content and time, so a repeated batch writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.functions.verdicts import sweep_status
from opswatch.plans import alerting, monitoring, runs
from opswatch.session import dropping_shuffles
from opswatch.sources.sinks import VERSION, create_keyed, overlaid, read_keyed, upsert
from opswatch.sources.tables import Tables

SWEEP_TRIGGER = {"processingTime": "20 seconds"}
ALERT_FIELDS = (
    "alert_id STRING, alert_type STRING, severity STRING, status STRING, subject_type STRING, subject_id STRING, rule_id STRING, rule_version INT,"
    " evidence STRING, summary STRING, source_annotation_id STRING, opened_at TIMESTAMP, acknowledged_at TIMESTAMP, resolved_at TIMESTAMP"
)
ANNOTATION_FIELDS = "annotation_id STRING, type STRING, subject_type STRING, subject_id STRING, derived_at TIMESTAMP, resolved_at TIMESTAMP, evidence STRING"
STATE_FIELDS = "kind STRING, subject_id STRING, state STRING"
FAILURE_FIELDS = "check STRING, error STRING, message STRING"


def shaped(df: DataFrame, fields: str) -> DataFrame:
    """The columns of ``fields``; those that ``df`` lacks are NULL."""
    pairs = [f.split() for f in fields.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in pairs])


def one_per(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key in the order of the other columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")


def written(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Store the rows of a batch and read them back, so that they are computed once."""
    with dropping_shuffles(rows.sparkSession):
        upsert(rows, path, batch_id)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{VERSION}={batch_id}")


def kept(rows: DataFrame, path: str) -> DataFrame:
    """Store rows in place of those an earlier sweep left there and read them back: what the checks of a sweep share."""
    with dropping_shuffles(rows.sparkSession):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def held_before(spark: SparkSession, path: str, fields: str, key: list[str], batch_id: int) -> DataFrame:
    """What sweeps before this batch left in a keyed table."""
    create_keyed(spark, path, fields)
    return shaped(read_keyed(spark, path, key, before=batch_id), fields)


def alert_sweep(
    load: Callable[[object], Tables],
    rules: DataFrame | Callable[[object], DataFrame],
    clock: Callable[[DataFrame], object],
    target: str,
    version: int = alerting.DEFAULT_RULES_VERSION,
    channels: list[tuple[str, str]] | None = None,
):
    """Batch function: open, resolve and re-rank alerts from annotations and metric samples, and queue notifications.

    ``clock`` gives the reference time of a batch, for example the newest event time in it; ``load`` the tables at that time; ``rules`` the rules,
    or those in force at that time. Alerts of earlier sweeps stand beside, and in place of, those of ``tables.alerts``.
    ``<target>/alerts`` and ``<target>/notifications`` are keyed tables; ``opened``, ``resolved`` and ``severity_changed`` hold the
    changes of each batch.
    """

    def sweep(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, clock(batch)
        tables = load(now)
        in_force = rules(now) if callable(rules) else rules
        held = held_before(spark, f"{target}/alerts", ALERT_FIELDS, ["alert_id"], batch_id)
        alerts = overlaid(shaped(tables.alerts, ALERT_FIELDS), held, ["alert_id"]).persist(StorageLevel.MEMORY_AND_DISK)
        samples = alerting.metric_samples(tables, now).persist(StorageLevel.MEMORY_AND_DISK)
        noted = tables.annotations.select("annotation_id", "type", "subject_type", "subject_id", "resolved_at", "evidence").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            parts = alerting.evaluate(tables.with_tables(alerts=alerts, annotations=noted), in_force, now, version, samples)
            opened = written(one_per(shaped(parts["opened"], ALERT_FIELDS), "alert_id"), f"{target}/opened", batch_id)
            resolved = written(shaped(parts["resolved"], ALERT_FIELDS).dropDuplicates(["alert_id"]), f"{target}/resolved", batch_id)
            ranked = written(parts["severity_changed"].join(resolved.select("alert_id"), "alert_id", "left_anti"), f"{target}/severity_changed", batch_id)
            moved = alerts.drop("severity").join(ranked.select("alert_id", F.col("new_severity").alias("severity")), "alert_id")
            upsert(opened.unionByName(resolved).unionByName(shaped(moved, ALERT_FIELDS)), f"{target}/alerts", batch_id)
            if channels:
                rows = alerting.notification_rows(opened, channels)
                about = F.sha2(F.concat_ws("|", "alert_id", "channel", "target"), 256)
                upsert(rows.select(F.concat(F.lit("no-"), F.substring(about, 1, 26)).alias("notification_id"), "*"), f"{target}/notifications", batch_id)
        finally:
            noted.unpersist()
            samples.unpersist()
            alerts.unpersist()

    return sweep


def monitoring_sweep(
    load: Callable[[object], Tables],
    clock: Callable[[DataFrame], object],
    target: str,
    checks: dict[str, Callable] | None = None,
    same_attempts: bool = False,
    **thresholds,
):
    """Batch function: derive annotations, resolve cleared ones, report state transitions, refresh run counts, record the sweep's own health.

    ``<target>/annotations`` and ``<target>/states`` are keyed tables that the next sweep reads; ``opened``, ``resolved`` and ``transitions``
    hold the changes of each batch. ``checks`` adds named functions of (tables, now). A check that fails does not stop the others; its
    name, the kind of error and its message are kept in ``check_failures``. Attempts and the events that prove progress are folded to
    one row per run once for all checks; the folds and the annotations in sight are stored in ``<target>/shared`` and replaced by the next sweep.
    ``same_attempts`` says that ``load`` gives the same attempts at every time, so that later sweeps of this function take the first one's fold.
    """
    folds: dict[str, DataFrame] = {}

    def sweep(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, clock(batch)
        tables = load(now)
        held = held_before(spark, f"{target}/annotations", ANNOTATION_FIELDS, ["annotation_id"], batch_id)
        known = held_before(spark, f"{target}/states", STATE_FIELDS, ["kind", "subject_id"], batch_id)
        annotations = overlaid(shaped(tables.annotations, ANNOTATION_FIELDS), held, ["annotation_id"])
        tables = tables.with_tables(annotations=annotations)
        try:
            tables = tables.with_tables(annotations=kept(annotations, f"{target}/shared/annotations"))
            if not (same_attempts and "attempts" in folds):
                folds["attempts"] = kept(monitoring.run_attempts(tables.attempts), f"{target}/shared/attempts")
            folds["progress"] = kept(monitoring.newest_progress(tables.event_log), f"{target}/shared/progress")
            tables = tables.with_tables(**monitoring.shared_tables(folds["attempts"], folds["progress"]))
        except Exception:  # noqa: BLE001 - a check that needs what is missing fails by itself and is reported below
            pass

        def transitions() -> DataFrame:
            changed = written(monitoring.state_changes(monitoring.observed_states(tables, now), known), f"{target}/seen", batch_id)
            upsert(shaped(changed, STATE_FIELDS), f"{target}/states", batch_id)
            event_type = F.concat_ws(".", "kind", "state").alias("event_type")
            return changed.filter("previous IS NOT NULL").select("kind", "subject_id", "previous", "state", event_type, F.lit(now).cast("timestamp").alias("occurred_at"))

        parts: dict[str, Callable[[], DataFrame]] = {
            "opened": lambda: shaped(monitoring.with_annotation_id(monitoring.new_annotations(tables, now, **thresholds)), ANNOTATION_FIELDS),
            "transitions": transitions,
            "components": lambda: monitoring.component_report(tables, now),
            "resolved": lambda: shaped(monitoring.resolved_annotations(tables, now), ANNOTATION_FIELDS),
            "run_counts": lambda: runs.run_counts(tables, tables.tasks),
            **{name: (lambda f=f: f(tables, now)) for name, f in (checks or {}).items()},
        }
        failures, done = [], {}
        for name, part in parts.items():
            try:
                done[name] = written(part(), f"{target}/{name}", batch_id)
            except Exception as error:  # noqa: BLE001 - one failing check must not stop the sweep; it is reported below
                failures.append((name, type(error).__name__, str(error).split("\n")[0]))
        changed = [done[n] for n in ("opened", "resolved") if n in done]
        if changed:
            upsert(changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1]), f"{target}/annotations", batch_id)
        upsert(spark.createDataFrame(failures, FAILURE_FIELDS), f"{target}/check_failures", batch_id)
        failed = len(failures)
        health = spark.range(1).select(
            F.lit(failed).alias("failed_checks"), sweep_status(F.lit(failed), len(parts)).alias("status"), F.lit(now).cast("timestamp").alias("sampled_at")
        )
        upsert(health, f"{target}/monitoring_healths", batch_id)

    return sweep
