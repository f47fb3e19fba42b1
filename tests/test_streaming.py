"""Streams over several micro batches give the batch result."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opswatch.operators import sequences as seq
from opswatch.operators.folds import fold_occurrences, fold_runs, summarize_schedules
from opswatch.operators.policy import DEFAULT_POLICY
from opswatch.plans import alerting, monitoring
from opswatch.plans.pii_scan import scan_artifacts
from opswatch.session import SHUFFLE_CLEANUP
from opswatch.sources.sinks import read_keyed, upsert, version_log
from opswatch.sources.tables import raw_tables
from opswatch.sources.views import NOW
from opswatch.streaming import feeds, keyed, projections, sweeps
from opswatch.streaming.sources import drain, file_stream

BASE = datetime(2024, 1, 1)


def split(frame, path, parts: int, order=None):
    """Write rows as several files and read them back as a stream of one file per micro batch."""
    for i, piece in enumerate(frame.randomSplit([1.0] * parts, 5) if order is None else slices(frame, order, parts)):
        piece.coalesce(1).write.mode("append").parquet(path)
        assert i < parts
    return file_stream(frame.sparkSession, path, frame.schema, files_per_trigger=1)


def slices(frame, order, parts):
    rows = frame.orderBy(*order).collect()
    step = -(-len(rows) // parts)
    return [frame.sparkSession.createDataFrame(rows[i : i + step], frame.schema) for i in range(0, len(rows), step)]


def rows(frame):
    return sorted(map(repr, frame.select(*sorted(frame.columns)).collect()))


def result(stream, name, mode="append"):
    return stream.sparkSession.read.schema(stream.schema).parquet(drain(stream, name, mode))


def test_run_projection_with_shuffled_and_repeated_events(spark, sf_dir, tmp_path):
    log = raw_tables(spark, sf_dir).event_log
    messy = log.unionByName(log.filter("id % 4 = 0"))
    stream = split(messy, str(tmp_path / "in"), 4)
    table = str(tmp_path / "out")
    drain(projections.run_projection_stream(stream), "t1", "update", projections.save_changes(table))
    assert rows(read_keyed(spark, table, ["job_id"])) == rows(fold_runs(log))


def test_ledger_and_summary(spark, sf_dir, tmp_path):
    events = raw_tables(spark, sf_dir).occurrence_events
    stream = split(events, str(tmp_path / "in"), 3)
    ledger, summary = str(tmp_path / "ledger"), str(tmp_path / "summary")
    drain(projections.occurrence_stream(stream), "t2", "update", projections.save_ledger(ledger, summary))
    batch = fold_occurrences(events)
    assert rows(read_keyed(spark, ledger, ["schedule_id", "occurrence_id"])) == rows(batch)
    assert rows(read_keyed(spark, summary, ["schedule_id"])) == rows(summarize_schedules(batch))


def sample_events(spark, n=600):
    rng = random.Random(2)
    data = [
        (i, f"e{i}", rng.choice(["task.created", "task.failed", "queue.degraded"]), rng.choice(["j1", "j2"]), rng.choice("ab"), BASE + timedelta(milliseconds=40 * i + rng.randrange(40)))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id long, event_id string, event_type string, job_id string, producer string, occurred_at timestamp")


def test_rate_limit_and_coalescing_across_batches(spark, tmp_path):
    events = sample_events(spark)
    limited = keyed.rate_limited_stream(split(events, str(tmp_path / "a"), 3, ["occurred_at"]), 2.0)
    assert rows(result(limited, "t6")) == rows(seq.rate_limited(events, 2.0))
    critical = F.col("event_type") == "task.failed"
    merged = keyed.coalesced_stream(split(events, str(tmp_path / "b"), 3, ["occurred_at"]), critical)
    assert rows(result(merged, "t5")) == rows(seq.coalesced(events, critical))
    bursts = keyed.burst_stream(split(events, str(tmp_path / "c"), 3, ["occurred_at"]), 1.0)
    assert rows(result(bursts, "t8")) == rows(seq.burst_signals(events, 1.0))


def test_transitions_across_batches(spark, tmp_path):
    rng = random.Random(9)
    samples = spark.createDataFrame([(i, rng.choice("xyz"), BASE + timedelta(minutes=7 * i), rng.randrange(3)) for i in range(300)], "id long, queue string, at timestamp, n int")
    judged = samples.withColumn("health", F.when(F.col("n") > 0, "HEALTHY").otherwise("DEGRADED"))
    moved = keyed.changes_stream(split(judged, str(tmp_path / "a"), 4, ["at"]), ["queue"], "at", "id", "health")
    assert rows(result(moved, "t7")) == rows(seq.transitions(judged, ["queue"], "at", "id", "health"))
    zero = keyed.zero_crossing_stream(split(samples, str(tmp_path / "b"), 4, ["at"]), ["queue"], "at", "id", "n")
    assert rows(result(zero, "t7z")) == rows(seq.zero_crossings(samples, ["queue"], "at", "id", "n").drop("previous"))


def test_feed_drops_repeated_event_ids(spark, tmp_path):
    events = sample_events(spark, 90).withColumn("execution_chain_id", F.lit(""))
    twice = events.unionByName(events)
    shown = feeds.feed_stream(split(twice, str(tmp_path / "in"), 2, ["occurred_at"]), ["run:j1"], [])
    got = result(shown, "t4")
    expected = events.filter("job_id = 'j1' AND event_type LIKE 'task.%'")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in expected.collect())


def test_artifact_stream(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"call 555-123-{i:04d}" if i % 2 else "nothing") for i in range(40)], "id long, body string")
    columns = ("id", "scan_status", "finding_count", "sanitized_body")
    scanned = feeds.artifact_stream(split(frame, str(tmp_path / "in"), 2), DEFAULT_POLICY, "JOB_RESULT").select(*columns)
    assert rows(result(scanned, "t12")) == rows(scan_artifacts(frame, DEFAULT_POLICY, "JOB_RESULT").select(*columns))


def test_repeated_alert_sweep_opens_nothing_twice(spark, sf_dir, tmp_path):
    tables = raw_tables(spark, sf_dir)
    target = str(tmp_path / "alerts")
    sweep = sweeps.alert_sweep(lambda now: tables, alerting.rules_frame(spark), lambda batch: NOW, target, channels=[("pager", "on-call")])
    states = []
    for batch_id in (0, 0, 1):
        sweep(spark.range(1), batch_id)
        states.append([rows(read_keyed(spark, f"{target}/{name}", [key])) for name, key in (("alerts", "alert_id"), ("notifications", "notification_id"))])
    assert states[0][0] and states[0] == states[1] == states[2]
    opened = {r.version: r["count"] for r in spark.read.parquet(f"{target}/opened").groupBy("version").count().collect()}
    assert opened.get(0) and not opened.get(1)


def test_failing_check_is_named_and_stops_nothing(spark, sf_dir, tmp_path):
    tables = raw_tables(spark, sf_dir)
    target = str(tmp_path / "monitoring")

    def broken(tables, now):
        raise ValueError("no connection\nat line 3")

    sweep = sweeps.monitoring_sweep(lambda now: tables, lambda batch: NOW, target, checks={"broken": broken})
    sweep(spark.range(1), 0)
    sweep(spark.range(1), 1)
    failed = spark.read.parquet(f"{target}/check_failures").orderBy("version").drop("_gone").collect()
    assert [tuple(r) for r in failed] == [("broken", "ValueError", "no connection", 0), ("broken", "ValueError", "no connection", 1)]
    health = spark.read.parquet(f"{target}/monitoring_healths").collect()
    assert {(r.failed_checks, r.status) for r in health} == {(1, "PARTIAL")}
    opened = {r.version: r["count"] for r in spark.read.parquet(f"{target}/opened").groupBy("version").count().collect()}
    assert opened.get(0) and not opened.get(1)
    assert spark.read.parquet(f"{target}/transitions").count() == 0


def counting(frame, column):
    """``frame`` and the number of its rows whose ``column`` was computed so far."""
    seen = frame.sparkSession.sparkContext.accumulator(0)

    def same(value):
        seen.add(1)
        return value

    return frame.withColumn(column, F.udf(same, frame.schema[column].dataType).asNondeterministic()(column)), seen


def test_sweeps_read_attempts_events_and_annotations_once(spark, sf_dir, tmp_path):
    tables = raw_tables(spark, sf_dir)
    attempts, of_attempts = counting(tables.attempts, "status")
    events, of_events = counting(tables.event_log, "event_type")
    counted = tables.with_tables(attempts=attempts, event_log=events)
    sweeps.monitoring_sweep(lambda now: counted, lambda batch: NOW, str(tmp_path / "monitoring"))(spark.range(1), 0)
    assert (of_attempts.value, of_events.value) == (attempts.count(), tables.event_log.count())
    annotations, of_annotations = counting(tables.annotations, "subject_id")
    sweep = sweeps.alert_sweep(lambda now: tables.with_tables(annotations=annotations), alerting.rules_frame(spark), lambda batch: NOW, str(tmp_path / "alerts"))
    sweep(spark.range(1), 0)
    assert of_annotations.value == tables.annotations.count()


def shuffle_bytes(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


def test_monitoring_sweep_leaves_no_shuffle_files_and_nothing_cached(spark, sf_dir, tmp_path):
    """The folds go to storage, so neither they nor the checks hold shuffle files until the driver collects its garbage."""
    tables = raw_tables(spark, sf_dir)
    before, cached = shuffle_bytes(spark), spark.sparkContext._jsc.getPersistentRDDs().size()
    most = []

    def look(tables, now):
        most.append((shuffle_bytes(spark), spark.sparkContext._jsc.getPersistentRDDs().size()))
        return tables.attempts.groupBy("job_id").count()

    sweep = sweeps.monitoring_sweep(lambda now: tables, lambda batch: NOW, str(tmp_path / "monitoring"), checks={"look": look})
    sweep(spark.range(1), 0)
    until = time.time() + 30
    while shuffle_bytes(spark) > before and time.time() < until:
        time.sleep(0.5)  # files are removed beside the next query
    assert shuffle_bytes(spark) <= before and most[0][1] <= cached
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert spark.read.parquet(str(tmp_path / "monitoring" / "look")).count() == tables.attempts.select("job_id").distinct().count()


def test_sweeps_share_attempts_only_when_told_and_see_annotations_once(spark, sf_dir, tmp_path):
    tables = raw_tables(spark, sf_dir)
    left = {}
    for same in (False, True):
        attempts, seen = counting(tables.attempts, "status")
        annotations, noted = counting(tables.annotations, "evidence")
        counted = tables.with_tables(attempts=attempts, annotations=annotations)
        target = str(tmp_path / f"same-{same}")
        sweep = sweeps.monitoring_sweep(lambda now, t=counted: t, lambda batch: NOW, target, same_attempts=same)
        for batch_id in (0, 1):
            sweep(spark.range(1), batch_id)
        assert seen.value == attempts.count() * (1 if same else 2)
        assert noted.value <= 2 * tables.annotations.count()
        left[same] = [rows(spark.read.parquet(f"{target}/{name}")) for name in ("run_counts", "annotations", "opened", "resolved")]
    assert left[False] == left[True] and all(left[True][:3])


def test_a_sweep_sees_new_attempts(spark, sf_dir, tmp_path):
    """Unless told otherwise each sweep folds the attempts anew, and replaces the fold of the sweep before."""
    tables = raw_tables(spark, sf_dir)
    more = iter((tables.attempts.filter("attempt_number < 3"), tables.attempts))
    target = str(tmp_path / "monitoring")
    sweep = sweeps.monitoring_sweep(lambda now: tables.with_tables(attempts=next(more)), lambda batch: NOW, target)
    for batch_id in (0, 1):
        sweep(spark.range(1), batch_id)
    counted = {r.version: r.n for r in spark.read.parquet(f"{target}/run_counts").groupBy("version").agg(F.sum("attempt_count").alias("n")).collect()}
    known = tables.attempts.join(tables.tasks, "job_id", "left_semi")
    assert counted == {0: known.filter("attempt_number < 3").count(), 1: known.count()}


def test_run_attempts_take_newest_and_latest_with_nulls_and_repeats(spark):
    """The newest attempt by time and the latest by number may differ; unset orders come first, and a repeated row counts twice."""
    at = [None, *[BASE + timedelta(hours=h) for h in range(3)]]
    data = [
        ("j1", "a1", "w1", 2, "Failed", at[1]), ("j1", "a2", "w2", 1, "Started", at[3]), ("j1", "a2", "w2", 1, "Started", at[3]),
        ("j2", "b1", "w3", None, "Claimed", at[2]), ("j2", "b2", None, 1, None, None), (None, None, "w4", 1, "Succeeded", at[1]),
    ]
    attempts = spark.createDataFrame(data, "job_id string, attempt_id string, worker_id string, attempt_number int, status string, created_at timestamp")
    got = {r.job_id: (r.attempt_count, r.active_attempt_count, r.worker_id, tuple(r.latest)) for r in monitoring.run_attempts(attempts).collect()}
    assert got == {"j1": (3, 2, "w2", ("a1", "Failed", "w1")), "j2": (2, 1, "w3", ("b2", None, None)), None: (1, 0, "w4", (None, "Succeeded", "w4"))}


def test_ledger_batch_reads_touched_buckets_only(spark, tmp_path):
    """A batch about one schedule reads the folders of its bucket, however many schedules the ledger holds."""
    path = str(tmp_path / "ledger")
    for version in range(3):
        rows_of = spark.createDataFrame([(f"s{k}", f"s{k}:{version}", version) for k in range(200)], "schedule_id string, occurrence_id string, n int")
        upsert(rows_of, path, version, ["schedule_id"])
    one = spark.createDataFrame([("s7",)], "schedule_id string")
    every, some = version_log(spark, path), version_log(spark, path, only=one)

    def files(frame):
        return frame.select(F.input_file_name().alias("f")).distinct().count()

    assert files(every) > 100 and files(some) == 3
    held = read_keyed(spark, path, ["schedule_id", "occurrence_id"], only=one).filter("schedule_id = 's7'")
    assert sorted(r.n for r in held.collect()) == [0, 1, 2]


def test_late_critical_events_are_never_lost(spark, tmp_path):
    """Files arrive newest first, hours apart: ordinary late events fall behind the watermark, critical ones pass."""
    data = [(10 * h + k, f"e{h}{k}", kind, "j1", "a", BASE + timedelta(hours=h, minutes=k)) for h in (30, 20, 1) for k, kind in enumerate(["task.failed", "task.created", "task.failed"])]
    events = spark.createDataFrame(data, "id long, event_id string, event_type string, job_id string, producer string, occurred_at timestamp")
    for h in (30, 20, 1):
        events.filter(f"id >= {10 * h} AND id < {10 * h + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    got = result(keyed.coalesced_stream(stream, F.col("event_type") == "task.failed", 3600), "late").collect()
    assert sorted(r.id for r in got if r.event_type == "task.failed") == [10, 12, 200, 202, 300, 302]


def test_spaced_keys_share_groups_and_rows_without_time_are_left_out(spark, tmp_path):
    """Many keys meet in few groups, with a state of their own each, and a row without a time stops nothing."""
    events = spark.range(3000).selectExpr("id", "concat('k', id % 700) AS k", "if(id % 701 = 700, null, timestamp_seconds(1000000 + id)) AS at")
    kept = keyed.spaced_stream(split(events, str(tmp_path / "in"), 2, ["id"]), ["k"], "at", "id", 1000.0)
    assert "_slot" in kept._jdf.queryExecution().logical().toString()
    assert rows(result(kept, "spaced")) == rows(seq.spaced(events, ["k"], "at", "id", 1000.0))
