"""Alert rules, monitoring checks, reconciliation and sinks on literal tables."""

import inspect
from datetime import datetime, timedelta

import pytest

from opswatch.operators.latest import latest_per_key
from opswatch.plans import alerting, monitoring, reports, runs, timeline
from opswatch.plans.maintenance import split_expired
from opswatch.plans.schedules import skipped_occurrences
from opswatch.sources.sinks import append_batch, append_new, compact, read_keyed, rebuild, upsert, version_log
from opswatch.sources.tables import literal_tables, parquet_tables

NOW = datetime(2024, 1, 31)
ALERT = "alert_id string, status string, severity string, subject_type string, subject_id string, rule_id string, source_annotation_id string, resolved_at timestamp"
NOTE = "annotation_id string, type string, subject_type string, subject_id string, derived_at timestamp, resolved_at timestamp, evidence string"
SAMPLE = "metric string, subject_type string, subject_id string, scope_value string, numeric double, text string, evidence string"


def ago(seconds):
    return NOW - timedelta(seconds=seconds)


def test_best_rule_is_highest_priority_then_smallest_id(spark):
    rules = [
        alerting.annotation_rule("b", "RUN_STUCK", "INFO", priority=1),
        alerting.annotation_rule("a", "RUN_STUCK", "WARNING", priority=1),
        alerting.annotation_rule("c", "RUN_STUCK", "CRITICAL", priority=0),
        alerting.annotation_rule("0", "RUN_STUCK", "CRITICAL", priority=9, enabled=False),
    ]
    assert alerting.best_annotation_rule(alerting.rules_frame(spark, rules)).first().rule.id == "a"


@pytest.mark.parametrize(
    "operator, limit, numeric, text, hit",
    [
        ("GT", 20, 20.0, "20", False), ("GT", 20, 21.0, "21", True), ("GTE", 20, 20.0, "20", True), ("LT", 5, 5.0, "5", False), ("LTE", 5, 5.0, "5", True),
        ("EQ", "0", 0.0, "0", True), ("NEQ", "OK", 0.0, "OK", False), ("??", 1, 5.0, "5", False),
    ],
)
def test_conditions(spark, operator, limit, numeric, text, hit):
    rules = alerting.rules_frame(spark, [alerting.metric_rule("r", "m", operator, limit, "A", "INFO")])
    samples = spark.createDataFrame([("m", "QUEUE", "q", "", numeric, text, "{}")], SAMPLE)
    assert (alerting.breaches(samples, rules).count() == 1) is hit


def test_scopes_limit_rules(spark):
    def hits(kind, values):
        rule = alerting.metric_rule("r", "m", "GT", 0, "A", "INFO", scope_type=kind, scope_values=values)
        samples = spark.createDataFrame([("m", "QUEUE", "q1", "SSN", 1.0, "1", "{}"), ("m", "QUEUE", "q2", "Email", 1.0, "1", "{}")], SAMPLE)
        return {r.subject_id for r in alerting.breaches(samples, alerting.rules_frame(spark, [rule])).collect()}

    assert hits("GLOBAL", []) == {"q1", "q2"} and hits("QUEUE", ["q1"]) == {"q1"} and hits("PII_CATEGORY", ["Email"]) == {"q2"} and hits("ODD", ["q1"]) == set()


def test_alert_life_cycle(spark):
    rules = alerting.rules_frame(spark)
    notes = spark.createDataFrame(
        [("n1", "RUN_STUCK", "TASK", "j1", ago(9), None, '{"k":1}'), ("n2", "RUN_LOST", "TASK", "j2", ago(9), ago(1), "{}"), ("n3", "OTHER", "TASK", "j3", ago(9), None, "{}"), ("n4", "RUN_LOST", "TASK", "j4", ago(9), None, "{}")],
        NOTE,
    )
    alerts = spark.createDataFrame(
        [
            ("a2", "OPEN", "CRITICAL", "RUN", "j2", "run-lost-default", "n2", None), ("a4", "ACKNOWLEDGED", "INFO", "RUN", "j4", "run-lost-default", "n4", None),
            ("m1", "OPEN", "WARNING", "QUEUE", "q1", "queue-backlog-default", "", None), ("m2", "OPEN", "WARNING", "QUEUE", "q2", "queue-backlog-default", "", None),
            ("m3", "OPEN", "WARNING", "QUEUE", "gone", "queue-backlog-default", "", None), ("m4", "OPEN", "INFO", "QUEUE", "q2", "no-such-rule", "", None),
        ],
        ALERT,
    )
    samples = spark.createDataFrame(
        [("queue.pending_count", "QUEUE", q, "", n, str(int(n)), '{"pending_count":1}') for q, n in (("q1", 50.0), ("q2", 3.0), ("q3", 21.0))], SAMPLE
    )
    out = alerting.evaluate(literal_tables(annotations=notes, alerts=alerts), rules, NOW, samples=samples)
    opened = {(r.rule_id, r.subject_type, r.subject_id): r for r in out["opened"].collect()}
    assert set(opened) == {("run-stuck-default", "RUN", "j1"), ("queue-backlog-default", "QUEUE", "q3")}
    assert opened[("run-stuck-default", "RUN", "j1")].summary == "RUN_STUCK on RUN j1"
    assert opened[("queue-backlog-default", "QUEUE", "q3")].evidence == '{"pending_count":1,"operator":"GT","threshold":20}'
    resolved = out["resolved"].collect()
    assert {r.alert_id for r in resolved} == {"a2", "m2"} and all(r.status == "RESOLVED" and r.resolved_at == NOW for r in resolved)
    assert [(r.alert_id, r.new_severity) for r in out["severity_changed"].collect()] == [("a4", "CRITICAL")]


def test_notifications_only_for_loud_alerts(spark):
    alerts = spark.createDataFrame([("a", "INFO"), ("b", "WARNING")], "alert_id string, severity string")
    rows = alerting.notification_rows(alerts, [("web", "x"), ("mail", "y")]).collect()
    assert {(r.alert_id, r.channel, r.target) for r in rows} == {("b", "web", "x"), ("b", "mail", "y")}


def test_custom_metric(spark):
    resolvers = {"my.metric": lambda t, now: t.mine}
    mine = spark.createDataFrame([("my.metric", "RUN", "j", "", 1.0, "1", "{}")], SAMPLE)
    assert alerting.metric_samples(literal_tables(mine=mine), NOW, resolvers=resolvers).count() == 1


HEALTH_TABLES = {
    "heartbeats": "id long, worker_id string, instance_id string, occurred_at timestamp, capacity int, running_attempts int",
    "workers": "instance_id string, stopped_at timestamp, draining_at timestamp",
    "queue_samples": "id long, queue_name string, sampled_at timestamp, oldest_pending_age_seconds double, pending_count long, consumer_count long, stream_length long",
    "monitoring_healths": "id long, sampled_at timestamp, failed_checks int, status string",
    "findings": "id long, created_at timestamp, confidence double, detector_id string, job_id string, type string, policy_action string, source string",
    "event_log": "id long, event_id string, job_id string, event_type string, occurred_at timestamp, execution_chain_id string",
    "tasks": "id long, job_id string, schedule_id string, expected_at timestamp, created_at timestamp",
}


def test_each_source_is_read_once_for_all_metrics(spark):
    rows = {
        "heartbeats": [(1, "w", "i", ago(9), 4, 4), (2, "w", "i", ago(5), 4, 1), (3, "idle", "i2", ago(7), 0, 0), (4, "off", "i3", ago(7), 2, 1)],
        "workers": [("i3", ago(3), None), ("i3", ago(2), None), ("i", None, None)],
        "queue_samples": [(1, "q", ago(9), 1.0, 2, 3, 4), (2, "q", ago(9), 5.0, 6, 7, 8)],
        "event_log": [(1, "e1", "j", "task.failed", ago(30), "c"), (2, "e2", "j", "task.failed", ago(20), "c"), (3, "e3", "j", "task.timed_out", ago(10), "c"), (4, "e4", "j", "other", ago(1), "c")],
    }
    tables = literal_tables(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in HEALTH_TABLES.items()})
    samples = alerting.metric_samples(tables, NOW)
    assert samples._jdf.queryExecution().analyzed().collectLeaves().size() == len(HEALTH_TABLES)
    assert {(r.metric, r.subject_id, r.numeric) for r in samples.collect()} == {
        ("worker.heartbeat_age", "w", 5.0), ("worker.heartbeat_age", "idle", 7.0), ("worker.capacity_used", "w", 25.0), ("worker.capacity_used", "off", 50.0),
        ("queue.oldest_age", "q", 5.0), ("queue.pending_count", "q", 6.0), ("queue.consumer_count", "q", 7.0), ("run.failed_age", "j", 20.0), ("run.timed_out_age", "j", 10.0),
    }
    for metric in alerting.RESOLVERS:
        alone = alerting.metric_samples(tables, NOW, [metric]).collect()
        assert sorted(alone) == sorted(r for r in samples.collect() if r.metric == metric)


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError):
        alerting.rules_frame(spark, [{"id": str(i)} for i in range(alerting.MAX_RULES + 1)])


def silent_tables(spark, event_age, beat_age):
    beats = [(1, "w", "i", ago(beat_age))] if beat_age is not None else []
    return literal_tables(
        tasks=spark.createDataFrame([("j", "Running"), ("k", "Completed")], "job_id string, status string"),
        event_log=spark.createDataFrame([("j", "task.started", ago(event_age)), ("j", "attempt.heartbeat", ago(1))], "job_id string, event_type string, occurred_at timestamp"),
        attempts=spark.createDataFrame([("j", "a1", "old", ago(900)), ("j", "a2", "w", ago(800))], "job_id string, attempt_id string, worker_id string, created_at timestamp"),
        heartbeats=spark.createDataFrame(beats, "id long, worker_id string, instance_id string, occurred_at timestamp"),
    )


@pytest.mark.parametrize(
    "event_age, beat_age, stuck, lost",
    [(61, 5, 1, 0), (60, 5, 0, 0), (61, 31, 1, 1), (61, 30, 1, 0), (61, 300, 0, 1), (61, None, 0, 1), (10, None, 0, 0)],
)
def test_stuck_and_lost(spark, event_age, beat_age, stuck, lost):
    tables = silent_tables(spark, event_age, beat_age)
    assert (monitoring.stuck_runs(tables, NOW).count(), monitoring.lost_runs(tables, NOW).count()) == (stuck, lost)


@pytest.mark.parametrize("beat_age, kinds", [(5, {"RUN_STUCK"}), (31, {"RUN_STUCK", "RUN_LOST"}), (300, {"RUN_LOST"}), (None, {"RUN_LOST"})])
def test_new_annotations_look_at_silent_runs_once(spark, beat_age, kinds):
    tables = silent_tables(spark, 61, beat_age)
    tables = literal_tables(
        tasks=tables.tasks, event_log=tables.event_log, attempts=tables.attempts.selectExpr("*", "'Created' AS status"), heartbeats=tables.heartbeats,
        schedule_definitions=spark.createDataFrame([], "schedule_id string, enabled boolean, next_run_at timestamp"), annotations=spark.createDataFrame([], NOTE),
    )
    found = monitoring.new_annotations(tables, NOW)
    assert {r.type for r in found.collect() if r.type != "RUN_DUPLICATE_SUSPECTED"} == kinds
    assert found._jdf.queryExecution().analyzed().collectLeaves().size() == 7


def test_reconcile_classes(spark):
    want = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 3, None), ("d", 4, 1.0)], "k string, n int, x double")
    have = spark.createDataFrame([("b", 2, 1.0005), ("c", 3, None), ("d", 4, 1.5), ("e", 5, 1.0)], "k string, n int, x double")
    got = {r.k: r["class"] for r in runs.reconcile(want, have, "k", ["n", "x"], {"x": 0.001}).collect()}
    assert got == {"a": "MISSING", "b": "OK", "c": "OK", "d": "WRONG", "e": "JUNK"}


def test_latest_row_on_a_hot_key_uses_a_partial_aggregate(spark):
    frame = spark.range(20_000).selectExpr("id", "IF(id % 3 = 0, id % 50, 7) AS k", "id * 7919 % 20011 AS v")
    newest = latest_per_key(frame, ["k"], ["v"])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("max_by") >= 2  # one before, one after the shuffle
    best: dict[int, tuple] = {}
    for r in frame.collect():
        best[r.k] = max(best.get(r.k, (-1, 0)), (r.v, r.id))
    assert {r.k: (r.v, r.id) for r in newest.collect()} == best


def test_blank_keys_are_spread_and_match_nothing(spark):
    from pyspark.sql import functions as F

    from opswatch.operators.skew import spread_blank

    left = spark.createDataFrame([(i, "" if i % 3 else f"k{i}") for i in range(90)], "id long, key string")
    right = spark.createDataFrame([("", 1), ("k3", 2)], "key string, n int")
    joined = left.withColumn("key", spread_blank(F.col("key"), F.col("id"))).join(right, "key", "left")
    assert joined.filter("n IS NOT NULL").count() == 1 and joined.select("key").distinct().count() == 90


def test_expired_rows(spark):
    frame = spark.createDataFrame([(1, ago(10)), (2, ago(5)), (3, None)], "id long, at timestamp")
    kept, removed = split_expired(frame, "at", ago(5))
    assert ({r.id for r in kept.collect()}, {r.id for r in removed.collect()}) == ({2, 3}, {1})


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), path, 0)
    upsert(spark.createDataFrame([("b", 2), ("c", 2)], "k string, n int"), path, 1)
    upsert(spark.createDataFrame([("b", 2), ("c", 2)], "k string, n int"), path, 1)  # a retried write
    state = {("a", 1), ("b", 2), ("c", 2)}
    assert {tuple(r) for r in read_keyed(spark, path, ["k"]).collect()} == state
    compact(spark, path, ["k"], str(tmp_path / "u"))
    assert {tuple(r) for r in read_keyed(spark, str(tmp_path / "u"), ["k"]).collect()} == state


def test_rebuild_writes_differences_only_and_removes_junk(spark, tmp_path):
    kind = "k string, part int, n int, at timestamp"
    for bucket_by in (None, ["k"]):
        path = str(tmp_path / f"r{bucket_by is None}")
        held = [("same", 1, 1, None), ("wrong", 1, 1, ago(5)), ("junk", 1, 1, None), (None, 2, 5, None), (None, 3, 5, None)]
        wanted = spark.createDataFrame([("same", 1, 1, None), ("wrong", 1, 2, None), ("missing", 1, 3, ago(1)), (None, 2, 5, None)], kind)
        upsert(spark.createDataFrame(held, kind), path, 0, bucket_by)
        for version in (1, 1, 2):
            rebuild(wanted, path, ["k", "part"], version, bucket_by)
            assert sorted(map(repr, map(tuple, read_keyed(spark, path, ["k", "part"]).collect()))) == sorted(map(repr, map(tuple, wanted.collect())))
        log = version_log(spark, path)
        assert sorted((r.version, str(r.k), r["_gone"]) for r in log.filter("version > 0").collect()) == [(1, "None", True), (1, "junk", True), (1, "missing", False), (1, "wrong", False)]


def test_batches_appended_again_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, n int")
    for writer, batch in (("w", 0), ("w", 0), ("w", 1), ("x", 0)):
        append_batch(rows.repartition(3), path, writer, batch)
    log = spark.read.parquet(path)
    assert log.count() == 9 and log.select("append_key").distinct().count() == 9
    keys = {r[0] for r in log.filter("writer = 'w' AND batch = 0").select("append_key").collect()}
    append_batch(rows.coalesce(1), path, "w", 0)
    assert {r[0] for r in spark.read.parquet(path).filter("writer = 'w' AND batch = 0").select("append_key").collect()} == keys


def test_append_only_new_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    rows.write.parquet(path)
    append_new(spark.createDataFrame([("b", 9), ("c", 9)], "k string, n int"), spark.read.parquet(path), ["k"], path)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 1), ("c", 9)}


def test_stored_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "tasks"))
    spark.range(2).write.parquet(str(tmp_path / "alerts.parquet"))
    tables = parquet_tables(spark, str(tmp_path))
    assert (tables.tasks.count(), tables["alerts"].count()) == (3, 2)


def test_retries(spark):
    tasks = spark.createDataFrame(
        [("a", "Failed", "", 0), ("b", "Failed", "", 0), ("b2", "Running", "b", 1), ("c", "Failed", "x", 3), ("d", "Failed", "", 0)],
        "job_id string, status string, parent_run_id string, retry_index int",
    ).selectExpr("*", "'c' AS execution_chain_id", "'t' AS trace_id", "'n' AS task_name", "'p' AS payload")
    log = spark.createDataFrame([(j, "task.retry_scheduled") for j in "abc"], "job_id string, event_type string")
    got = {r.parent_run_id: (r.decision, r.retry_index) for r in monitoring.retry_candidates(literal_tables(tasks=tasks, event_log=log), NOW).collect()}
    assert got == {"a": ("RETRY", 1), "c": ("EXHAUSTED", None)}


def test_every_skipped_occurrence_is_emitted(spark):
    late = spark.createDataFrame([("s", True, ago(10_000), 1), ("t", True, ago(30), 60)], "schedule_id string, enabled boolean, next_run_at timestamp, interval_seconds int")
    rows = skipped_occurrences(late, NOW).collect()
    assert sorted((r.schedule_id, r.k, r.expected_at) for r in rows) == [("s", k, ago(10_000 - k)) for k in range(1, 10_001)]
    assert skipped_occurrences(late, NOW, 25).count() == 25


def test_histories_are_whole_and_pages_flagged(spark):
    rows = [(k, "q", "s", ago(k), k, f"j{k}", "Completed", f"o{k}") for k in range(150)]
    names = "id int, queue_name string, schedule_id string, at timestamp, pending_count int, job_id string, status string, occurrence_id string"
    frame = spark.createDataFrame(rows, names).selectExpr("*", "at AS sampled_at", "at AS created_at", "at AS expected_at", "at AS activated_at")
    started = frame.selectExpr("job_id", "at AS started_at")
    tables = literal_tables(queue_samples=frame, tasks=frame, run_projections=started)
    for found in (
        lambda *n: reports.queue_history(tables, "q", *n),
        lambda *n: reports.schedule_runs(tables, "s", *n),
        lambda *n: reports.schedule_occurrences(frame, "s", *n),
        lambda *n: reports.policy_history(frame, *n),
    ):
        assert {r.id for r in found().collect()} == set(range(150))
        assert {(r.id, r.truncated) for r in found(40).collect()} == {(k, True) for k in range(40)}


def test_timelines_are_whole_by_default(spark):
    entries = spark.range(1500).selectExpr("id", "timestamp_seconds(id) AS occurred_at", "0 AS source_rank", "'' AS sequence")
    assert timeline.ordered(entries, None).filter("NOT truncated").count() == 1500
    assert timeline.ordered(entries, 9).filter("truncated").count() == 9
    for fn in (timeline.chain_timeline, timeline.run_timeline):
        assert inspect.signature(fn).parameters["cap"].default is None


def test_sources_of_one_chain_are_not_shuffled(spark):
    """However large the runs table is, its few rows of a chain are sent to the attempts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
    try:
        tasks = spark.range(20_000).selectExpr("concat('j', id) AS job_id", "concat('c', id % 5000) AS execution_chain_id")
        attempts = spark.range(20_000).selectExpr("concat('a', id) AS attempt_id", "concat('j', id) AS job_id")
        others = {n: spark.createDataFrame([], f"{key} string") for n, key in timeline.SUBJECT.items() if n != "attempts"}
        tables = literal_tables(tasks=tasks, attempts=attempts, **others)
        cut = timeline.only_about(tables, tasks.filter("execution_chain_id = 'c7'"))["attempts"]
        assert sorted(r.job_id for r in cut.collect()) == ["j10007", "j15007", "j5007", "j7"]
        assert "hashpartitioning" not in cut._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in cut._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_attempts_are_shuffled_as_one_row(spark):
    """Steps become rows behind the joins, and events about no attempt meet no attempt."""
    at = "timestamp_seconds(id)"
    attempts = spark.range(40).selectExpr(
        "concat('a', id) AS attempt_id", "concat('j', id % 10) AS job_id", "'w' AS worker_id", "1 AS attempt_number", "'Failed' AS status",
        f"{at} AS claimed_at", f"{at} AS started_at", f"if(id % 4 = 0, null, {at}) AS finished_at", "'x' AS failure_category",
    )
    events = spark.range(60).selectExpr(
        "concat('e', id) AS event_id", "concat('j', id % 10) AS job_id", "if(id % 2 = 0, 'attempt.started', 'attempt.failed') AS event_type", f"{at} AS occurred_at",
        "'p' AS producer_id", "id AS producer_sequence", "if(id >= 50, null, if(id >= 30, '', concat('a', id))) AS attempt_id", "'w' AS worker_id", "'' AS stream_position",
    )
    none = {n: spark.createDataFrame([], fields) for n, fields in {
        "findings": "id long, job_id string, type string, detector_id string, policy_action string, created_at timestamp",
        "alerts": "id long, subject_type string, subject_id string, severity string, rule_id string, summary string, opened_at timestamp, acknowledged_at timestamp, resolved_at timestamp",
        "annotations": "id long, type string, subject_type string, subject_id string, evidence string, derived_at timestamp, resolved_at timestamp",
    }.items()}
    tasks = spark.range(9).selectExpr("concat('j', id) AS job_id", "'c' AS execution_chain_id")
    found = timeline.timeline_entries(literal_tables(attempts=attempts, run_event_details=events, tasks=tasks, **none))
    rows = [(r.source, r.event_type, r.attempt_id, r.attempt_number) for r in found.collect()]
    expected = [("EVENT", "attempt.failed" if k % 2 else "attempt.started", f"a{k}" if k < 30 else None, 1 if k < 30 else None) for k in range(60) if k % 10 < 9]
    for k in range(40):
        told = {} if k >= 30 else {"finished"} if k % 2 else {"started"}
        kept = [s for s in ("claimed", "started", "finished") if s not in told and not (s == "finished" and k % 4 == 0)]
        expected += [("ATTEMPT", f"attempt.{s}", f"a{k}", 1) for s in kept if k % 10 < 9]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    steps = found.filter("source = 'ATTEMPT'")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= steps.index("Generate") < steps.index("Join")
