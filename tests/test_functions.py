"""Column functions: verdict boundaries, labels, schedules, feed vocabulary, paging, delivery."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opswatch.functions import feed, schedules, timing
from opswatch.functions import verdicts as v
from opswatch.functions.status import (
    alert_type_label,
    failure_category,
    latest_transition,
    notification_payload,
    run_state_name,
    short_checksum,
    status_class,
    status_disagrees,
    status_of,
)
from opswatch.operators import paging
from opswatch.plans.reports import endpoint_pattern, known_revisions, result_distribution
from opswatch.plans.schedules import schedule_changes, with_hash
from opswatch.sources.delivery import parse_delivery

NOW = datetime(2024, 1, 31)


def one(spark, column, rows=((1,),), schema="x int"):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


@pytest.mark.parametrize(
    "status, category, retry, expected",
    [
        ("", "", 0, "SCHEDULED"), ("Pending", "", 0, "SCHEDULED"), ("Queued", "", 0, "QUEUED"), ("Running", "", 0, "RUNNING"),
        ("Completed", "TIMEOUT", 0, "SUCCEEDED"), ("Failed", "", 0, "FAILED"), ("Failed", "timeout ", 1, "TIMED_OUT"),
        ("Failed", "TIMEOUT", 3, "DEAD"), ("Failed", "odd", 2, "FAILED"), ("Failed", None, 4, "DEAD"), ("Blocked", "", 0, "FAILED"),
        ("Mystery", "", 0, "UNKNOWN"), (None, None, 0, "SCHEDULED"),
    ],
)
def test_run_state(spark, status, category, retry, expected):
    column = run_state_name(F.lit(status).cast("string"), F.lit(category).cast("string"), F.lit(retry))
    assert one(spark, column) == [expected]


@pytest.mark.parametrize(
    "age, stopped, draining, expected",
    [
        (0, None, None, "HEALTHY"), (60, None, None, "HEALTHY"), (61, None, None, "DEGRADED"), (300, None, None, "DEGRADED"), (301, None, None, "OFFLINE"),
        (None, None, None, "UNKNOWN"), (10, 10, None, "OFFLINE"), (10, 13, None, "HEALTHY"), (10, 12, None, "OFFLINE"), (400, None, 299, "HEALTHY"), (400, None, 300, "OFFLINE"),
        (400, 400, 10, "OFFLINE"),
    ],
)
def test_instance_verdict(spark, age, stopped, draining, expected):
    def ago(seconds):
        return F.lit(None if seconds is None else NOW - timedelta(seconds=seconds)).cast("timestamp")

    assert one(spark, v.instance_verdict(ago(age), ago(stopped), ago(draining), NOW)) == [expected]


def test_instance_reasons(spark):
    def ago(seconds):
        return F.lit(None if seconds is None else NOW - timedelta(seconds=seconds)).cast("timestamp")

    none = ago(None)
    reason = lambda started, seen, stopped=None, drain=None: one(spark, v.instance_reason(ago(started), ago(seen), ago(stopped), ago(drain), NOW))[0]
    assert reason(9, None) == "starting up (registered 9s ago, no heartbeat yet)"
    assert reason(31, None) == "no heartbeat has ever been recorded"
    assert reason(900, 75) == "last heartbeat 1m15s ago (degraded after 1m0s, offline after 5m0s)"
    assert reason(900, 75, stopped=70) == "stopped gracefully at 2024-01-30T23:58:50Z"
    assert reason(900, 75, drain=60).startswith("draining since 2024-01-30T23:59:00Z")
    evidence = one(spark, v.instance_evidence(ago(9), none, none, none, NOW))[0]
    assert evidence == '{"degraded_after_seconds":60,"offline_after_seconds":300,"starting":true}'


def test_activity_verdict(spark):
    at = lambda s: F.lit(None if s is None else NOW - timedelta(seconds=s)).cast("timestamp")
    cases = [(None, True, "UNKNOWN"), (60, True, "HEALTHY"), (61, False, "HEALTHY"), (61, True, "DEGRADED")]
    for seconds, busy, expected in cases:
        assert one(spark, v.activity_verdict(at(seconds), NOW, F.lit(busy))) == [expected]
    text = one(spark, v.activity_reason(F.lit("scan"), at(61), NOW, F.lit(True)))[0]
    assert text == "scan lag high: 1m1s with work in flight (degraded after 1m0s)"


@pytest.mark.parametrize("failed, expected", [(0, "COMPLETE"), (2, "PARTIAL"), (3, "DEGRADED"), (6, "DEGRADED"), (7, "UNKNOWN")])
def test_sweep_status(spark, failed, expected):
    assert one(spark, v.sweep_status(F.lit(failed), 7)) == [expected]


def test_labels(spark):
    assert one(spark, timing.age_label(F.col("x")), [(-5,), (59,), (60,), (3600,)]) == ["0s", "59s", "1m", "1h"]
    assert one(spark, timing.lag_label(F.col("x")), [(0.2,), (119.0,), (120.0,), (7199.0,), (7200.0,)], "x double") == ["<1s", "119s", "2m", "120m", "2h"]
    assert one(spark, timing.lateness_label(F.col("x")), [(None,), (59.6,), (185.0,), (7200.0,), (7500.0,)], "x double") == ["—", "1m", "3m 5s", "2h", "2h 5m"]
    assert one(spark, timing.throughput_label(F.col("x")), [(None,), (0.0,), (0.6,), (12.4,)], "x double") == ["—", "0/min", "0.6/min", "12/min"]
    assert one(spark, timing.duration_text(F.col("x")), [(0,), (59,), (300,), (3661,)]) == ["0s", "59s", "5m0s", "1h1m1s"]
    assert one(spark, timing.number_text(F.col("x")), [(20.0,), (0.5,), (100.25,)], "x double") == ["20", "0.5", "100.25"]
    assert one(spark, alert_type_label(F.col("x")), [("RUN_LOST",), ("A",), ("",)], "x string") == ["Run lost", "A", ""]
    assert one(spark, short_checksum(F.col("x")), [("0123456789",), (" ",), (None,)], "x string") == ["01234567", "—", "—"]
    assert one(spark, failure_category(F.col("x")), [(" timeout",), ("odd",), (None,)], "x string") == ["TIMEOUT", "UNKNOWN", "UNKNOWN"]


def test_status_helpers(spark):
    rows = [("Failed", "Running"), ("", "Queued"), (" ", None), ("Odd", "Odd")]
    frame = spark.createDataFrame(rows, "s string, c string")
    s, c = F.col("s"), F.col("c")
    got = frame.select(status_of(s, c), status_class(status_of(s, c)), status_disagrees(s, c)).collect()
    assert [tuple(r) for r in got] == [("Failed", "failed", True), ("Queued", "queued", False), ("", "unknown", False), ("Odd", "unknown", False)]


def test_latest_transition_prefers_the_later_stage(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, latest_transition(t("2024-01-02"), t("2024-01-02"), t("2024-01-01")))[0].label == "Run completed"
    assert one(spark, latest_transition(t(None), t("2024-01-02"), t("2024-01-03")))[0].label == "Run queued"
    assert one(spark, latest_transition(t(None), t("1970-01-01"), t(None)))[0] is None


@pytest.mark.parametrize("late, interval, expected", [(0, 60, 0), (59, 60, 0), (60, 60, 1), (61, 60, 1), (600, 60, 10), (-5, 60, 0), (600, 0, 0), (600, -1, 0)])
def test_skipped_count(spark, late, interval, expected):
    expected_at = F.lit(NOW - timedelta(seconds=late))
    assert one(spark, schedules.skipped_count(expected_at, NOW, F.lit(interval))) == [expected]
    times = one(spark, schedules.skipped_times(expected_at, NOW, F.lit(interval), 25))[0]
    assert times == [NOW - timedelta(seconds=late) + timedelta(seconds=interval * k) for k in range(1, expected + 1)]


def test_skipped_times_are_capped(spark):
    assert len(one(spark, schedules.skipped_times(F.lit(NOW - timedelta(days=1)), NOW, F.lit(60), 25))[0]) == 25


def test_occurrence_ids(spark):
    assert one(spark, schedules.occurrence_id(F.lit("a:b"), F.lit(NOW))) == ["a:b:1706659200"]
    got = one(spark, schedules.expected_from_occurrence_id(F.col("x")), [("a:b:1706659200",), ("a",), ("a:",), ("a:x",)], "x string")
    assert got == [NOW, None, None, None]
    assert one(spark, schedules.lateness(F.lit(NOW), F.lit(NOW + timedelta(seconds=5)))) == [0.0]


def test_schedule_changes(spark):
    schema = "schedule_id string, task_name string, task_type string, payload string, interval_seconds int, enabled boolean"
    defs = spark.createDataFrame([("a", "n", "t", "p", 60, True), ("b", "n", "t", "p", 60, False), ("c", "n", "t", "p", 60, True)], schema)
    hashes = {r.schedule_id: r.definition_hash for r in with_hash(defs).collect()}
    snaps = spark.createDataFrame([("a", hashes["a"], True), ("b", "old", True)], "schedule_id string, definition_hash string, enabled boolean")
    got = {(r.schedule_id, r.change) for r in schedule_changes(defs, snaps).collect()}
    assert got == {("b", "updated"), ("b", "disabled"), ("c", "created")}


def test_scopes():
    parsed = feed.parse_scopes(["runs", " run:j1 ", "runs"])
    assert [(s.kind, s.id) for s in parsed] == [("runs", ""), ("run", "j1")]
    for bad in (["run"], ["run:"], ["runs:x"], ["nonsense"], ["run:" + "x" * 201], [f"run:{i}" for i in range(17)]):
        with pytest.raises(feed.ScopeError):
            feed.parse_scopes(bad)


def test_summary_scope_and_visibility(spark):
    kinds = [("platform.summary",), ("task.created",), ("alert.opened",), ("pii.policy_activated",), ("pii.detected",)]
    frame = spark.createDataFrame(kinds, "t string")
    t, blank = F.col("t"), F.lit("")
    only = frame.filter(feed.in_scopes(feed.parse_scopes(["platform.summary"]), t, blank, blank)).collect()
    assert [r.t for r in only] == ["platform.summary"]
    shown = {p: [r.t for r in frame.filter(feed.visible_to(t, p)).collect()] for p in ((), ("alerts.read",), ("pii.findings.read",))}
    assert shown[()] == ["platform.summary", "task.created"]
    assert "alert.opened" in shown[("alerts.read",)] and "pii.policy_activated" not in shown[("pii.findings.read",)]


def test_priority(spark):
    rows = [("alert.opened", ""), ("alert.opened", "WARNING"), ("alert.opened", "CRITICAL"), ("queue.read", ""), ("queue.read.x", ""), ("queue.reader", ""), ("task.failed", "INFO")]
    frame = spark.createDataFrame(rows, "t string, s string")
    got = [r[0] for r in frame.select(feed.priority(F.col("t"), F.col("s"))).collect()]
    assert got == ["CRITICAL", "NORMAL", "CRITICAL", "INFORMATIONAL", "INFORMATIONAL", "NORMAL", "CRITICAL"]


def test_cursor_round_trip(spark):
    rows = [(1, datetime(2024, 1, 1, 10, 0, 0)), (2, datetime(2024, 1, 1, 10, 0, 0, 120000)), (3, datetime(2024, 1, 1, 10, 0, 0, 7))]
    page = paging.keyset_page(spark.createDataFrame(rows, "id long, ts timestamp"), "ts", "id").collect()
    assert [r.id for r in page] == [2, 3, 1]
    for r in page:
        at, ident = paging.decode_cursor(r.cursor)
        assert (at.replace(tzinfo=None), ident) == (r.ts, r.id)


def test_pages_cover_everything_once(spark):
    rows = [(i, NOW + timedelta(seconds=i // 3)) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, ts timestamp")
    seen, after = [], None
    while page := paging.keyset_page(frame, "ts", "id", 7, after).collect():
        seen += [r.id for r in page]
        after = (page[-1].ts, page[-1].id)
    assert sorted(seen) == list(range(20)) and len(seen) == 20
    assert [r.id for r in paging.offset_page(frame, "ts", "id", 5, 5).collect()] == seen[5:10]
    assert (paging.page_limit(None), paging.page_limit(0), paging.page_limit(999)) == (50, 50, 200)


def test_sort_and_cap(spark):
    frame = spark.createDataFrame([(1, None), (2, 5), (3, 9), (4, 5)], "id long, n int")
    order = lambda spec: [r.id for r in paging.sort_rows(frame, spec, ["n"], "id").collect()]
    assert order("n") == [2, 4, 3, 1] and order("-n") == [3, 2, 4, 1] and len(order("other")) == 4
    capped = paging.capped(frame, [F.col("id")], 3).collect()
    assert [(r.id, r.truncated) for r in capped] == [(1, True), (2, True), (3, True)]
    assert not any(r.truncated for r in paging.capped(frame, [F.col("id")], 4).collect())


def test_delivery_rows(spark):
    schema = "id long, job_id string, correlation_id string, trace_id string, created_at string, schema_version string, extra string"
    rows = [
        (1, "j1", "c 1", "t1", "2024-01-31T00:00:00.5+01:00", "1.0", "x"), (2, "bad id", "", "", "", "", ""), (3, None, "", "", "", "", ""),
        (4, "a" * 64, "ok", "", "soon", "123456789", ""), (5, "a" * 65, "", "", "", "", ""), (6, "j\n", "", "", "", "", ""),
    ]
    good, bad = parse_delivery(spark.createDataFrame(rows, schema))
    got = {r.id: r for r in good.collect()}
    assert set(got) == {1, 4} and {r.id for r in bad.collect()} == {2, 3, 5, 6} and "extra" not in good.columns
    assert (got[1].correlation_id, got[1].trace_id, got[1].schema_version) == (None, "t1", "1.0")
    assert got[1].created_at == datetime(2024, 1, 30, 23, 0, 0, 500000)
    assert (got[4].created_at, got[4].schema_version) == (None, None)


def test_small_reports(spark):
    paths = [("/runs/j1/timeline?x=1",), ("/",), ("pii/findings/",), ("/unknown",)]
    assert one(spark, endpoint_pattern(F.col("x")), paths, "x string") == ["/runs/:id/timeline", "/", "/pii/findings", "/:id"]
    assert one(spark, result_distribution(F.lit(2), F.lit(1), F.lit(3))) == ["2 ok / 1 failed"]
    assert one(spark, result_distribution(F.lit(0), F.lit(0), F.lit(0))) == ["…"]
    workers = spark.createDataFrame([("b",), (" a ",), ("unknown",), (None,), ("b",)], "build_revision string")
    assert sorted(r[0] for r in known_revisions(workers).collect()) == ["a", "b"]


def test_notification_payload(spark):
    fields = ("alert_id", "alert_type", "severity", "status", "summary", "subject_type", "subject_id", "evidence")
    rows = [tuple("abcdefg") + ('{"k":1}',), tuple("abcdefg") + ("not json",), tuple("abcdefg") + ("{}",)]
    frame = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    got = [r[0] for r in frame.select(notification_payload({f: F.col(f) for f in fields})).collect()]
    head = '{"alert_id":"a","alert_type":"b","severity":"c","status":"d","summary":"e","subject_type":"f","subject_id":"g"'
    assert got == [head + ',"evidence":{"k":1}}', head + "}", head + "}"]
