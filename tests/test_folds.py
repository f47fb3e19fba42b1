"""Run and occurrence folds: known cases, and equality with a step-by-step fold on random sequences."""

import random
from datetime import datetime, timedelta

import pytest

from opswatch.operators.folds import fold_occurrences, fold_runs, run_projections, summarize_schedules

BASE = datetime(2026, 10, 6, 12)
SCHEMA = "job_id string, event_type string, occurred_at timestamp, producer_id string, producer_sequence long, id long"
RANK = {"Pending": 10, "Queued": 20, "Running": 30, "Completed": 40, "Failed": 40, "Blocked": 40}
STATUS = {
    "task.created": "Pending", "task.queued": "Queued", "task.started": "Running", "task.completed": "Completed",
    "task.failed": "Failed", "task.blocked": "Blocked",
}


def rows_of(job: str, steps: list[tuple[str, int]]):
    return [(job, kind, BASE + timedelta(seconds=at), "p", i, i) for i, (kind, at) in enumerate(steps)]


def step_by_step(steps):
    """What an observer concludes who reads the events one after another."""
    ordered = sorted(enumerate(steps), key=lambda e: (e[1][1], e[0]))
    status, notes, recovered, last = None, [], False, None
    first = {"Queued": None, "Running": None, "done": None}
    for _, (kind, at) in ordered:
        last = at if last is None else max(last, at)
        if kind == "task.recovery_started":
            recovered = True
            if RANK.get(status, 0) < 40:
                status = "Queued"
            continue
        said = STATUS.get(kind)
        if said is None:
            continue
        slot = "done" if said in ("Completed", "Failed") else said
        if slot in first and first[slot] is None:
            first[slot] = at
        if status is None:
            status = said
        elif RANK[status] == 40 and RANK[said] == 40 and said != status:
            note = f"{kind.removeprefix('task.')} after {status}"
            if note not in notes:
                notes.append(note)
        elif RANK[said] > RANK[status]:
            status = said
    return status, first["Queued"], first["Running"], first["done"], last, recovered, bool(notes), "; ".join(notes)


CASES = {
    "plain": ([("task.created", 0), ("task.queued", 1), ("task.started", 2), ("task.completed", 3)], "Completed", False),
    "failed stays failed": ([("task.started", 0), ("task.failed", 5), ("pii.detected", 6)], "Failed", False),
    "late start never reopens": ([("task.completed", 5), ("task.started", 6)], "Completed", False),
    "recovery": ([("task.queued", 0), ("task.started", 1), ("task.recovery_started", 2)], "Queued", False),
    "recovery after the end": ([("task.failed", 1), ("task.recovery_started", 2)], "Failed", False),
    "restart after recovery": ([("task.started", 1), ("task.recovery_started", 2), ("task.started", 3)], "Running", False),
    "contradiction": ([("task.failed", 1), ("task.completed", 2)], "Failed", True),
    "nothing asserted": ([("task.progress", 1)], None, False),
}


@pytest.mark.parametrize("name", CASES)
def test_known_run(spark, name):
    steps, status, contradicted = CASES[name]
    row = fold_runs(spark.createDataFrame(rows_of("j", steps), SCHEMA)).first()
    assert (row.event_status, row.contradicted) == (status, contradicted)
    if contradicted:
        assert row.contradiction_note == "completed after Failed"


def test_random_runs_equal_the_step_by_step_fold(spark):
    rng = random.Random(7)
    kinds = [*STATUS, "task.recovery_started", "task.retry_scheduled"]
    runs = {f"j{n}": [(rng.choice(kinds), rng.randrange(6)) for _ in range(rng.randrange(1, 10))] for n in range(2000)}
    rows = [r for job, steps in runs.items() for r in rows_of(job, steps)]
    rng.shuffle(rows)
    got = {r.job_id: r for r in fold_runs(spark.createDataFrame(rows, SCHEMA)).collect()}

    def at(seconds):
        return None if seconds is None else BASE + timedelta(seconds=seconds)

    for job, steps in runs.items():
        status, queued, started, done, last, recovered, contradicted, note = step_by_step(steps)
        r = got[job]
        assert (r.event_status, r.queued_at, r.started_at, r.completed_at, r.last_event_at) == (
            status, at(queued), at(started), at(done), at(last),
        ), steps
        assert (r.was_reclaimed, r.contradicted, r.contradiction_note) == (recovered, contradicted, note), steps


def test_repeating_events_changes_nothing(spark):
    rows = rows_of("j", CASES["contradiction"][0])
    once = fold_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert fold_runs(spark.createDataFrame(rows * 3, SCHEMA)).collect() == once


def test_run_status_stands_in_and_heartbeats_do_not_count(spark):
    rows = rows_of("j", [("task.progress", 1), ("attempt.heartbeat", 9)])
    tasks = spark.createDataFrame([("j", "Running")], "job_id string, status string")
    row = run_projections(spark.createDataFrame(rows, SCHEMA), tasks).first()
    assert (row.current_status, row.last_event_at) == ("Running", BASE + timedelta(seconds=1))


OCCURRENCE = SCHEMA + ", schedule_id string, schedule_occurrence_id string, retry_index int"
EXPECTED = int((BASE - datetime(1970, 1, 1)).total_seconds())


def occurrence(spark, steps, retry=0):
    rows = [
        ("r" if kind != "schedule.occurrence_due" else "", kind, BASE + timedelta(seconds=at), "p", i, i, "s", f"s:{EXPECTED}", retry)
        for i, (kind, at) in enumerate(steps)
    ]
    return fold_occurrences(spark.createDataFrame(rows, OCCURRENCE))


@pytest.mark.parametrize(
    "steps, outcome, creation, start",
    [
        ([("schedule.occurrence_due", 0)], "DUE", None, None),
        ([("schedule.occurrence_due", 0), ("schedule.occurrence_run_created", 3), ("attempt.started", 12)], "CREATED", 3.0, 12.0),
        ([("schedule.occurrence_skipped", 0), ("schedule.occurrence_run_created", 3)], "SKIPPED", None, None),
        ([("schedule.occurrence_run_created", -5)], "CREATED", 0.0, None),
        ([("schedule.occurrence_run_created", 3), ("schedule.occurrence_run_created", 9)], "CREATED", 3.0, None),
    ],
)
def test_occurrence(spark, steps, outcome, creation, start):
    row = occurrence(spark, steps).first()
    assert (row.outcome, row.creation_lateness_seconds, row.start_lateness_seconds) == (outcome, creation, start)
    assert row.expected_at == BASE
    assert row.run_id == ("r" if outcome == "CREATED" else None)


def test_retry_starts_do_not_count(spark):
    assert occurrence(spark, [("attempt.started", 4)], retry=1).count() == 0


def test_schedule_summary(spark):
    rows = [
        ("s", "o1", BASE, "CREATED", "r1", 1.0, 2.0, BASE, BASE),
        ("s", "o2", BASE + timedelta(hours=1), "SKIPPED", None, None, None, BASE + timedelta(hours=1), BASE),
        ("s", "o3", BASE + timedelta(hours=2), "CREATED", "r3", 4.0, 9.0, BASE, BASE + timedelta(hours=2)),
    ]
    frame = spark.createDataFrame(
        rows,
        "schedule_id string, occurrence_id string, expected_at timestamp, outcome string, run_id string,"
        " creation_lateness_seconds double, start_lateness_seconds double, recorded_at timestamp, last_event_at timestamp",
    )
    r = summarize_schedules(frame).first()
    assert (r.occurrences_created, r.occurrences_skipped, r.last_run_id, r.last_occurrence_id) == (2, 1, "r3", "o3")
    assert (r.last_creation_lateness_seconds, r.last_start_lateness_seconds) == (4.0, 9.0)
    assert r.last_skipped_at == BASE + timedelta(hours=1)
