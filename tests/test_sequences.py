"""Sequence rules against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opswatch.operators import blocks
from opswatch.operators import sequences as seq

BASE = datetime(2024, 1, 1)


def walk(times: list[int], window: int) -> list[int]:
    kept: list[int] = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= window:
            kept.append(t)
    return kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=80), st.integers(1, 40), st.integers(0, 60))
def test_steps_of_a_lead_reproduce_the_walk(times, window, before):
    lead = np.array(sorted(set(times)))
    last = int(lead[0]) - 1 - before
    kept = [int(lead[i]) for i in seq.kept_positions(lead, window, last)]
    expected = [t for t in walk([last, *lead.tolist()], window) if t != last]
    assert kept == expected
    high, exits = seq.lead_steps(lead, window)
    at = int(np.searchsorted(high, last + window))
    assert (int(exits[at]) if at < len(high) else None) == (expected[-1] if expected else None)


def events(spark, n: int, span: int, hot: float, seed: int):
    """A third or more of the rows may belong to one key."""
    rng = random.Random(seed)
    rows = [
        (i, "hot" if rng.random() < hot else f"k{rng.randrange(30)}", BASE + timedelta(milliseconds=rng.randrange(span)), rng.randrange(3))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id long, key string, occurred_at timestamp, value int")


def by_key(rows):
    keys: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        keys.setdefault(r[1], []).append(r)
    return keys


def test_spaced_equals_brute_force_on_a_hot_key(spark):
    rows, frame = events(spark, 3000, 600_000, 0.5, 3)
    expected = set()
    for members in by_key(rows).values():
        last = None
        for r in members:
            if last is None or (r[2] - last).total_seconds() >= 2.5:
                expected.add(r[0])
                last = r[2]
    got = {r.id for r in seq.spaced(frame, ["key"], "occurred_at", "id", 2.5).collect()}
    assert got == expected


def spaced_by_hand(rows, window):
    expected = set()
    for members in by_key(rows).values():
        last = None
        for r in members:
            if last is None or (r[2] - last).total_seconds() >= window:
                expected.add(r[0])
                last = r[2]
    return expected


@pytest.mark.parametrize("window", [0.05, 0.4, 3.0, 100.0])
def test_spaced_in_blocks_smaller_than_a_window(spark, window):
    """One key with nearly all rows, several blocks in one window, several windows in one block, all rows in one window."""
    rows, frame = events(spark, 900, 20_000, 0.9, 21)
    rows += [(10_000 + i, "even", BASE + timedelta(milliseconds=10 * i), 0) for i in range(300)]
    rows += [(20_000 + i, "early", BASE + timedelta(milliseconds=i), 0) for i in range(40)]
    rows += [(20_100 + i, "early", BASE + timedelta(seconds=500, milliseconds=70 * i), 0) for i in range(60)]
    rows += [(30_000, None, BASE, 0), (30_001, None, BASE, 0), (30_002, None, BASE + timedelta(seconds=200), 0)]
    frame = spark.createDataFrame(rows, frame.schema)
    got = {r.id for r in seq.spaced(frame, ["key"], "occurred_at", "id", window, block_rows=32).collect()}
    assert got == spaced_by_hand(rows, window)


def test_spaced_without_rows_or_times(spark):
    _, frame = events(spark, 3, 1000, 0.5, 1)
    assert seq.spaced(frame.filter("false"), ["key"], "occurred_at", "id", 1).count() == 0
    untimed = frame.withColumn("occurred_at", F.lit(None).cast("timestamp"))
    assert seq.spaced(untimed, ["key"], "occurred_at", "id", 1).count() == 0


def test_no_block_grows_with_a_key(spark):
    rows, frame = events(spark, 4000, 10, 1.0, 2)
    sizes = [r["count"] for r in blocks.in_blocks(frame, ["key", "occurred_at", "id"], 200).groupBy("_block").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 600


def test_previous_crosses_blocks(spark):
    rows, frame = events(spark, 2000, 600_000, 0.4, 5)
    expected = {m[i][0]: (m[i - 1][3] if i else None) for m in by_key(rows).values() for i in range(len(m))}
    got = {r.id: r.previous for r in seq.with_previous(frame, ["key"], "occurred_at", "id", "value", "previous", 40).collect()}
    assert got == expected


def test_transitions_are_silent_at_first_sight(spark):
    rows = [(1, "a", BASE, 1), (2, "a", BASE + timedelta(hours=5), 1), (3, "a", BASE + timedelta(hours=9), 0), (4, "b", BASE, 2)]
    frame = spark.createDataFrame(rows, "id long, key string, occurred_at timestamp, value int")
    got = seq.transitions(frame, ["key"], "occurred_at", "id", "value").collect()
    assert [(r.id, r.previous) for r in got] == [(3, 1)]


def test_zero_crossings(spark):
    rows = [(i, "q", BASE + timedelta(minutes=50 * i), c) for i, c in enumerate([2, 0, 0, 3, 3, 0])]
    frame = spark.createDataFrame(rows, "id long, key string, occurred_at timestamp, value int")
    got = seq.zero_crossings(frame, ["key"], "occurred_at", "id", "value").orderBy("id").collect()
    assert [(r.id, r.change) for r in got] == [(1, "lost"), (3, "restored"), (5, "lost")]


def test_stale_updates_are_refused(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice("ab"), rng.randrange(0, 60)) for i in range(500)]
    best: dict[str, int] = {}
    expected = set()
    for i, key, s in rows:
        if s == 0 or key not in best or s > best[key]:
            expected.add(i)
            if s > 0:
                best[key] = max(best.get(key, 0), s)
    frame = spark.createDataFrame(rows, "id long, key string, seq int")
    kept = seq.newer_than_all_before(frame, ["key"], "id", "seq", F.col("seq") == 0, chunk_rows=16)
    assert {r.id for r in kept.collect()} == expected


def test_critical_events_are_never_coalesced(spark):
    rows = [(i, "t", "j", BASE + timedelta(milliseconds=50 * i)) for i in range(10)]
    frame = spark.createDataFrame(rows, "id long, event_type string, job_id string, occurred_at timestamp")
    assert seq.coalesced(frame, F.lit(True)).count() == 10
    assert [r.id for r in seq.coalesced(frame, F.lit(False)).orderBy("id").collect()] == [0, 5]


def test_numbers_on_a_hot_key_equal_brute_force(spark):
    rows, frame = events(spark, 3000, 600_000, 0.5, 11)
    rows += [(-i, None, BASE + timedelta(milliseconds=i), 0) for i in range(1, 9)]
    frame = spark.createDataFrame(rows, frame.schema)
    out = blocks.numbered(frame, ["key"], ["occurred_at", "id"], "number", block_rows=200)
    expected = {r[0]: n for members in by_key(rows).values() for n, r in enumerate(members)}
    assert {r["id"]: r["number"] for r in out.collect()} == expected
    assert blocks.numbered(frame.limit(0), ["key"], ["occurred_at", "id"], "number").count() == 0
