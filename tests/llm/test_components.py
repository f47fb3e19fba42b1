"""Connected components, and how many jobs the driver has to plan for them and for the near-duplicate stage."""

import random

import pytest
from helpers import docs_frame, edited, prose

from opswatch.llm import common, near_copies
from opswatch.llm.components import _with_smallest, components


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def slow(pairs):
    root = {x: x for p in pairs for x in p}
    for a, b in pairs * len(root):
        root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("pairs", [[], [(5, 5)], [(3, 9), (9, 3), (9, -4)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)]])
def test_roots(spark, pairs):
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == sorted(slow([p for p in pairs if p[0] != p[1]]).items())


def test_roots_of_random_links(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == sorted(slow([p for p in pairs if p[0] != p[1]]).items())


def test_rows_are_counted_as_they_are_written(spark):
    rows, seen = common.counted(spark.range(70).filter("id > 20"))
    assert seen["n"] == 49 == rows.count()
    assert common.counted(spark.range(70).filter("id > 200"))[1]["n"] == 0


def test_settled_links_take_one_round(spark):
    star = spark.createDataFrame([(k, 0) for k in range(1, 30)], "a bigint, b bigint")
    assert jobs(spark, "star", lambda: components(star))[1] <= 10


def test_rounds_broadcast_nothing(spark):
    """What is broadcast passes through the driver, which keeps it and a thread for it; a round's sides are shuffled already."""
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)], "node bigint, near bigint")
    found = _with_smallest(pairs)
    assert sorted(r.least for r in found.collect()) == list(range(40))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stars_stand_for_the_links_they_came_from(spark):
    rng = random.Random(8)
    old, new = ([(rng.randrange(400), rng.randrange(400)) for _ in range(n)] for n in (150, 60))
    first, links = (spark.createDataFrame(x, "a bigint, b bigint") for x in (old, new))
    found = components(near_copies._with_stars(links, components(first)))
    expected = slow([p for p in old + new if p[0] != p[1]])
    assert {r.node: r.root for r in found.collect()} == expected


def test_near_copies_take_few_jobs(spark):
    """The driver keeps something of every job: the stage computes components only where links came in."""
    texts = [" ".join(edited(prose(k, 150, 3000), 100 * k + e, e)) for k in range(5) for e in (0, 1, 2, 3, 9)]
    found, n = jobs(spark, "near copies", lambda: near_copies.near_copies(docs_frame(spark, list(enumerate(texts)))).collect())
    assert len({r.component_id for r in found}) < 25
    assert n <= 180, n
