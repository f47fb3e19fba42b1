"""Rules over ordered sequences: transitions, zero crossings, rate limits, stale updates.

A key may hold a large share of all rows, so no rule sorts a whole key in one task. Ordered rows are cut into blocks of a
bounded number of rows (``operators.blocks``), and only one small row per (key, block) is carried along a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opswatch.functions.timing import MICROS
from opswatch.operators.blocks import BLOCK, BLOCK_ROWS, KEY, in_blocks, last_before, stored

CHUNK = "_chunk"


def with_previous(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``out``: the value of the row before this one within its key (NULL for the first row).

    Rows are in the order of ``ts`` and ``tie``; ``tie`` must tell rows of equal time apart.
    """
    held = df.withColumn("_held", F.struct(F.col(value).alias("v")))
    seen = last_before(held, keys, [ts, tie], "_held", "_previous", block_rows)
    return seen.select(*[F.col(c) for c in df.columns], F.col("_previous")["v"].alias(out))


def transitions(df: DataFrame, keys: list[str], ts: str, tie: str, verdict: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose verdict differs from the one before; a first sighting is silent. Adds ``previous``."""
    seen = with_previous(df, keys, ts, tie, verdict, "previous", block_rows)
    return seen.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(verdict)))


def zero_crossings(df: DataFrame, keys: list[str], ts: str, tie: str, count: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows where a count drops to zero or rises from zero. Adds ``previous`` and ``change`` (lost/restored)."""
    seen = with_previous(df, keys, ts, tie, count, "previous", block_rows)
    change = (
        F.when((F.col("previous") > 0) & (F.col(count) == 0), F.lit("lost"))
        .when((F.col("previous") == 0) & (F.col(count) > 0), F.lit("restored"))
    )
    return seen.withColumn("change", change).filter(F.col("change").isNotNull())


def newer_than_all_before(
    df: DataFrame,
    keys: list[str],
    arrival: str,
    sequence: str,
    always: Column | None = None,
    chunk_rows: int = 1 << 16,
) -> DataFrame:
    """Rows whose sequence exceeds every earlier arrival's; rows matching ``always`` pass and do not count.

    The running maximum inside a chunk of arrivals is a window; the maximum of all earlier chunks is carried
    as one row per (key, chunk).
    """
    exempt = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    work = df.withColumn("_exempt", exempt).withColumn(CHUNK, F.floor(F.col(arrival) / F.lit(chunk_rows)))
    counted = F.when(~F.col("_exempt"), F.col(sequence))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    running = work.withColumn("_inside", F.max(counted).over(inside))
    highs = work.groupBy(*keys, CHUNK).agg(F.max(counted).alias("_high"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = highs.select(*keys, CHUNK, F.max("_high").over(earlier).alias("_before"))
    joined = running.join(before, [*keys, CHUNK], "left")
    bar = F.greatest("_inside", "_before")  # NULL only when nothing came before
    accepted = F.col("_exempt") | bar.isNull() | (F.col(sequence) > bar)
    return joined.filter(accepted).drop(CHUNK, "_exempt", "_inside", "_before")


# --- keep at most one row per window, measured from the last kept row ---
#
# Rows are in blocks ordered by key and time. A row that is its key's first, or a window or more after the row before it, is kept whatever
# came earlier, so in a block only the rows before the first such row, its lead, depend on earlier blocks. What a
# lead does is a step function: which row is kept last, by which row is kept first. Its steps are the nodes of a graph
# whose pointers lead to the next kept row in a later block; nodes reached from what is known give each block the last row kept before it.


def lead_steps(times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest first-kept and the last-kept time of each step of a lead with these ascending times.

    The row kept before the lead is earlier than the first of ``times``, so only rows less than a window after that one
    and the first row beyond can be kept first.
    """
    n = len(times)
    following = np.searchsorted(times, times + window, side="left")
    last = times.copy()
    for i in range(int(np.searchsorted(following, n, side="left")) - 1, -1, -1):
        last[i] = last[following[i]]
    entries = min(int(np.searchsorted(times, times[0] + window, side="left")) + 1, n)
    ends = np.append(np.nonzero(last[1:entries] != last[: entries - 1])[0], entries - 1)
    return times[ends], last[ends]


def kept_positions(times: np.ndarray, window: int, last: int | None) -> list[int]:
    """Positions kept among ascending times, given the last time kept before them."""
    kept: list[int] = []
    n = len(times)
    i = 0 if last is None else int(np.searchsorted(times, last + window, side="left"))
    while i < n:
        kept.append(i)
        i = n if times[-1] - times[i] < window else int(np.searchsorted(times, times[i] + window, side="left"))
    return kept


def free_starts(times: np.ndarray, fresh: np.ndarray, window: int) -> np.ndarray:
    """Positions after the first that are kept whatever came earlier; ``fresh`` marks the first row of a key in a block."""
    apart = np.diff(times, prepend=times[:1]) >= window
    apart[0] = False
    starts = fresh | apart
    starts[0] = False
    return np.nonzero(starts)[0]


def _sources(blocks: DataFrame, window: int, key_type: str) -> DataFrame:
    """For each block the steps of its lead (with ``high``), and what it surely keeps last of its last key.

    Columns: block, key, high (NULL: no step), last (NULL: a step that leads nowhere), first (whether the block's first step).
    """

    def run(rows: pa.Table) -> pa.Table:
        times = rows.column("_t").to_numpy()
        starts = free_starts(times, rows.column("_fresh").to_numpy(zero_copy_only=False), window)
        lead = int(starts[0]) if len(starts) else len(times)
        high, last = lead_steps(times[:lead], window)
        highs, lasts, at = high.tolist(), last.tolist(), [0] * len(high)
        if len(starts):
            # the lead ends here: its steps lead nowhere, and the row after it ends a path that skips the lead
            lasts = [None] * len(high)
            if not rows.column("_fresh")[lead].as_py():
                highs, lasts, at = [*highs, int(times[lead])], [*lasts, None], [*at, 0]
            tail = times[int(starts[-1]) :]
            highs, lasts, at = [*highs, None], [*lasts, int(tail[kept_positions(tail, window, None)[-1]])], [*at, len(times) - 1]
        keys = rows.column(KEY).take(pa.array(at)).combine_chunks()
        block = rows.column(BLOCK).take(pa.array(at)).combine_chunks()
        first = [i == 0 for i in range(len(at))]
        return pa.Table.from_arrays(
            [block, keys, pa.array(highs, pa.int64()), pa.array(lasts, pa.int64()), pa.array(first, pa.bool_())], names=[BLOCK, KEY, "high", "last", "first"]
        )

    return blocks.groupBy(BLOCK).applyInArrow(run, f"{BLOCK} int, {KEY} {key_type}, high bigint, last bigint, first boolean")


def _entries(sources: DataFrame, window: int, block_rows: int) -> DataFrame:
    """(block, last): the time kept last before each block that a path enters; NULL where the block's first row starts its key."""
    firsts = sources.groupBy(KEY).agg(F.min(BLOCK).alias("of"))
    heads = sources.filter("first").select(BLOCK, KEY, "high")
    roots = heads.join(firsts, (heads[KEY] == firsts[KEY]) & (F.col(BLOCK) == F.col("of"))).select(BLOCK, "high")

    # the step that a path meets next: the first one of its key at or after a window from its last kept row
    nodes = sources.filter("high IS NOT NULL").select(
        KEY, (-F.col("high")).alias("down"), F.lit(0).alias("turn"), BLOCK, F.lit(None).cast("bigint").alias("high"), F.lit(None).cast("bigint").alias("last"),
        F.struct(BLOCK, "high").alias("node"),
    )
    ends = sources.filter("last IS NOT NULL").select(
        KEY, (-F.col("last") - F.lit(window)).alias("down"), F.lit(1).alias("turn"), BLOCK, "high", "last", F.lit(None).cast(nodes.schema["node"].dataType).alias("node")
    )
    both = nodes.unionByName(ends).withColumnRenamed(KEY, "of_key").withColumnRenamed(BLOCK, "block")
    met = last_before(both, ["of_key"], ["down", "turn", "block", "high"], "node", "to", block_rows).filter("turn = 1 AND to IS NOT NULL")
    pointers = stored(met.select(F.struct(F.col("block").alias(BLOCK), "high").alias("node"), "last", "to"))

    # nodes reached from roots and sure ends; in each round all pointers lead twice as far
    reached = roots.select(F.struct(BLOCK, "high").alias("node")).unionByName(pointers.filter("node.high IS NULL").select(F.col("to").alias("node")))
    jumps = pointers.filter("node.high IS NOT NULL").select("node", "to")
    while not jumps.isEmpty():
        further = jumps.join(reached, "node", "left_semi").select(F.col("to").alias("node"))
        reached = stored(reached.unionByName(further))
        onward = jumps.select(F.col("node").alias("to"), F.col("to").alias("end"))
        jumps = stored(jumps.join(onward, "to").select("node", F.col("end").alias("to")))

    taken = pointers.filter("node.high IS NULL").unionByName(pointers.filter("node.high IS NOT NULL").join(reached, "node", "left_semi"))
    entered = taken.select(F.col("to")[BLOCK].alias(BLOCK), "last")
    return entered.unionByName(roots.select(BLOCK, F.lit(None).cast("bigint").alias("last")))


def spaced(df: DataFrame, keys: list[str], ts: str, tie: str, window_seconds: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows kept when each key may emit once per window, measured from the last **kept** row.

    The decision is sequential, but no task sees more than a block of about ``block_rows`` rows, whatever a key or a window
    holds. At equal times only the first row can be kept, so times are made distinct before they are shuffled.
    ``tie`` must identify a row within its key; NULL keys are equal.
    """
    window = int(window_seconds * MICROS)
    moments = df.filter(F.col(ts).isNotNull()).groupBy(F.struct(*keys).alias(KEY), F.unix_micros(F.col(ts)).alias("_t")).agg(F.min(tie).alias(tie))
    blocked = in_blocks(moments, [KEY, "_t"], block_rows, df.count())
    key_type, tie_type = (blocked.schema[c].dataType.simpleString() for c in (KEY, tie))
    inside = Window.partitionBy(BLOCK).orderBy(KEY, "_t")
    fresh = F.coalesce(F.lag(KEY).over(inside) != F.col(KEY), F.lit(True)).alias("_fresh")
    sources = stored(_sources(blocked.select(BLOCK, KEY, "_t", fresh), window, key_type))
    entries = _entries(sources, window, block_rows).withColumn("_entered", F.lit(True))

    def pick(rows: pa.Table) -> pa.Table:
        times = rows.column("_t").to_numpy()
        starts = free_starts(times, rows.column("_fresh").to_numpy(zero_copy_only=False), window).tolist()
        kept: list[int] = []
        if rows.column("_entered")[0].as_py():
            kept += kept_positions(times[: starts[0] if starts else len(times)], window, rows.column("_last")[0].as_py())
        for a, b in zip(starts, [*starts[1:], len(times)]):
            kept += [a] if b - a == 1 else [a + i for i in kept_positions(times[a:b], window, None)]
        return rows.select([KEY, tie]).take(pa.array(kept, pa.int64()))

    entered = blocked.join(entries.withColumnRenamed("last", "_last"), BLOCK, "left")
    ready = entered.select(BLOCK, KEY, "_t", tie, "_last", "_entered", fresh)
    rows = ready.groupBy(BLOCK).applyInArrow(pick, f"{KEY} {key_type}, {tie} {tie_type}").withColumnRenamed(tie, "_tie")
    return df.withColumn(KEY, F.struct(*keys)).join(rows.withColumnRenamed(KEY, "_kept"), (F.col(KEY) == F.col("_kept")) & (F.col(tie) == F.col("_tie")), "left_semi").drop(KEY)


def rate_limited(events: DataFrame, every_seconds: float) -> DataFrame:
    """At most one event per (type, producer) per window."""
    return spaced(events, ["event_type", "producer"], "occurred_at", "id", every_seconds)


def coalesced(events: DataFrame, critical: Column, window_seconds: float = 0.25) -> DataFrame:
    """Drop repeats of (type, subject) within the window; critical events always pass."""
    always = F.coalesce(critical, F.lit(False))
    rest = spaced(events.filter(~always), ["event_type", "job_id"], "occurred_at", "id", window_seconds)
    return events.filter(always).unionByName(rest)


def burst_signals(events: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """One signal per burst of relevant events, ``delay`` after the first event of the burst."""
    one = events.select(F.col("id").isNotNull().alias("_all"), "id", "occurred_at")  # one key for every event
    firsts = spaced(one, ["_all"], "occurred_at", "id", delay_seconds)
    fire = F.timestamp_micros(F.unix_micros("occurred_at") + F.lit(int(delay_seconds * MICROS)))
    return firsts.select(F.col("id").alias("first_event_id"), F.col("occurred_at").alias("first_event_at"), fire.alias("signal_at"))
