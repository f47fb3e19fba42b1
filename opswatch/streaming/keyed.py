"""Keyed state: rate limits, coalescing, burst signals, status transitions.

Rows of a key are taken in time order inside a micro batch; between batches only a tiny state per key remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opswatch.functions.timing import MICROS
from opswatch.operators.sequences import kept_positions

LATE = "1 hour"
#: groups that the keys of a spaced stream are dealt into: a group costs some milliseconds in Python, whatever it holds
SLOTS = 512


def in_time_order(parts: Iterator[pd.DataFrame], tie: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["_t", tie], kind="stable")


def spaced_stream(
    events: DataFrame, keys: list[str], ts: str, tie: str, window_seconds: float, late: str = LATE
) -> DataFrame:
    """Rows kept when each key may emit once per window, measured from the last kept row.

    Keys are dealt into ``SLOTS`` groups. The state of a group is the last kept time of its keys; a key is forgotten once the watermark is a
    window past it. Rows are held once, in the frames they come in; only their times and ties are sorted.
    """
    window = int(window_seconds * MICROS)
    fields = events.schema.fields
    names = [f.name for f in fields]
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    dated = events.withWatermark(ts, late).filter(F.col(ts).isNotNull())
    timed = dated.withColumns({"_t": F.unix_micros(F.col(ts)), "_key": key, "_slot": F.pmod(F.xxhash64(*keys), F.lit(SLOTS))})

    def keep(slot: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(*state.get)) if state.exists else {}
        number: dict[str, int] = {}
        frames, times, codes, ties = [], [], [], []
        for part in parts:
            own, found = pd.factorize(part["_key"])
            codes.append(np.array([number.setdefault(k, len(number)) for k in found], dtype=np.int32)[own])
            times.append(part["_t"].to_numpy())
            ties.append(part[tie].to_numpy())
            frames.append(part[names])
        t, code, ranks = np.concatenate(times), np.concatenate(codes), np.concatenate(ties)
        stops = np.cumsum([0, *map(len, times)])
        del times, codes, ties
        if ranks.dtype == object:
            ranks = pd.factorize(ranks, sort=True)[0]
        order = np.lexsort((ranks, t, code))
        del ranks
        t, code = t[order], code[order]
        edges = np.searchsorted(code, np.arange(len(number) + 1)).tolist()
        chosen = np.zeros(len(order), dtype=bool)
        for k, a, b in zip(number, edges, edges[1:]):
            kept = kept_positions(t[a:b], window, last.get(k))
            if kept:
                last[k] = int(t[a + kept[-1]])
                chosen[order[[a + i for i in kept]]] = True
        watermark = state.getCurrentWatermarkMs()
        last = {k: at for k, at in last.items() if (at + window) // 1000 + 1 > watermark}
        state.update((list(last), list(last.values())))
        if last:
            state.setTimeoutTimestamp((max(last.values()) + window) // 1000 + 1)
        for frame, a, b in zip(frames, stops, stops[1:]):
            if chosen[a:b].any():
                yield frame.loc[chosen[a:b]]

    return timed.groupBy("_slot").applyInPandasWithState(
        keep, T.StructType(fields), "keys ARRAY<STRING>, last ARRAY<BIGINT>", "append", GroupStateTimeout.EventTimeTimeout
    )


def rate_limited_stream(events: DataFrame, every_seconds: float, late: str = LATE) -> DataFrame:
    """At most one event per (type, producer) per window."""
    return spaced_stream(events, ["event_type", "producer"], "occurred_at", "id", every_seconds, late)


def coalesced_stream(events: DataFrame, critical: Column, window_seconds: float = 0.25, late: str = LATE) -> DataFrame:
    """Drop repeats of (type, subject) within the window. Critical events pass beside the state, however late they are."""
    always = F.coalesce(critical, F.lit(False))
    rest = spaced_stream(events.filter(~always), ["event_type", "job_id"], "occurred_at", "id", window_seconds, late)
    return events.filter(always).unionByName(rest)


def burst_stream(events: DataFrame, delay_seconds: float = 1.0, late: str = LATE) -> DataFrame:
    """One signal per burst, ``delay`` after its first event."""
    one = events.select(F.lit(1).alias("_all"), "id", "occurred_at")
    fire = F.timestamp_micros(F.unix_micros("occurred_at") + F.lit(int(delay_seconds * MICROS)))
    firsts = spaced_stream(one, ["_all"], "occurred_at", "id", delay_seconds, late)
    return firsts.select(F.col("id").alias("first_event_id"), F.col("occurred_at").alias("first_event_at"), fire.alias("signal_at"))


def changes_stream(samples: DataFrame, keys: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before, with ``previous``; a first sighting is silent."""
    timed = samples.withColumn("_t", F.unix_micros(F.col(ts)))
    fields = [f for f in timed.schema.fields if f.name != "_t"]
    kind = timed.schema[value].dataType
    names = [f.name for f in fields]

    def change(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = in_time_order(parts, tie)
        before = rows[value].shift(1).astype(object)
        before.iloc[0] = state.get[0] if state.exists else None
        final = rows[value].iloc[-1]
        state.update((final.item() if hasattr(final, "item") else final,))
        out = rows[names].assign(previous=before)
        yield out[out["previous"].notna() & (out["previous"] != out[value])]

    output = T.StructType([*fields, T.StructField("previous", kind)])
    state = T.StructType([T.StructField("last", kind)])
    return timed.groupBy(*keys).applyInPandasWithState(change, output, state, "append", GroupStateTimeout.NoTimeout)


def zero_crossing_stream(samples: DataFrame, keys: list[str], ts: str, tie: str, count: str) -> DataFrame:
    """Rows where a count drops to zero or rises from zero."""
    moved = changes_stream(samples.withColumn("_any", F.col(count) > 0), keys, ts, tie, "_any")
    change = F.when(F.col("_any"), F.lit("restored")).otherwise(F.lit("lost"))
    return moved.withColumn("change", change).drop("_any", "previous")
