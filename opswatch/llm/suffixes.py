"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every string of ``length`` bytes has an anchor, the first of its ``gram``-byte substrings with the least hash, which depends on
the string alone; equal strings have equal anchors at the same place. Strings that share one anchor make a unit: the suffix from the
anchor to the end of the last string, and the bytes from the start of the first string to the anchor. Units whose anchor substring
stands only once cannot repeat and are left out, without loss.

Each task sorts its units by suffix into runs and front-codes them: a suffix is the number of bytes it shares with the one before
and the rest. Runs are cut at common splitters and exchanged; each range merges its runs with a loser tree whose players
carry the number of bytes they share with the last winner, so bytes known to be equal are not compared again. The tree
gives the bytes that neighbours share to the right of the anchor, a second order of the few bytes before it those to the left; a
string that starts k bytes before its anchor repeats where neighbours share ``k`` bytes to the left and ``length - k`` to
the right. Equal units of one run travel once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH, GRAM = 400, 200
#: units in a run, which bounds a task's memory
RUN = 50_000
#: units that a range should hold
RANGE = 100_000
#: units of complete groups that are resolved together
CHUNK = 8_192
#: a substring that more than one in so many anchors have is looked up without a shuffle
FREQUENT = 10_000
#: bytes of a suffix that decide its range
HEAD = 8

_SPREAD = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def gram_hashes(text: bytes, gram: int) -> np.ndarray:
    """A 64-bit polynomial hash of every ``gram``-byte substring."""
    n = len(text) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(text), _BASE, dtype=np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_SPREAD[np.frombuffer(text, dtype=np.uint8)] * powers)))
        # equal substrings at different places: take the place's power out again
        values = (sums[gram:] - sums[:-gram]) * np.cumprod(np.full(n, _INVERSE, dtype=np.uint64))
        values ^= values >> np.uint64(29)
        return values * np.uint64(0xBF58476D1CE4E5B9)


def anchor_ranges(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of the strings that share an anchor, the anchor, and the hash of the anchor's substring."""
    starts = len(text) - length + 1
    if starts <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    values = gram_hashes(text, gram)
    window = length - gram + 1
    best, at, span = values, np.arange(len(values)), 1
    while span < window:  # minima of ever longer windows; the first of equals wins
        step = min(span, window - span)
        left, right = slice(0, len(best) - step), slice(step, None)
        take = best[right] < best[left]
        best, at = np.where(take, best[right], best[left]), np.where(take, at[right], at[left])
        span += step
    borders = np.nonzero(np.diff(at))[0] + 1
    first = np.concatenate(([0], borders))
    last = np.concatenate((borders - 1, [starts - 1]))
    return first, last, at[first], values[at[first]].view(np.int64)


def _ranges(uids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, start) pairs as uid, first and last of inclusive ranges."""
    order = np.lexsort((starts, uids))
    u, s = uids[order], starts[order]
    cuts = np.nonzero((np.diff(u) != 0) | (np.diff(s) > 1))[0]
    heads, tails = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(u) - 1]))
    return u[heads], s[heads], s[tails]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes that a and b share, given that the first ``known`` are equal."""
    n = min(len(a), len(b))
    step = 16
    while known < n and a[known : known + step] == b[known : known + step]:
        known = min(known + step, n)
        step *= 2
    while step > 1 and known < n:
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known = min(known + step, n)
    return min(known, n)


class LoserTree:
    """Merges sorted iterators of (shared with the one before, string, tag) without comparing known prefixes again.

    Each waiting player keeps how many bytes it shares with the last string that beat it. Of two players the one
    that shares more with the last output is smaller; only equals are compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]) -> None:
        self.runs = runs
        self.size = 1 << max(len(runs) - 1, 0).bit_length()
        self.string: list[bytes | None] = [None] * self.size
        self.tag: list[object] = [None] * self.size
        self.shared = [0] * self.size
        for k in range(len(runs)):
            self._next(k)
            self.shared[k] = 0
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _next(self, k: int) -> None:
        self.shared[k], self.string[k], self.tag[k] = next(self.runs[k], (0, None, None))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """Winner of a and b; the loser waits at the node."""
        x, y = self.string[a], self.string[b]
        if x is None or y is None:
            wins = x is not None or y is None
        elif self.shared[a] != self.shared[b]:
            wins = self.shared[a] > self.shared[b]
        else:
            n = common_prefix(x, y, self.shared[a])
            wins = x[n : n + 1] <= y[n : n + 1]
            self.shared[b if wins else a] = n
        self.loser[node] = b if wins else a
        return a if wins else b

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(shared with the last output, string, tag) in sorted order."""
        while self.string[self.winner] is not None:
            k = self.winner
            yield self.shared[k], self.string[k], self.tag[k]
            self._next(k)
            node = (k + self.size) // 2
            while node:
                k = self._play(node, k, self.loser[node])
                node //= 2
            self.winner = k


def _front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared lengths and the joined rests of sorted strings."""
    shared, rests, before = [], [], b""
    for s in strings:
        n = common_prefix(before, s)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return np.array(shared, dtype=np.int64), b"".join(rests)


def _units(row: dict, rests: bytes, lefts: bytes, length: int) -> Iterator[tuple[int, bytes, tuple]]:
    """(shared with the one before, suffix, (uid, first, last, anchor, left, known)) of one run's part of a range."""
    before, at, left_at = b"", 0, 0
    for uid, first, last, anchor, n, known in zip(*[row[c] for c in ("uids", "firsts", "lasts", "anchors", "shared", "known")]):
        rest, left = last + length - anchor - n, anchor - first
        before = before[:n] + rests[at : at + rest]
        yield n, before, (uid, first, last, anchor, lefts[left_at : left_at + left], known)
        at += rest
        left_at += left


def repeats_of_units(shared: list[int], units: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, start) of all strings that stand twice among units in the order of their suffixes; shared: with the one before."""
    n = len(units)
    anchor = np.array([u[3] for u in units], dtype=np.int64)
    nearest, farthest = anchor - np.array([u[2] for u in units]), anchor - np.array([u[1] for u in units])
    backwards = [u[4][::-1] for u in units]
    order = sorted(range(n), key=backwards.__getitem__)
    left = np.array([0] + [common_prefix(backwards[a], backwards[b]) for a, b in zip(order, order[1:])])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    right = np.array(shared)
    which, starts = [], []
    for k in range(int(nearest.min()), int(farthest.max()) + 1):
        here = np.nonzero((nearest <= k) & (k <= farthest))[0]
        # strings k bytes before their anchor: equal bytes after it and before it make one class
        after, ahead = np.cumsum(right < length - k), np.cumsum(left < k)[rank]
        _, place, count = np.unique(after[here] * (n + 1) + ahead[here], return_inverse=True, return_counts=True)
        again = here[count[place] > 1]
        which.append(again)
        starts.append(anchor[again] - k)
    chosen = np.concatenate(which)
    return np.array([u[0] for u in units], dtype=np.int64)[chosen], np.concatenate(starts)


_FOUND = "uid bigint, first bigint, last bigint"


def _found(uids: object, firsts: object, lasts: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (uids, firsts, lasts)], names=["uid", "first", "last"])


def repeated_starts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(uid, first, last): ranges of starts of strings of ``length`` bytes that stand anywhere else in ``texts`` (uid, text)."""
    spark = texts.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "first", "last", "anchor", "gram"]
        for batch in batches:
            parts = []
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                found = anchor_ranges((text or "").encode(), length, gram)
                parts.append([np.full(len(found[0]), uid, dtype=np.int64), *found])
            columns = [np.concatenate(c) for c in zip(*parts)]
            if columns:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types)], names=names)

    anchors = stored(texts.mapInArrow(find, "uid bigint, first int, last int, anchor int, gram bigint"))
    twice = stored(anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("gram").alias("g"), "n"))
    often = F.col("n") > anchors.count() // FREQUENT
    frequent = F.broadcast(twice.filter(often).select("g"))  # fewer than FREQUENT rows
    same = F.col("gram") == F.col("g")
    wanted = (
        anchors.join(frequent, same, "left_anti")
        .join(twice.filter(~often).select("g"), same, "left_semi")
        .unionByName(anchors.join(frequent, same, "left_semi"))
        .groupBy("uid")
        .agg(F.collect_list(F.struct("first", "last", "anchor")).alias("spans"))
        .withColumnRenamed("uid", "u")
    )
    picked = stored(texts.join(wanted, F.col("uid") == F.col("u")).select("uid", "text", "spans"))

    # splitters decide nothing but where runs are cut; there are as many as the units ask for
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                text = row["text"].encode()
                found += [int.from_bytes(text[x["anchor"] : x["anchor"] + HEAD], "big") >> 1 for x in row["spans"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["head"])

    units = picked.agg(F.sum(F.size("spans"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, units // RANGE, 2)
    row = picked.mapInArrow(heads, "head bigint").agg(
        F.percentile_approx("head", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")
    ).first()
    splitters = np.unique(np.array(row["q"] if row and row["q"] else [], dtype=np.int64))
    lists = ["uids", "firsts", "lasts", "anchors", "shared"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3)
        schema = pa.schema(
            [("range", pa.int64()), *[(c, pa.list_(pa.int64())) for c in lists], ("known", pa.list_(pa.bool_())), ("rests", pa.binary()), ("lefts", pa.binary())]
        )

        def closed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            held.sort()
            kept: list[tuple] = []
            known: list[bool] = []
            again: list[tuple] = []
            for unit in held:
                if kept and kept[-1][:2] == unit[:2]:
                    again.append(unit)
                    known[-1] = True
                else:
                    kept.append(unit)
                    known.append(False)
            rows = []
            if again:
                rows.append({"range": -1, **dict(zip(lists, list(zip(*again))[2:]))})
            keys = np.array([int.from_bytes(u[0][:HEAD], "big") >> 1 for u in kept], dtype=np.int64)
            borders = [0, *np.searchsorted(keys, splitters, side="left").tolist(), len(kept)]
            for part, (a, b) in enumerate(zip(borders, borders[1:])):
                if a < b:
                    suffix, left, *columns = zip(*kept[a:b])
                    shared, rests = _front_coded(list(suffix))
                    rows.append(
                        {
                            "range": part, **dict(zip(lists, [*columns, shared.tolist()])), "known": known[a:b],
                            "rests": compressor.compress(rests), "lefts": compressor.compress(b"".join(left)),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

        held: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                text, uid = row["text"].encode(), row["uid"]
                for x in row["spans"]:
                    first, last, p = x["first"], x["last"], x["anchor"]
                    held.append((text[p : last + length], text[first:p], uid, first, last, p))
                    if len(held) >= RUN:
                        yield from closed(held)
                        held = []
        if held:
            yield from closed(held)

    fields = ", ".join(f"{c} array<bigint>" for c in lists)
    runs = stored(picked.mapInArrow(sort, f"range bigint, {fields}, known array<boolean>, rests binary, lefts binary"))

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows = [row for batch in batches for row in batch.to_pylist()]
        tree = LoserTree([_units(r, unpack(r["rests"]), unpack(r["lefts"]), length) for r in rows])
        shares: list[int] = []
        units: list[tuple] = []
        whole: set[int] = set()  # units all of whose strings repeat, by their number in the chunk
        copies: list[tuple] = []  # units like one that is held, from other runs
        same: dict[bytes, int] = {}  # units with the last suffix, by their bytes before the anchor
        size = -1

        def resolved() -> Iterator[pa.RecordBatch]:
            all_of = copies + [units[k] for k in whole]
            if all_of:
                yield _found(*list(zip(*all_of))[:3])
            uids, starts = repeats_of_units(shares, units, length)
            if len(uids):
                yield _found(*_ranges(uids, starts))

        for shared, suffix, unit in tree:
            if shared < gram and len(units) >= CHUNK:
                yield from resolved()
                shares, units, whole, copies = [], [], set(), []
            if not units or shared != size or len(suffix) != size:
                same, size = {}, len(suffix)
            if unit[4] in same:
                whole.add(same[unit[4]])
                copies.append(unit)
                continue
            same[unit[4]] = len(units)
            if unit[5]:
                whole.add(len(units))
            shares.append(shared)
            units.append(unit)
            if len(copies) >= CHUNK:
                yield _found(*list(zip(*copies))[:3])
                copies = []
        if units:
            yield from resolved()

    merged = runs.filter("range >= 0").groupBy("range").applyInArrow(merge, _FOUND)
    zipped = F.explode(F.arrays_zip("uids", "firsts", "lasts")).alias("x")
    local = runs.filter("range < 0").select(zipped).select(
        F.col("x.uids").alias("uid"), F.col("x.firsts").alias("first"), F.col("x.lasts").alias("last")
    )
    return merged.unionByName(local)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): the maximal removed byte spans [start, stop) of each whole text and the bytes that stay.

    Each byte goes that is covered by a string of ``length`` bytes that starts anywhere else too, in the same text or another; strings
    are judged on the input. A null text is empty. Every row is a text of its own, so repeated rows remove each
    other and null ids stay. An empty table gives no rows; further columns are ignored.
    """
    texts = stored(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    )
    gone = (
        repeated_starts(texts.select("uid", "text"), length, gram)
        .groupBy("uid")
        .agg(F.collect_list(F.struct("first", "last")).alias("found"))
        .withColumnRenamed("uid", "u")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for a, b in sorted((x["first"], x["last"] + length) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                borders = [0, *[x for span in merged for x in span], len(raw)]
                n_bytes.append(len(raw))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(n_bytes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary()),
                ],
                names=["id", "n_bytes", "spans", "kept"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return (
        texts.join(gone, F.col("uid") == F.col("u"), "left")
        .select("id", "text", "found")
        .mapInArrow(cut, f"id {id_type}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    )
