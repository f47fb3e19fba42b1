"""Periodic runs of words by a suffix automaton whose link tree is accessed as each word is appended.

A node of the link tree stands for suffixes that end at the same places. Appending word i recolours the path from the root to the
node of prefix i with i; the path falls into segments of one earlier colour j each, and the longest suffix of a segment, of L words,
is what prefixes i and j have in common at their ends. Where i - j <= L / 2 the words form a cube of period i - j that reaches
back to i - L - (i - j); if the next word breaks the period, this is a maximal run. Paths are splay trees (link-cut trees), so an access takes
logarithmic time on average.

A run of at least 24 words and three periods has 16 words that come again one period later, at every place. So only stretches of
words covered by runs of 16 words that a text has twice are looked at; the rest holds no part of any run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: a run has at least so many words, and so many periods
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: words of a run that surely come again one period later
WINDOW = LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS

_FACTOR = np.random.default_rng(20_241_013).integers(0, 2**64, 1, dtype=np.uint64)[0] | np.uint64(1)


class Automaton:
    """Suffix automaton of a sequence: for each state its longest length and its link (state 1: empty; 0: none)."""

    def __init__(self, codes: list[int]) -> None:
        self.length, self.link = [0, 0], [0, 0]
        self.prefixes: list[int] = []
        after: list[dict[int, int]] = [{}, {}]
        last = 1
        for size, code in enumerate(codes, 1):
            new = self._state(size, 1, after, {})
            at = last
            while at and code not in after[at]:
                after[at][code] = new
                at = self.link[at]
            if at:
                to = after[at][code]
                if self.length[to] != self.length[at] + 1:
                    split = self._state(self.length[at] + 1, self.link[to], after, dict(after[to]))
                    while at and after[at].get(code) == to:
                        after[at][code] = split
                        at = self.link[at]
                    self.link[to] = split
                    to = split
                self.link[new] = to
            self.prefixes.append(new)
            last = new

    def _state(self, length: int, link: int, after: list[dict[int, int]], own: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        after.append(own)
        return len(self.length) - 1


class LastOccurrences:
    """The link tree as a forest of preferred paths, each a splay tree by depth with one colour, kept at its top."""

    def __init__(self, automaton: Automaton) -> None:
        self.length = automaton.length
        self.up = list(automaton.link)
        self.left, self.right, self.colour = ([0] * len(self.up) for _ in range(3))

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) and (left[p] == x or right[p] == x):
            if (g := up[p]) and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def append(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``node``; (earlier colour, longest length) of its coloured segments."""
        found = []
        below, at = 0, node
        while at:
            self._splay(at)
            if self.colour[at]:
                found.append((self.colour[at], self.length[at]))
            if cut := self.right[at]:
                self.colour[cut] = self.colour[at]
            self.right[at] = below
            below, at = at, self.up[at]
        self._splay(node)
        self.colour[node] = colour
        return found


def runs_of(codes: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start and period."""
    automaton = Automaton(codes)
    tree = LastOccurrences(automaton)
    found = []
    for end, node in enumerate(automaton.prefixes, 1):
        for earlier, common in tree.append(node, end):
            period = end - earlier
            length = common + period
            if length >= max(LEAST_WORDS, LEAST_PERIODS * period) and (end == len(codes) or codes[end] != codes[end - period]):
                found.append((end - length, length, period))
    return sorted(found)


def _stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the words covered by windows that come twice."""
    if len(codes) < LEAST_WORDS:
        return []
    value, span = codes.astype(np.uint64) + np.uint64(1), 1
    while span < WINDOW:
        value = value[:-span] * _FACTOR + value[span:]
        value = (value ^ value >> np.uint64(29)) * _FACTOR
        span *= 2
    _, which, times = np.unique(value, return_inverse=True, return_counts=True)
    twice = np.nonzero(times[which] > 1)[0]
    if not len(twice):
        return []
    change = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    covered = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
    edges = np.diff(covered)
    return list(zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()))


def runs_of_words(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start and period."""
    known: dict[str, int] = {}
    codes = [known.setdefault(w, len(known)) for w in words]
    found = []
    for start, stop in _stretches(np.array(codes, dtype=np.int64)):
        found += [(start + s, length, period) for s, length, period in runs_of(codes[start:stop])]
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return " ".join(w for w, k in zip(words, kept.tolist()) if k) if runs else " ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) of every row, from whole texts.

    A run is a longest stretch of words with smallest period q and max(24, 3 * q) words or more; starts are word numbers from 0. ``collapsed``
    has the text's words without those of a run after its first q. Null and wordless texts have no words and an empty
    ``collapsed``; null and repeated ids stay rows of their own; further columns are ignored. Rows never meet, so nothing is shuffled; a task
    holds a few states for each word of one text's repeated stretches.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[w.decode() for w in (t or "").encode().split()] for t in batch.column("text").to_pylist()]
            runs = [runs_of_words(w) for w in texts]
            listed = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(listed, run_type),
                 pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    fields = f"id {id_type}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, fields)


def planted(id_col: Column, text: Column) -> Column:
    """Texts in which some documents, chosen by the CRC-32 of their id, repeat a piece of theirs to the end."""
    h = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    chosen = F.pmod(h, F.lit(10)) == 0
    words = F.when(chosen, words_of(text)).otherwise(F.array().cast("array<string>"))
    n = F.size(words).cast("bigint")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    period = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
    times = F.floor((n - a) / period).cast("bigint") + 1
    start, many, at = a.cast("int"), times.cast("int"), (a + 1).cast("int")
    piece = F.slice(words, at, period.cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(piece, many)), F.lit(1), (n - a).cast("int"))
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), start), repeated), " ")
    return F.when(chosen & (n > 0), whole).otherwise(text)


def exponent_first(runs: Column) -> Column:
    """The run with the greatest length / period (ties: smallest start, then period), by exact comparison; null if there is none."""

    def better(best: Column, x: Column) -> Column:
        a, b = x["length"] * best["period"], best["length"] * x["period"]
        earlier = (x["start"] < best["start"]) | (x["start"] == best["start"]) & (x["period"] < best["period"])
        return F.when(best.isNull() | (a > b) | (a == b) & earlier, x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
