"""Quality rules under weak supervision.

Rules vote good or bad on a text or abstain. Expectation-maximisation over the counts of vote patterns estimates, for
good and for bad texts, how often each rule is right when it votes; the posterior probability of good then decides, in
place of a demand that every rule pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_doubled", "n_loud", "n_ended"]
#: base limits: fewest words, largest percentage of words in repeated windows
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS, GAPS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"

#: rule: numerator, denominator, good below, bad above (a rate between them abstains, as does an empty denominator)
BELOW = {
    "symbols": ("n_symbols", "n_words", 0.03, 0.15),
    "dup_lines": ("n_dup_lines", "n_lines", 0.05, 0.4),
    "repeats": ("n_repeat_words", "n_words", 0.05, 0.2),
    "capitals": ("n_capitals", "n_words", 0.1, 0.4),
    "doubled": ("n_doubled", "n_words", 0.03, 0.15),
    "loud": ("n_loud", "n_words", 0.03, 0.2),
    "long_words": ("word_chars", "n_words", 12.0, 20.0),
}
#: rule: numerator, denominator, bad below, good above
ABOVE = {"ended": ("n_ended", "n_lines", 0.05, 0.5), "short_words": ("word_chars", "n_words", 2.0, 3.0)}
RULES = [*BELOW, *ABOVE]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more."""
    runs, length = ids, 1
    while length < window:
        if len(runs) <= length:
            return 0
        both = runs[:-length] * np.int64(runs.max() + 1) + runs[length:]
        values, runs = np.unique(both, return_inverse=True)
        if len(values) == len(both):
            return 0
        length *= 2
    again = np.bincount(runs)[runs] > 1
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.nonzero(again)[0]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None) -> list[int]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    lines = [line for line in raw.split(b"\n") if line.translate(None, GAPS)]
    kinds = np.array([(w.isupper() and len(w) > 1, w.endswith(b"!!")) for w in known], dtype=bool).reshape(-1, 2)[ids]
    return [
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, GAPS))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        int(kinds[:, 0].sum()),
        int((ids[1:] == ids[:-1]).sum()),
        int(kinds[:, 1].sum()),
        sum(line.rstrip(GAPS).endswith((b".", b"!", b"?", b'"', b":")) for line in lines),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(rows[:, k]) for k in range(len(COUNTS))]], names=["doc_id", *COUNTS]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def votes():
    """One character for each rule: g good, b bad, - abstains."""
    out = []
    for top, bottom, good, bad in BELOW.values():
        rate = F.col(top) / F.col(bottom)
        out.append(F.when(F.col(bottom) == 0, "-").when(rate < good, "g").when(rate > bad, "b").otherwise("-"))
    for top, bottom, bad, good in ABOVE.values():
        rate = F.col(top) / F.col(bottom)
        out.append(F.when(F.col(bottom) == 0, "-").when(rate > good, "g").when(rate < bad, "b").otherwise("-"))
    return F.concat(*out)


def posteriors(patterns: list[str], counts: list[int], rounds: int = 200) -> dict[str, float]:
    """Probability of good for each pattern, by expectation-maximisation over pattern counts.

    Each rule has an accuracy on good and one on bad texts, with the weight of ten imagined votes at their start values (0.9, 0.4): most
    bad texts are bad in one way only. Abstentions say nothing.
    """
    if not patterns:
        return {}
    n = np.array(counts, dtype=float)
    good = np.array([[c == "g" for c in p] for p in patterns], dtype=float)
    bad = np.array([[c == "b" for c in p] for p in patterns], dtype=float)
    share, right_good, right_bad = 0.8, np.full(good.shape[1], 0.9), np.full(good.shape[1], 0.4)
    p = np.zeros(len(n))
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + good @ np.log(right_good / (1 - right_bad)) + bad @ np.log((1 - right_good) / right_bad)
        before, p = p, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        w, v = n * p, n * (1 - p)
        share = (w.sum() + 8) / (n.sum() + 10)
        right_good = (w @ good + 9) / (w @ (good + bad) + 10)
        right_bad = (v @ bad + 4) / (v @ (good + bad) + 10)
        if np.abs(p - before).max() < 1e-9:
            break
    return dict(zip(patterns, p.tolist()))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, votes, probability of good, base_failed and kept of every whole text.

    A null text is empty; a text without words fails the base. Rows are judged one by one, so repeated rows and
    null ids stay. An empty table gives no rows; further columns are ignored.
    """
    counted = stored(statistics(docs).withColumn("votes", votes()))
    found = counted.groupBy("votes").count().collect()  # at most three to the number of rules
    table = posteriors([r["votes"] for r in found], [r["count"] for r in found])
    spark = docs.sparkSession
    known = spark.createDataFrame(list(table.items()), "pattern string, p_good double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        counted.join(F.broadcast(known), F.col("votes") == F.col("pattern"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= 0.5))
        .select("doc_id", *COUNTS, "votes", "p_good", "base_failed", "kept")
    )
