"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (labelled good and not toxic) and one of all text, give
each document an importance weight, the log ratio of its likelihoods; documents are drawn by Gumbel top-k.

N-grams live in three hashed spaces: words, word pairs (a word that repeats its predecessor is one
common pair), and word shapes (runs of upper case, lower case and digits shrunk to one character each). The target
model is smoothed towards the raw one, so an n-gram that says nothing weighs nothing. Part sums of the log
ratio and the length are put on one scale by logistic regression on labelled documents that the target model has not
seen; the result is the log odds that a document belongs to the target, and the expected number of target
documents is the k of the draw.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = 1 << 18
SPACES = 3
#: buckets in one block of counts on their way to the sum
BLOCK = 1 << 12
#: pseudo-occurrences of every n-gram, as frequent in the target as in the raw text
SMOOTHING = 3.0
#: labelled documents used at most, half for the target model and half for the scale
MAX_LABELLED = 50_000
FEATURES = ["n_words", "words", "pairs", "shapes", "strong", "mild"]
#: words a hasher remembers
REMEMBERED = 150_000


_KINDS = {ord(c): "A" if c.isupper() else "a" if c.isalpha() else "0" for c in map(chr, range(0x250)) if c.isalnum()}
_RUNS = re.compile(r"([Aa0])\1+")


def shape(word: str) -> str:
    """``Word,`` becomes ``Aa,``; ``WORD!!`` becomes ``A!!``; ``word%%%`` becomes ``a%%%``; at most 12 characters."""
    return _RUNS.sub(r"\1", word[:64].translate(_KINDS))[:12]


class Hasher:
    """N-gram buckets of a text; remembers a bounded number of words."""

    def __init__(self) -> None:
        from xxhash import xxh64_intdigest

        self.digest = xxh64_intdigest
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows = array("q")  # three numbers for each word

    def _learn(self, word: bytes) -> int:
        text = word.decode(errors="replace")
        plain = text.lower().rstrip(".,;:") or text
        self.rows.append(self.digest(plain, 1) % SPACE)
        self.rows.append(self.digest(shape(text), 2) % SPACE + 2 * SPACE)
        self.rows.append(self.digest(word, 3) >> 1)
        self.number[word] = k = len(self.number)
        return k

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = (text or "").encode().split()
        if len(self.number) > REMEMBERED:
            self.forget()
        known = self.number
        ids = np.array([known[w] if w in known else self._learn(w) for w in words], dtype=np.int64)
        picked = np.array(np.frombuffer(self.rows, dtype=np.int64).reshape(-1, 3)[ids]) if len(ids) else np.zeros((0, 3), dtype=np.int64)
        raw = picked[:, 2]
        before, after = raw[:-1], raw[1:]
        with np.errstate(over="ignore"):
            mixed = (before * np.int64(-7046029254386353131) + after) * np.int64(-4417276706812531889)
        pairs = np.where(before == after, 0, (mixed >> np.int64(40)) & (SPACE - 1)) + SPACE
        return picked[:, 0], pairs, picked[:, 1]


def _counts(docs: DataFrame, target_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over all documents and over the target documents: two arrays of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        hasher = Hasher()
        total = np.zeros((2, SPACES * SPACE), dtype=np.int64)
        waiting: tuple[list, list] = ([], [])  # n-grams of other and of target documents
        size = 0

        def add_up() -> int:
            for target, grams in enumerate(waiting):
                if grams:
                    seen = np.bincount(np.concatenate(grams), minlength=SPACES * SPACE)
                    total[: target + 1] += seen
                    grams.clear()
            return 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))
            at = np.searchsorted(target_ids, np.array([-1 if i is None else i for i in ids], dtype=np.int64))
            for i, text, k in zip(ids, texts, at.tolist()):
                grams = np.concatenate(hasher(text))
                chosen = i is not None and k < len(target_ids) and target_ids[k] == i
                waiting[int(chosen)].append(grams)
                size += len(grams)
                if size > 1 << 20:
                    size = add_up()
        add_up()
        blocks = [
            {"block": b // BLOCK, "counts": zlib.compress(total[:, b : b + BLOCK].tobytes(), 1)}
            for b in range(0, SPACES * SPACE, BLOCK)
            if total[0, b : b + BLOCK].any()
        ]
        if blocks:
            yield pa.RecordBatch.from_pylist(blocks, schema=pa.schema([("block", pa.int64()), ("counts", pa.binary())]))

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total = np.zeros(2 * BLOCK, dtype=np.int64)
        for batch in batches:
            for blob in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()])], names=["block", "counts"]
        )

    sums = (
        docs.select("doc_id", "text")
        .mapInArrow(count, "block bigint, counts binary")
        .groupBy("block")
        .applyInArrow(add, "block bigint, counts binary")
    )
    out = np.zeros((2, SPACES * SPACE), dtype=np.int64)
    for row in sums.toLocalIterator():  # at most SPACES * SPACE / BLOCK rows
        out[:, row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], dtype=np.int64).reshape(2, -1)
    return out[0], out[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target model / raw model) of each bucket; each space is a model of its own."""
    out = np.zeros(len(raw), dtype=np.float32)
    for k in range(SPACES):
        part = slice(k * SPACE, (k + 1) * SPACE)
        r, t = raw[part].astype(float), target[part].astype(float)
        if t.sum() == 0:
            continue
        p = r / max(r.sum(), 1)
        lift = (t + SMOOTHING) / (p * t.sum() + SMOOTHING)
        out[part] = np.log(lift / (p * lift).sum())
    return out


def _scores(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # SPACES * SPACE floats, a fixed 3 MB
    fields = ", ".join(f"{c} double" for c in FEATURES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, hasher = shared.value, Hasher()
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(FEATURES)))
            for k, text in enumerate(t.as_py() for t in batch.column(1)):
                words, pairs, shapes = (ratio[x] for x in hasher(text))
                rows[k] = (
                    len(words), words.sum(), pairs.sum(), shapes.sum(),
                    np.minimum(words + 1, 0).sum(), np.minimum(words + 0.5, 0).sum(),
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(rows[:, j]) for j in range(len(FEATURES))]], names=["doc_id", *FEATURES]
            )

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id bigint, {fields}")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression, by Newton's method."""
    full = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(full.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6]) * max(len(x), 1) ** 0.5
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + penalty, full.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _squeezed(values: np.ndarray) -> np.ndarray:
    return np.sign(values) * np.sqrt(np.abs(values))


def design(rows: pd.DataFrame) -> np.ndarray:
    """Regression inputs: part sums as they are near zero and by their root far from it, and rates per word."""
    n = np.maximum(rows["n_words"].to_numpy(), 1)
    parts = [rows[c].to_numpy() for c in FEATURES[1:]]
    return np.column_stack([np.log1p(rows["n_words"].to_numpy()), *[_squeezed(p) for p in parts], *[p / n for p in parts]])


def weigh(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, log_odds) of every document."""
    marks = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.min("quality").cast("int") - F.max(F.coalesce("toxic", F.lit(0))).cast("int") >= 1).cast("int").alias("good"))
    )
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas()
    even = sample.index.to_numpy() % 2 == 0
    target_ids = np.sort(sample.loc[even & (sample["good"] == 1), "doc_id"].to_numpy(dtype=np.int64))
    raw, target = _counts(docs, target_ids)
    scores = stored(_scores(docs, log_ratios(raw, target)))
    held = sample.loc[~even, ["doc_id", "good"]].rename(columns={"doc_id": "id"})
    known = docs.sparkSession.createDataFrame(held, "id bigint, good int")  # at most max_labelled / 2 rows
    seen = scores.join(F.broadcast(known), F.col("doc_id") == F.col("id")).dropDuplicates(["id"]).toPandas()
    if seen["good"].nunique() < 2:
        return scores.select("doc_id", F.lit(30.0).alias("log_odds"))
    x = design(seen)
    centre, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    w = fit_logistic((x - centre) / spread, seen["good"].to_numpy(dtype=float))

    def odds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = (design(frame) - centre) / spread
            yield pd.DataFrame({"doc_id": frame["doc_id"], "log_odds": np.clip(z @ w[:-1] + w[-1], -30, 30)})

    return scores.mapInPandas(odds, "doc_id bigint, log_odds double")


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a bigint column, exactly: counts of at most 4,096 bins a round."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        step = (high - low) // 4096 + 1
        bins = rows.filter(F.col(column).between(low, high)).groupBy(F.floor((F.col(column) - low) / step).alias("bin")).count()
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if row["count"] >= k:
                break
            k -= row["count"]
        low = low + int(row["bin"]) * step
        if step == 1:
            return low
        high = min(high, low + step - 1)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 17, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, log_odds, gumbel_key) of the drawn documents.

    Input: doc_id, text; labels: doc_id, quality (1 good), toxic (1 toxic). The key is the log odds plus Gumbel noise
    from a hash of doc_id, in millionths; the k largest keys are drawn, k being the sum of the target
    probabilities over all documents; equal keys go together. Repeated rows of a doc_id get the same noise. A null text is
    empty; a null doc_id has a fixed noise. Of several labels of a document the worst counts, null quality is no
    label, null toxic is not toxic. Without labels of both kinds every document is drawn; an empty table gives none.
    """
    weighed = weigh(docs, labels, max_labelled)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = stored(
        weighed.withColumn("gumbel_key", F.floor((F.col("log_odds") - F.log(-F.log(uniform))) * 1e6).cast("bigint"))
    )
    k = keyed.agg(F.round(F.sum(1 / (1 + F.exp(-F.col("log_odds"))))).cast("bigint")).first()[0]
    if not k:
        return keyed.filter(F.lit(False))
    return keyed.filter(F.col("gumbel_key") >= kth_largest(keyed, "gumbel_key", k))
