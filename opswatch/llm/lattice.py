"""Language-model scores by a lattice of subwords.

The pieces of an existing vocabulary, weighted by its scores and by how often they spell the training words, form
a unigram model over all segmentations of a word; a forward recursion in log space sums them. A word seen in training
also has an arc of its own, weighted by its count. The weight left to spelling is the share of
training tokens seen once (Good and Turing). A text is its words and one end; log10 of the product is its score.
The lattice score is log10 of the product over its words of the sum over segmentations alone, without whole words and end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import block_words, blocks, by_position, numbered

MARK = "▁"
#: longest piece, in characters, that the recursion looks for
LONGEST = 24
#: offset of the rank (minus the score) in a piece's prior weight, and that prior's total in occurrences
RANK_OFFSET, PRIOR = 10.0, 10_000.0

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def splitter():
    return lambda text: text.encode().translate(_LOWER).split()


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _prior(model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, their prior probabilities from the vocabulary's scores, and which are single bytes."""
    size = model.get_piece_size()
    names = [model.id_to_piece(k) for k in range(size)]
    weight = np.array([1 / (max(-model.get_score(k), 0.0) + RANK_OFFSET) for k in range(size)])
    single = np.array([model.is_byte(k) for k in range(size)])
    weight[single] = weight[~single].min()
    weight[[k for k in range(size) if model.is_control(k) or model.is_unknown(k)]] = 0
    return names, weight / weight.sum(), single


def _piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """How often each piece spells a distinct training word: at most one row for each piece of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        total = np.zeros(model.get_piece_size(), dtype=np.int64)
        for batch in batches:
            texts = [w.decode(errors="replace") for w in batch.column("word").to_pylist()]
            for k in range(0, len(texts), 20_000):
                ids = model.encode(texts[k : k + 20_000], num_threads=1)
                total += np.bincount(np.fromiter((i for x in ids for i in x), dtype=np.int64), minlength=len(total))
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

    counts = words.select("word").mapInArrow(run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in counts.toLocalIterator()}


def piece_weights(model, counts: dict[int, int]) -> tuple[dict[str, float], list[float]]:
    """Natural-log weights of pieces by their string and of the 256 bytes."""
    names, prior, single = _prior(model)
    seen = np.zeros(len(names))
    for k, n in counts.items():
        seen[k] = n
    seen[prior == 0] = 0
    weight = (seen + PRIOR * prior) / (seen.sum() + PRIOR)
    by_name = {s: math.log(w) for s, w, b in zip(names, weight.tolist(), single.tolist()) if w > 0 and not b and len(s) <= LONGEST}
    return by_name, [math.log(w) for w, b in zip(weight.tolist(), single.tolist()) if b]


def word_log_probability(word: str, weights: dict[str, float], single: list[float], longest: int = LONGEST) -> float:
    """Natural log of the probability of a word, summed over all its segmentations."""
    text = MARK + word
    reach = [-math.inf] * (len(text) + 1)
    reach[0] = 0.0
    for stop in range(1, len(text) + 1):
        spelled = sum(single[b] for b in text[stop - 1].encode(errors="replace"))
        terms = [reach[stop - 1] + spelled]
        for start in range(max(0, stop - longest), stop):
            w = weights.get(text[start:stop])
            if w is not None:
                terms.append(reach[start] + w)
        top = max(terms)
        reach[stop] = top + math.log(sum([math.exp(t - top) for t in terms])) if len(terms) > 1 else top
    return reach[-1]


def score(docs: DataFrame, vocabulary_path: str, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    ``held_out`` is a boolean column of ``docs``; the other rows are learned from, every word of them. Words are
    lower-cased (A-Z) runs without ASCII white space, a null or wordless text is one end token. Repeated rows count as often
    as they stand. If nothing is learned from, every word is spelled and the end has probability 1/2. An empty table gives no rows.
    """
    packed = stored(blocks(numbered(docs, id_col, text_col, ~held_out), splitter))
    pairs = block_words(packed)
    words = stored(pairs.groupBy("word").agg(F.sum("uses").alias("uses")))
    ends = packed.filter("counted AND codes IS NOT NULL").count()
    seen, distinct, once = words.agg(
        F.coalesce(F.sum("uses"), F.lit(0)), F.count_if(F.col("uses") > 0), F.count_if(F.col("uses") == 1)
    ).first()
    total, kinds = seen + ends, distinct + (ends > 0)
    spelling = min(max((once + 1) / (total + 2), 1e-6), 0.5) if total else 0.5
    weights, single = piece_weights(_model(vocabulary_path), _piece_counts(words.filter("uses > 0"), vocabulary_path))
    shared = docs.sparkSession.sparkContext.broadcast((weights, single))  # one entry for each piece of the vocabulary

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name, by_byte = shared.value
        for batch in batches:
            uses = batch.column("uses").to_numpy()
            logs = np.array(
                [word_log_probability(w.decode(errors="replace"), by_name, by_byte) for w in batch.column("word").to_pylist()]
            )
            arc = np.log(np.where(uses > 0, (1 - spelling) * uses / max(total, 1), 1))
            mixed = np.logaddexp(np.where(uses > 0, arc, -np.inf), math.log(spelling) + logs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("uses"), pa.array(mixed / math.log(10)), pa.array(logs / math.log(10))],
                names=["word", "uses", "log10", "spelt"],
            )

    spelled = stored(words.mapInArrow(spell, "word binary, uses bigint, log10 double, spelt double"))
    values = pairs.select("block", "word").join(spelled, "word")
    floor = math.log10(total + kinds + 1)
    end_base = math.log10(ends + 1) - floor
    end_score = math.log10((1 - spelling) * ends / total) if ends else math.log10(0.5)

    def lay_out(found_words, found, right, rows):
        uses = right.column("uses").to_numpy()[found]
        base, own, known = np.log10(uses + 1) - floor, right.column("log10").to_numpy()[found], uses > 0
        spelt = right.column("spelt").to_numpy()[found]
        out: list[list] = [[], [], [], [], [], []]
        for _, counted, codes in rows:
            for column, value in zip(
                out,
                (
                    not counted, len(codes) + 1, int(known[codes].sum()) + (ends > 0),
                    float(base[codes].sum()) + end_base, float(own[codes].sum()) + end_score, float(spelt[codes].sum()),
                ),
            ):
                column.append(value)
        return [
            pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
            pa.array([total] * len(out[0]), pa.int64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64()),
            pa.array(out[5], pa.float64()),
        ]

    id_type = docs.schema[id_col].dataType.simpleString()
    fields = (
        f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, "
        "lattice_score double"
    )
    return by_position(packed, values, lay_out, fields)
