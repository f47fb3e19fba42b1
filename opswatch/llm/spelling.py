"""Spelling variants by asymmetric chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The shorter word of a pair, of n code
points, contributes two disjoint chunks of q = n // 2 code points each; the other one contributes its grams of q code points with
their positions. One edit leaves one of the chunks whole and moves it by one place at most, so the pair meets at a chunk and a
gram that are equal and no more than one place apart; what meets is verified inside the join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import _UPPER_TO_LOWER

LETTERS = r"[A-Za-z\u00C0-\u00FF]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: a form is at least this many times as frequent as the word
TIMES = 2
#: distinct words a task holds before it hands their counts on
HELD = 100_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell_every: int | None = None) -> DataFrame:
    """(word, n): how often each run of letters (``LETTERS``, A-Z lower-cased) occurs in whole texts; null texts have none.

    With ``misspell_every`` a run of a document loses one code point where that number divides the CRC-32 of
    ``<id>:<run>``, the one at the CRC modulo the run's length; a null id counts as empty there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        runs = re.compile(LETTERS)
        total: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(*[batch.column(c).to_pylist() for c in ("id", "text")]):
                found = Counter(runs.findall((text or "").encode().translate(_UPPER_TO_LOWER).decode()))
                if misspell_every:
                    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word in list(found):
                        h = zlib.crc32(word.encode(), seed)
                        if h % misspell_every == 0:
                            at = h % len(word)
                            total[word[:at] + word[at + 1 :]] += found.pop(word)
                total.update(found)
                if len(total) >= HELD:
                    yield handed_on()
                    total = Counter()
        if total:
            yield handed_on()

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _chunks(words: DataFrame) -> DataFrame:
    """(word, n, size, chunk, at): the two halves of each word and their places; a middle code point belongs to neither."""
    q = F.expr("CAST(size DIV 2 AS INT)")
    places = F.explode(F.array(F.lit(0), q)).alias("at")
    return words.select("word", "n", "size", q.alias("q"), places).withColumn("chunk", F.substr("word", F.col("at") + 1, F.col("q")))


def _grams(words: DataFrame) -> DataFrame:
    """(word, n, size, chunk, at): grams that a chunk of a word as long, or one shorter, can equal, by the chunk's place.

    The words with chunks are never the longer ones, so a gram stands at the chunk's place or one behind it.
    """
    sizes = F.array_distinct(F.array(F.expr("CAST(size DIV 2 AS INT)"), F.expr("CAST((size - 1) DIV 2 AS INT)")))
    each = words.select("word", "n", "size", F.explode(sizes).alias("q"))
    each = each.withColumn("at", F.explode(F.array(F.lit(0), F.col("q")))).withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    each = each.filter("at + shift + q <= size")
    return each.withColumn("chunk", F.substr("word", F.col("at") + F.col("shift") + 1, F.col("q"))).drop("shift")


def _near(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n), in both directions, for all pairs of ``words`` (word, n) one edit apart.

    Words of two and more code points; shorter ones and nulls are near nothing.
    """
    sized = words.select("word", "n", F.char_length("word").alias("size")).filter("size > 1")
    a, b = _chunks(sized).alias("a"), _grams(sized).alias("b")
    longer = F.col("b.size") - F.col("a.size")
    met = a.join(
        b,
        (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.at") == F.col("b.at"))
        & ((longer == 1) | (longer == 0) & (F.col("a.word") < F.col("b.word"))) & _near(F.col("a.word"), F.col("b.word")),
    )
    pairs = met.select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"), F.col("b.n").alias("y_n")).distinct()
    one, other = F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("y_n").alias("near_n")), F.struct(
        F.col("y").alias("word"), F.col("x").alias("near"), F.col("x_n").alias("near_n")
    )
    return pairs.select(F.inline(F.array(one, other)))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms (word, form). Each round doubles the steps; counts double with each step, so few do."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = stored(reached.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("at").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def variants(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``counts`` (word, n) that is long and frequent enough.

    ``form`` is the most frequent near word (ties: the first in code-point order) if it is at least twice as frequent as
    the word, else null; ``root`` is where the chain of forms ends, the word itself if it has none. Null words are left
    out, counts of repeated words are added up, no words give no rows, further columns are ignored.
    """
    words = counts.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = stored(words.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count)))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, F.col("word") == F.col("of"), "left").drop("of")
    has_form = -F.col("best.less") >= TIMES * F.col("n")
    known = stored(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(known.filter("form IS NOT NULL")).withColumnRenamed("word", "of")
    joined = known.join(roots, F.col("word") == F.col("of"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
