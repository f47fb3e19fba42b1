"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A document holds a benchmark item if a window of as many words as the item has a weighted (multiset) Jaccard
similarity of word shingles of ``similarity`` or more with it. Only windows that share enough shingle positions with
the item to reach that can qualify, and sliding a window right to its first shared shingle loses none, so
windows start at shared shingles (or end with the text). Each distinct window gets a 64-bit SimHash; eight 8-bit
blocks, each probed within two bits, find all item fingerprints within ``radius`` (23 or less: 24 differing bits are
needed to spend three in every block). Candidates are then verified exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, shingle_hashes, stored, words_of

BLOCK_BITS, BLOCKS, PROBE = 8, 8, 2
MAX_RADIUS = BLOCKS * (PROBE + 1) - 1
#: block values within PROBE bits of zero
PROBES = [sum(1 << b for b in some) for k in range(PROBE + 1) for some in combinations(range(BLOCK_BITS), k)]


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of an array of hashes: a bit is set if over half of them have it."""
    half = F.size(hashes) / F.lit(2.0)

    def bit(k: int) -> Column:
        ones = F.aggregate(
            hashes, F.lit(0), lambda n, h: n + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(1).cast("bigint")).cast("int")
        )
        return F.when(ones > half, F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))

    out = bit(0)
    for k in range(1, 64):
        out = out.bitwiseOR(bit(k))
    return out


def _block(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("bigint")).cast("int")


def _run_hash(n: int):
    return lambda i: F.xxhash64(F.slice("words", i + 1, n))


def _items(benchmark: DataFrame, size: int) -> DataFrame:
    words = words_of(F.lower("text"))
    return (
        benchmark.select("item_id", words.alias("words"))
        .filter(F.size("words") > 0)
        .select(
            "item_id",
            F.size("words").alias("n_words"),
            shingle_hashes(F.col("words"), size).alias("hashes"),
            "words",
        )
        .withColumn("n_shingles", F.size("hashes"))
    )


def _counted(hashes: DataFrame, *keys: str) -> DataFrame:
    return hashes.select(*keys, F.explode("hashes").alias("shingle")).groupBy(*keys, "shingle").agg(F.count("*").alias("n"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = MAX_RADIUS
) -> DataFrame:
    """One row (doc_id, item_id, similarity, start, n_windows) for each benchmark item a document holds.

    ``start`` is the word position of the best window (the first of equals), ``n_windows`` counts those that qualify.
    Words are lower-cased. Items of fewer words than ``size`` are one shingle and match where the same run of
    words stands. Null or wordless texts and items hold nothing, empty tables give no rows, repeated rows of a
    document count as one document's windows, other columns are ignored, a null doc_id is an id like any other.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"eight blocks probed within two bits guarantee radius {MAX_RADIUS} at most")
    items = stored(_items(benchmark, size))
    in_items = items.select(
        "item_id", "n_words", "n_shingles", F.explode(F.array_distinct("hashes")).alias("shingle")
    )
    # overlap o of two sequences of n shingles has similarity o / (2 n - o)
    need = F.ceil(F.col("n_shingles") * (2 * similarity / (1 + similarity)) - 1e-9)
    texts = docs.select("doc_id", "text").filter(F.col("text").rlike(WORD)).select("doc_id", words_of(F.lower("text")).alias("words"))
    run = shingle_hashes(F.col("words"), size)
    long = texts.select("doc_id", F.size("words").alias("doc_words"), F.posexplode_outer(run).alias("pos", "shingle"))
    short_sizes = [r["n_words"] for r in items.filter(F.col("n_words") < size).select("n_words").distinct().collect()]
    positions = long
    for n in short_sizes:  # at most size - 1 passes, for items below the shingle size
        runs = F.transform(F.sequence(F.lit(0), F.size("words") - n), _run_hash(n))
        positions = positions.unionByName(
            texts.filter(F.size("words") > n).select(
                "doc_id", F.size("words").alias("doc_words"), F.posexplode(runs).alias("pos", "shingle")
            )
        )
    hits = stored(
        positions.join(in_items, "shingle")
        .filter("doc_words >= n_words")
        .select("doc_id", "item_id", "pos", "doc_words", "n_words", "n_shingles")
        .distinct()
    )
    # the hit that completes the needed number must lie inside the window that starts at the first
    order = "row_number() over (partition by doc_id, item_id order by pos)"
    ranked = hits.withColumn("nth", F.expr(order)).withColumn("need", need.cast("int"))
    later = ranked.select(
        F.col("doc_id").alias("d"), F.col("item_id").alias("i"), F.col("nth").alias("later_nth"), F.col("pos").alias("later_pos")
    )
    windows = (
        ranked.join(
            later,
            F.col("doc_id").eqNullSafe(F.col("d"))
            & F.col("item_id").eqNullSafe(F.col("i"))
            & (F.col("later_nth") == F.col("nth") + F.col("need") - 1),
        )
        .filter("later_pos - pos < n_shingles")
        .select(
            "doc_id", "item_id", "n_words", "n_shingles", F.least("pos", F.col("doc_words") - F.col("n_words")).alias("start")
        )
        .distinct()
    )
    windows = stored(windows)
    spots = windows.select(F.col("doc_id").alias("d"), "start", F.col("n_words").alias("n")).distinct()
    cut = (
        texts.join(spots, F.col("doc_id").eqNullSafe(F.col("d")))
        .select("doc_id", "start", F.col("n").alias("n_words"), F.slice("words", F.col("start") + 1, F.col("n")).alias("words"))
        .distinct()
        .withColumn("hashes", shingle_hashes(F.col("words"), size))
        .select("doc_id", "start", "n_words", "hashes", F.xxhash64("words").alias("window_id"))
    )
    cut = stored(cut)
    # copies of a passage are one window
    distinct = cut.groupBy("window_id", "n_words").agg(F.first("hashes").alias("hashes"))
    prints = distinct.withColumn("print", simhash(F.col("hashes")))
    probes = prints.select(
        "window_id", "n_words", "print", F.explode(F.array(*[
            F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("value")) for k in range(BLOCKS)
        ])).alias("x")
    ).select("window_id", "n_words", "print", "x.block", "x.value")
    indexed = (
        items.select("item_id", F.col("n_words").alias("item_words"), simhash(F.col("hashes")).alias("item_print"))
        .select("*", F.explode(F.array(*[
            F.struct(F.lit(k).alias("item_block"), _block(F.col("item_print"), k).alias("v")) for k in range(BLOCKS)
        ])).alias("x"))
        .select("*", F.explode(F.array(*[F.lit(p) for p in PROBES])).alias("flip"))
        .select("item_id", "item_words", "item_print", "x.item_block", F.col("x.v").bitwiseXOR(F.col("flip")).alias("item_value"))
    )
    candidates = (
        probes.join(
            indexed,
            (F.col("block") == F.col("item_block"))
            & (F.col("value") == F.col("item_value"))
            & (F.col("n_words") == F.col("item_words")),
        )
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select("window_id", "n_words", "item_id")
        .distinct()
    )
    window_shingles = _counted(distinct, "window_id", "n_words")
    item_shingles = _counted(items, "item_id").select(
        F.col("item_id").alias("i"), F.col("shingle").alias("s"), F.col("n").alias("item_n")
    )
    scored = (
        candidates.join(window_shingles, ["window_id", "n_words"])
        .join(item_shingles, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("shingle") == F.col("s")))
        .groupBy("window_id", "n_words", "item_id")
        .agg(F.sum(F.least("n", "item_n")).alias("overlap"))
        .withColumn("total", F.greatest(F.col("n_words") - size + 1, F.lit(1)))
        .withColumn("similarity", F.col("overlap") / (2 * F.col("total") - F.col("overlap")))
        .filter(F.col("similarity") >= similarity)
        .select("window_id", F.col("n_words").alias("n"), F.col("item_id").alias("i"), "similarity")
    )
    return (
        windows.join(
            cut.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("n_words").alias("w"), "window_id"),
            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")) & (F.col("n_words") == F.col("w")),
        )
        .select("doc_id", "item_id", "start", "n_words", "window_id")
        .join(scored, ["window_id"])
        .filter(F.col("item_id").eqNullSafe(F.col("i")) & (F.col("n_words") == F.col("n")))
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("similarity").alias("similarity"),
            F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start"),
            F.countDistinct("start").alias("n_windows"),
        )
    )
