"""Line deduplication by an exact set-similarity join.

A line is the set of its runs of ``size`` words (a shorter line is one run). Lines with equal sets form a class; classes are
joined when the Jaccard similarity of their sets is ``similarity`` or more. Tokens are ordered by rarity, two
similar classes share a token among the first ``n - ceil(similarity * n) + 1`` of each; length and positional filters
thin the candidates, the whole sets decide. Each class first meets only the earliest class of each of its tokens; the classes
that none of these settles meet all others, so a large group of near copies does not make all its pairs. A line goes if an equal or similar line stands earlier, in order of
doc_id and line number.

Of a line its number of tokens, a key of its set and its prefix are kept, about a quarter of its tokens. Whole sets are computed
again, from the texts, for the candidates alone. Equal keys (64 bits) and sizes stand for equal sets.

Rarity is the count of a token's bucket in a one-row count sketch of fixed size: the order is a function of the
token alone, which is all that exactness needs, and the sketch (64 Ki numbers) is the only thing every task is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, shingle_hashes, stored, words_of

BUCKETS = 1 << 16
#: bits of a token that order it and look it up; two tokens that share them give one candidate more, not another result
MARK_BITS = 31
#: documents and lines are first looked up by one of so many slots, which bounds what is broadcast
SLOTS = 1 << 18


def _lines(docs: DataFrame, size: int, slots: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, tokens) of every line that holds a word; with ``slots`` (slot) only of lines in one of them.

    Outer explodes, here and below: a plain one infers a filter on its array, which is pushed down and computes it twice.
    """
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    if slots is not None:
        lines = lines.withColumn("slot", _slot("doc_id", "line_no")).join(F.broadcast(slots), "slot", "left_semi")
    return (
        lines.filter(F.col("line").rlike(WORD))
        .select("doc_id", "line_no", words_of(F.col("line")).alias("words"))
        .select("doc_id", "line_no", F.array_distinct(shingle_hashes(F.col("words"), size)).alias("tokens"))
    )


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1).cast("bigint")).cast("int")


def _sketch(lines: DataFrame) -> Column:
    """For each bucket eight times the binary logarithm of its count, above MARK_BITS bits: a constant array of BUCKETS numbers."""
    counted = (
        lines.select(F.explode_outer("tokens").alias("token"))
        .groupBy(_bucket(F.col("token")).alias("bucket"))
        .agg(F.floor(8 * F.log2(F.count("*") + F.lit(1))).alias("rank"))
    )
    ranks = ["0"] * BUCKETS
    for bucket, rank in counted.toPandas().itertuples(index=False):
        ranks[bucket] = str(rank << MARK_BITS)
    return F.split(F.lit(",".join(ranks)), ",").cast("array<bigint>")


def _ordered(tokens: Column, ranks: Column) -> Column:
    """Marks of the tokens by rarity: their rank before their upper bits."""
    return F.sort_array(F.transform(tokens, lambda t: F.get(ranks, _bucket(t)) + F.shiftrightunsigned(t, 64 - MARK_BITS)))


def _least(n: Column, similarity: float) -> Column:
    return F.ceil(n * similarity - 1e-9)


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """(first, n, pos, token, head) of the prefix tokens that two classes or more have; head is the earliest class (first, n, pos).

    Every token of every prefix travels as four numbers; places are joined to what two classes share.
    """
    index = classes.select("set_key", "n", F.posexplode_outer("prefix").alias("pos", "token"))
    held = index.groupBy("token").agg(F.count("*").alias("holders")).filter("holders > 1").select(F.col("token").alias("t"))
    some = index.join(held, F.col("token") == F.col("t"), "left_semi")
    places = classes.select(F.col("set_key").alias("k"), F.col("n").alias("m"), "first")
    shared = stored(some.join(places, (F.col("set_key") == F.col("k")) & (F.col("n") == F.col("m"))).select("first", "n", "pos", "token"))
    heads = shared.groupBy(F.col("token").alias("t")).agg(F.min(F.struct("first", "n", "pos")).alias("head"))
    return shared.join(heads, F.col("token") == F.col("t")).select("first", "n", "pos", "token", "head")


def _filters(n: Column, pos: Column, m: Column, other: Column, similarity: float) -> Column:
    """Length and positional filter for sets of n and m tokens that share the tokens at pos and other."""
    overlap = F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)
    return (F.least(n, m) >= _least(F.greatest(n, m), similarity)) & (F.least(n - pos, m - other) >= overlap)


def _head_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (early, late) of each class and the heads of its tokens: no more than it has tokens, however many share them."""
    return (
        shared.filter(F.col("head.first") < F.col("first"))
        .filter(_filters(F.col("head.n"), F.col("head.pos"), F.col("n"), F.col("pos"), similarity))
        .select(F.col("head.first").alias("early"), F.col("first").alias("late"))
        .distinct()
    )


def _other_pairs(shared: DataFrame, settled: DataFrame, similarity: float) -> DataFrame:
    """Pairs (early, late) for every late class not yet settled: all that share a prefix token and pass the filters."""
    late = shared.join(settled.withColumnRenamed("late", "done"), F.col("first").eqNullSafe(F.col("done")), "left_anti")
    late = late.select(*[F.col(c).alias(f"late_{c}") for c in shared.columns])
    return (
        shared.join(
            late,
            (F.col("token") == F.col("late_token"))
            & (F.col("first") < F.col("late_first"))
            & ~F.col("first").eqNullSafe(F.col("late_head.first"))
            & _filters(F.col("n"), F.col("pos"), F.col("late_n"), F.col("late_pos"), similarity),
        )
        .select(F.col("first").alias("early"), F.col("late_first").alias("late"))
        .distinct()
    )


def _likely(pairs: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs with enough common prefix tokens; ``shared`` holds the prefix tokens that several classes have.

    Of the prefix that ends first in the common order all tokens are decided: a set of n can share these and the n - len(prefix) behind them.
    Tokens of one set with equal marks count as often as they stand there.
    """
    held = stored(shared.groupBy("first", "n").agg(F.collect_set("token").alias("tokens"), F.count("*").alias("all")))

    def side(name: str) -> DataFrame:
        again = (F.col("all") - F.size("tokens")).alias(f"{name}_again")
        return held.select(F.col("first").alias(f"{name}_at"), F.col("n").alias(f"{name}_n"), F.col("tokens").alias(f"{name}_tokens"), again)

    met = pairs.join(side("a"), F.col("early").eqNullSafe(F.col("a_at"))).join(side("b"), F.col("late").eqNullSafe(F.col("b_at")))
    n, m = F.col("a_n"), F.col("b_n")
    behind = F.greatest(_least(n, similarity), _least(m, similarity)) - 1
    overlap = F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)
    common = F.size(F.array_intersect("a_tokens", "b_tokens")) + F.least("a_again", "b_again")
    return met.filter(common + behind >= overlap).select("early", "late")


def _slot(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


def _sets(docs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(at, tokens) of the lines at ``places`` (d, l); of repeated doc_ids one row for each set of a line."""
    of_docs, of_lines = (places.select(_slot(*c).alias("slot")).distinct() for c in (("d",), ("d", "l")))
    likely = docs.withColumn("slot", _slot("doc_id")).join(F.broadcast(of_docs), "slot", "left_semi").drop("slot")
    lines = _lines(likely, size, of_lines).join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l")), "left_semi")
    return lines.select(F.struct("doc_id", "line_no").alias("at"), "tokens", F.xxhash64(F.sort_array("tokens")).alias("set_key")).dropDuplicates(["at", "set_key"])


def _verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The late classes of the pairs whose whole sets are similar."""
    pairs = stored(pairs)
    wanted = pairs.select("early").union(pairs.select("late")).distinct().select(
        F.col("early.doc_id").alias("d"), F.col("early.line_no").alias("l")
    )
    sets = stored(_sets(docs, stored(wanted), size).select("at", "tokens"))
    both = F.size(F.array_intersect("tokens", "late_tokens"))
    return (
        pairs.join(sets, F.col("early").eqNullSafe(F.col("at")))
        .drop("at")
        .join(sets.select(F.col("at").alias("late_at"), F.col("tokens").alias("late_tokens")), F.col("late").eqNullSafe(F.col("late_at")))
        .filter(both >= similarity * (F.size("tokens") + F.size("late_tokens") - both) - 1e-9)
        .select("late")
        .distinct()
    )


def removed_lines(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, lines): the numbers of the lines of each document that an earlier line repeats."""
    docs = docs.select("doc_id", "text")
    each = _lines(docs, size)
    whole = each.select("doc_id", "line_no", F.size("tokens").alias("n"), F.xxhash64(F.sort_array("tokens")).alias("set_key"), _ordered(F.col("tokens"), _sketch(each)).alias("ordered"))
    keep = F.col("n") - _least(F.col("n"), similarity) + 1
    lines = stored(whole.select("doc_id", "line_no", "n", "set_key", F.slice("ordered", F.lit(1), keep.cast("int")).alias("prefix")))
    classes = stored(
        lines.groupBy("set_key", "n").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("prefix").alias("prefix"))
    )
    shared = stored(_shared_tokens(classes))
    # near copies are mostly like the first of them; only those that are not meet every other class
    by_heads = stored(_verified(_likely(_head_pairs(shared, similarity), shared, similarity), docs, size, similarity))
    by_others = _verified(_likely(_other_pairs(shared, by_heads, similarity), shared, similarity), docs, size, similarity)
    similar = by_heads.unionByName(by_others).withColumn("repeats", F.lit(True))
    marked = (
        classes.select("set_key", "n", "first")
        .join(similar, F.col("first").eqNullSafe(F.col("late")), "left")
        .select(F.col("set_key").alias("k"), F.col("n").alias("m"), "first", "repeats")
    )
    return (
        lines.select("doc_id", "line_no", "set_key", "n")
        .join(marked, (F.col("set_key") == F.col("k")) & (F.col("n") == F.col("m")))
        .filter(F.col("repeats").isNotNull() | ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("line_no")).alias("lines"))
    )


def dedup_lines(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """All columns of ``docs`` with ``text`` without its repeated lines, n_lines and removed_lines (array).

    Every document stays; one whose lines all go keeps an empty text, a null text stays null. Lines without
    words never go. Rows that share a doc_id share one place in the order, so none of them is later than
    another and a line number removed for one is removed for all; a null doc_id comes first. An empty table
    gives no rows.
    """
    gone = removed_lines(docs, size, similarity).select(F.col("doc_id").alias("gone_id"), F.col("lines").alias("gone_lines"))
    lines = F.split("text", "\n")
    kept = F.filter(
        F.transform(lines, lambda line, i: F.when(~F.array_contains("gone_lines", i), line)), lambda line: line.isNotNull()
    )
    extra = {"n_lines", "removed_lines"}
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").select(
        *[
            (F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
            if c == "text"
            else F.col(c)
            for c in docs.columns
            if c not in extra
        ],
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("gone_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )
