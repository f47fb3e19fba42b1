"""Set-similarity join of documents by grouped prefixes.

A document is the set of its distinct three-word shingles, as 64-bit hashes. Two sets link at a Jaccard of 0.9 or more:
100 * shared >= 90 * all. Their elements are put in one order, rare ones first; two linked sets of n and m elements then
share one of the first n // 10 + 1 elements of the one and the first m // 10 + 1 of the other.

Equal sets are one class. Classes of equal size and equal prefix are one group, and a group takes part in the join as one
record. A prefix element's groups first meet one of them only, the one that has the element earliest in its prefix: edited copies
start with the rare elements of their edits, their original does not. Verified links that this gives join most large
groups of copies; afterwards only groups still apart from that one meet the others of the element. Sizes, and parities of
the elements, rule out pairs inside the join; what is left is expanded to the members of the groups and verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .simhash import _UPPER_TO_LOWER

SIZE = 3
#: linked sets share at least 9 / 10 of their union
SHARED, ALL = 9, 10
#: two rows of counters estimate how frequent an element is; the estimate orders elements and decides nothing else
COUNTER_BITS, COUNTER_SHIFTS = 17, (0, 40)
#: a class has the parity of how many of its elements fall into each of 512 slots, as eight numbers
PARITIES = [f"parity_{k}" for k in range(8)]
#: ids are first looked up by one of so many slots, which bounds what is broadcast
ID_SLOTS = 1 << 18

_DRAWN = np.random.default_rng(20_240_911).integers(0, 2**64, 2, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, hasher) -> np.ndarray:
    """Sorted distinct hashes of all three-word runs; fewer words: of the whole sequence; no words: none."""
    words = (text or "").encode().translate(_UPPER_TO_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < SIZE:
        return np.array([hasher(b" ".join(words), 42)], dtype=np.uint64)
    each = np.fromiter(map(hasher, words), dtype=np.uint64, count=len(words))
    runs = (each[:-2] * _DRAWN[0] + each[1:-1]) * _DRAWN[0] + each[2:]
    return np.unique((runs ^ runs >> np.uint64(32)) * _DRAWN[1])


def _slots(values: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << COUNTER_BITS) - 1)
    return [(values >> np.uint64(s) & mask).astype(np.int64) + (k << COUNTER_BITS) for k, s in enumerate(COUNTER_SHIFTS)]


def _counted(texts: DataFrame) -> np.ndarray:
    """How many documents have an element in each counter: a fixed number of counters, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        total = np.zeros(len(COUNTER_SHIFTS) << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            sets = [shingle_set(t, xxh64_intdigest) for t in batch.column(0).to_pylist()]
            for slots in _slots(np.concatenate(sets)):
                total += np.bincount(slots, minlength=len(total))
        slot = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(COUNTER_SHIFTS) << COUNTER_BITS, dtype=np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefix(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first elements of a set in the common order: by estimated frequency, then by hash."""
    estimate = np.minimum.reduce([counts[s] for s in _slots(values)])
    return values[np.lexsort((values, estimate))[: len(values) * (ALL - SHARED) // ALL + 1]] if len(values) else values


def _key(values: np.ndarray, hasher) -> int:
    return hasher(values.tobytes(), 7)


def _marked(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(id, key, n, prefix, parities): the key stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingle_set(t, xxh64_intdigest) for t in batch.column("text").to_pylist()]
            keys = np.array([_key(s, xxh64_intdigest) for s in sets], dtype=np.uint64).view(np.int64)
            heads = [prefix(s, counts) for s in sets]
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = np.concatenate([*heads, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            odd = [np.bincount((s >> np.uint64(20) & np.uint64(511)).astype(np.int64), minlength=512) & 1 for s in sets]
            parities = np.packbits(np.array(odd, dtype=np.uint8).reshape(len(sets), 512), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys), pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *map(pa.array, parities.T.copy())],
                names=["id", "key", "n", "prefix", *PARITIES],
            )

    id_type = texts.schema["id"].dataType.simpleString()
    fields = f"id {id_type}, key bigint, n bigint, prefix array<bigint>, " + ", ".join(f"{p} bigint" for p in PARITIES)
    return texts.mapInArrow(run, fields)


def _id_slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ID_SLOTS))


def _sets(texts: DataFrame, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, elements) of the classes in ``keys`` (key), from the texts of their smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingle_set(t, xxh64_intdigest) for t in batch.column(0).to_pylist()]
            found = np.array([_key(s, xxh64_intdigest) for s in sets], dtype=np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "elements"]
            )

    ids = classes.join(keys, "key", "left_semi").select(F.col("least_id").alias("needed")).distinct()
    slots = ids.select(_id_slot("needed").alias("slot")).distinct()
    likely = texts.withColumn("slot", _id_slot("id")).join(F.broadcast(slots), "slot", "left_semi")
    needed = likely.join(ids, F.col("id").eqNullSafe(F.col("needed")), "left_semi").select("text")
    found = needed.mapInArrow(run, "key bigint, elements array<bigint>")
    return found.join(keys, "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose whole sets link."""
    keys = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    sets = stored(_sets(texts, keys, classes))
    one = sets.select(F.col("key").alias("a"), F.col("elements").alias("a_elements"))
    two = sets.select(F.col("key").alias("b"), F.col("elements").alias("b_elements"))
    met = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("a_elements", "b_elements"))
    return met.filter(shared * (SHARED + ALL) >= (F.size("a_elements") + F.size("b_elements")) * SHARED).select("a", "b")


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * ALL >= F.greatest(n, m) * SHARED


def _positions_fit(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Elements before a shared one at i and j, itself and those after it are enough for a link."""
    return (F.least(i, j) + F.least(n - i, m - j)) * (SHARED + ALL) >= (n + m) * SHARED


def _parities_fit(a: list[Column], b: list[Column], n: Column, m: Column) -> Column:
    """Sets differ in at least as many elements as parities; at most (n + m) / 19 of linked sets differ."""
    differing = reduce(lambda x, y: x + y, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a, b)])
    return differing * (SHARED + ALL) <= (n + m) * (ALL - SHARED)


def _prefixes_fit(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs (ga, gb) of groups with enough common prefix elements; ``shared`` has (gid, n, elements), those of several groups.

    Elements of the prefix that ends first in the common order are all decided: such a set of n has at most the common ones and the
    n - len(prefix) behind its prefix in common with the other set.
    """
    def side(a: str) -> DataFrame:
        return shared.select(F.col("gid").alias(f"g{a}"), F.col("n").alias(f"n_{a}"), F.col("elements").alias(f"elements_{a}"))

    met = pairs.join(side("a"), "ga").join(side("b"), "gb")
    behind = F.greatest(*[F.expr(f"n_{x} - (n_{x} * {ALL - SHARED} DIV {ALL} + 1)") for x in "ab"])
    most = F.size(F.array_intersect("elements_a", "elements_b")) + behind
    return met.filter(most * (SHARED + ALL) >= (F.col("n_a") + F.col("n_b")) * SHARED).select("ga", "gb")


def _first_links(rows: DataFrame, members: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs of a prefix element's groups with its first group, and of a group's members with its first member."""
    near = rows.filter("gid <> first_gid")
    near = near.filter(_sizes_fit(F.col("n"), F.col("first.n")) & _positions_fit(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos")))
    inside = members.filter("key <> gid").select(F.col("gid").alias("a"), F.col("key").alias("b"))
    outside = _prefixes_fit(near.select(F.col("first_gid").alias("ga"), F.col("gid").alias("gb")).distinct(), shared)
    return outside.select(F.col("ga").alias("a"), F.col("gb").alias("b")).unionByName(inside)


def _other_pairs(rows: DataFrame, members: DataFrame, shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of members in different components whose groups share a prefix element or are one group."""
    rooted = stored(members.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node"))
    spread = rooted.groupBy("gid").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n_members"), *[F.first(p).alias(p) for p in PARITIES]
    )
    own = spread.withColumnRenamed("gid", "of")
    known = rows.join(own, F.col("gid") == F.col("of")).drop("of")
    first_root = roots.select(F.col("node").alias("of"), F.col("root").alias("first_root"))
    known = known.join(first_root, F.col("first_gid") == F.col("of"), "left").withColumn("first_root", F.coalesce("first_root", "first_gid"))
    known = stored(known.withColumn("apart", (F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("first_root"))).drop("of", "first"))
    left = known.filter("apart")
    right = known.join(left.select("element").distinct(), "element", "left_semi")
    a, b = left.alias("a"), right.alias("b")
    single = (F.col("a.n_members") == 1) & (F.col("b.n_members") == 1)
    parities = _parities_fit([F.col(f"a.{p}") for p in PARITIES], [F.col(f"b.{p}") for p in PARITIES], F.col("a.n"), F.col("b.n"))
    met = a.join(
        b,
        (F.col("a.element") == F.col("b.element")) & (F.col("a.gid") != F.col("b.gid")) & (~F.col("b.apart") | (F.col("a.gid") < F.col("b.gid")))
        & ~((F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo")))
        & _sizes_fit(F.col("a.n"), F.col("b.n")) & _positions_fit(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"))
        & (~single | parities),
    )
    groups = _prefixes_fit(met.select(F.least("a.gid", "b.gid").alias("ga"), F.greatest("a.gid", "b.gid").alias("gb")).distinct(), shared)
    groups = groups.unionByName(spread.filter("lo <> hi").select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))

    a, b = rooted.alias("a"), rooted.alias("b")
    parities = _parities_fit([F.col(f"a.{p}") for p in PARITIES], [F.col(f"b.{p}") for p in PARITIES], F.col("a.n"), F.col("b.n"))
    pairs = groups.join(a, F.col("ga") == F.col("a.gid")).join(
        b, (F.col("gb") == F.col("b.gid")) & (F.col("a.root") != F.col("b.root")) & parities & ((F.col("ga") != F.col("gb")) | (F.col("a.key") < F.col("b.key")))
    )
    return pairs.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id whose text is reachable over links.

    Every row is returned and whole texts are read. A-Z are lower-cased; a text of one or two words is one shingle; a null or
    wordless text has no shingle and is linked with nothing, so its component_id is its own id. Repeated ids and rows stay
    separate rows; a null id is never the smallest unless a component has no other. An empty table gives no rows; further columns
    are ignored. Sets and their elements are compared by 64-bit hashes.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = stored(_marked(texts, _counted(texts)))
    classes = marked.filter("n > 0").groupBy("key", "n", "prefix", *PARITIES).agg(F.min("id").alias("least_id"))
    classes = stored(classes)
    groups = stored(classes.groupBy("n", "prefix").agg(F.min("key").alias("gid")))
    members = stored(classes.join(groups, ["n", "prefix"]).select("key", "gid", "n", *PARITIES))

    each = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "element"))
    firsts = each.groupBy("element").agg(F.min(F.struct("pos", "n", "gid")).alias("first"), F.count("*").alias("n_groups"))
    rows = each.join(firsts.filter("n_groups > 1").drop("n_groups"), "element").withColumn("first_gid", F.col("first.gid"))
    rows = stored(rows)
    shared = stored(rows.groupBy("gid", "n").agg(F.collect_list("element").alias("elements")))

    links = stored(_verified(stored(_first_links(rows, members, shared)), texts, classes))
    more = stored(_other_pairs(rows, members, shared, stored(components(links))))
    links = links.unionByName(stored(_verified(more, texts, classes)))
    roots = stored(components(links))

    linked = classes.select("key", "least_id").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "of")
    of_key = linked.join(least, F.col("root") == F.col("of")).select(F.col("key").alias("class_key"), "component_id")
    joined = marked.select("id", "key", F.col("n").alias("n_shingles")).join(
        of_key, (F.col("key") == F.col("class_key")) & (F.col("n_shingles") > 0), "left"
    )
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select("id", "n_shingles", component.alias("component_id"))
