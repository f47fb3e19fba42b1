"""Near copies by SimHash on anchors, verified by exact Jaccard of five-word shingles.

A text is the set of 64-bit hashes of its runs of five words and has five SimHash fingerprints of that set. Each fingerprint
is at home at and visits the anchors of ``simhash``; there texts meet whose first three fingerprints differ in at most 50
of 192 bits, where Jaccard 0.8 lets 29 differ on average. Texts of one anchor that such meetings connect are a bucket. Two texts of Jaccard
0.8 meet nowhere with a probability of 2e-4, nearer ones less often. 32 bands of six minimum hashes are buckets as well, for the pairs
that no anchor brings together: they miss 5e-5. Each candidate is verified on the whole sets. A bucket first compares its texts with
one of them, twice with different ones, which joins a large group of near copies with as many comparisons as it has texts.

The texts of buckets that are still apart then meet at the elements of their prefixes: in one order of the elements, rare ones first, two sets of
Jaccard 0.8 share one of the first n / 5 + 1 of the larger and the first m / 9 + 1 of the smaller. An element's texts first meet one of its largest
component, the one that has it earliest, as the original of a group of copies does; afterwards only texts outside that component meet the others.
Sizes, places of the element and parities of the sets rule out pairs inside the join, without loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, stored
from .components import components
from .simhash import _UPPER_TO_LOWER, CODE_BITS, PARTS, ROWS_AT_ONCE, anchors

SIZE = 5
#: linked texts have a Jaccard of at least 4 / 5
SHARED, ALL = 4, 5
BANDS, ROWS = 32, 6
#: fingerprints of a text, those of them whose bits are compared at an anchor, and the bits in which these may differ
PRINTS, COMPARED, APART = 5, 3, 50
#: anchors of one part that a task takes together: 2 to the power of this
TOGETHER = 6
#: rounds in which a bucket's texts meet one of them
STARS = 2
#: a set has the parity of how many of its elements fall into each of 512 slots, as eight numbers
PARITIES = [f"parity_{k}" for k in range(8)]
#: shingles whose minimum hashes are computed at once
AT_ONCE = 2048

_TURNS = np.random.default_rng(8_064).integers(0, 2**64, (2, PRINTS), dtype=np.uint64) | np.uint64(1)
_DRAWN = np.random.default_rng(20_240_131).integers(0, 2**64, (3, BANDS * ROWS), dtype=np.uint64)
_FACTORS, _ADDED, _MIXED = _DRAWN[0] | np.uint64(1), _DRAWN[1], _DRAWN[2] | np.uint64(1)


def shingles(text: str | None, hasher: Callable[[bytes, int], int], size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one run, one without words has none."""
    words = (text or "").encode().translate(_UPPER_TO_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([hasher(line, 42)], dtype=np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-size] + 1)).tolist()
    return np.unique(np.array([hasher(line[a:b], 42) for a, b in zip(starts, stops[size - 1 :].tolist())], dtype=np.uint64))


def buckets(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of the minimum hashes of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), AT_ONCE):
        some = values[k : k + AT_ONCE, None] * _FACTORS
        some += _ADDED
        np.minimum(least, some.min(axis=0), out=least)
    mixed = (least ^ least >> np.uint64(29)) * _MIXED
    return np.bitwise_xor.reduce((mixed ^ mixed >> np.uint64(32)).reshape(BANDS, ROWS), axis=1)


def prints(values: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of a set: each of a hash of its own, a bit is set where it is in over half of the hashes."""
    total = np.zeros(PRINTS * 64, dtype=np.int64)
    for k in range(0, len(values), 255):  # as many as a byte can count
        hashed = values[k : k + 255, None] * _TURNS[0]
        hashed = (hashed ^ hashed >> np.uint64(31)) * _TURNS[1]
        hashed ^= hashed >> np.uint64(32)
        total += np.add.reduce(np.unpackbits(hashed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(values), bitorder="little").view(np.uint64)


def _replicas(marked: DataFrame) -> DataFrame:
    """Each set's compared fingerprints at every anchor where one of its fingerprints is at home or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            own = batch.column("prints").flatten().to_numpy().reshape(-1, PRINTS)
            for turn in range(PRINTS):
                row, anchor, home = anchors(np.ascontiguousarray(own[:, turn]).view(np.uint64))
                anchor = anchor + (turn * len(PARTS) << CODE_BITS)
                words = [pa.array(own[row, w]) for w in range(COMPARED)]
                columns = [pa.array(anchor >> (CODE_BITS - 12 + TOGETHER)), pa.array(anchor), pa.array(home), pa.array(key[row]), *words]
                yield pa.RecordBatch.from_arrays(columns, names=["task", "anchor", "home", "key", *(f"w{w}" for w in range(COMPARED))])

    words = ", ".join(f"w{w} bigint" for w in range(COMPARED))
    return marked.select("key", "prints").mapInArrow(run, f"task bigint, anchor bigint, home boolean, key bigint, {words}")


def gathered(words: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For each row of an anchor the first row of its group: rows are joined where a home differs from another row in at most APART bits.

    A row that has been compared with all that are not in a group yet need not be compared again, so a dense group costs as many comparisons as
    it has rows.
    """
    group = np.arange(len(words))
    free = np.ones(len(words), dtype=bool)

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        apart = sum(np.bitwise_count(words[some, w][:, None] ^ words[others, w][None, :]).astype(np.uint16) for w in range(words.shape[1]))
        met = apart <= APART
        return met & (home[some][:, None] | home[others][None, :])

    heads = np.nonzero(home)[0]
    for k in range(0, len(heads), ROWS_AT_ONCE):
        block = heads[k : k + ROWS_AT_ONCE]
        block = block[free[block]]
        left = np.nonzero(free)[0]
        alone = near(block, left).sum(axis=1) == 1
        free[block[alone]] = False
        for first in block[~alone].tolist():
            if not free[first]:
                continue
            free[first] = False
            queue = [np.array([first])]
            while queue:
                some = queue.pop()
                left = np.nonzero(free)[0]
                if len(left) == 0:
                    break
                found = left[near(some, left).any(axis=0)]
                group[found], free[found] = first, False
                queue += [found[i : i + ROWS_AT_ONCE] for i in range(0, len(found), ROWS_AT_ONCE)]
    return group


def _meetings(marked: DataFrame) -> DataFrame:
    """(bucket, key) of the sets that meet others at an anchor; ``marked`` has each key once."""

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "home", "key", *(f"w{w}" for w in range(COMPARED))]
        parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
        anchor, home, keys, *words = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(anchor, kind="stable")
        bits = np.stack(words, axis=1).view(np.uint64)
        stops = np.nonzero(np.diff(anchor[order]))[0] + 1
        for rows in np.split(order, stops):
            group = gathered(bits[rows], home[rows])
            members = np.bincount(group, minlength=len(rows))[group] > 1
            if members.any():
                first = keys[rows][group[members]].view(np.uint64)
                bucket = (first ^ np.uint64(anchor[rows[0]])) * _MIXED.flat[0]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(keys[rows][members])], names=["bucket", "key"])

    return _replicas(marked).groupBy("task").applyInArrow(compare, "bucket bigint, key bigint").distinct()


def _sets(docs: DataFrame, with_values: bool) -> DataFrame:
    """(id, key, size, values, prints) of (id, text): the key stands for the set, values are its hashes, or its buckets beside its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingles(t, xxh64_intdigest) for t in batch.column(1).to_pylist()]
            keys = np.array([xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], dtype=np.int32)
            lists = sets if with_values else [buckets(s) if len(s) else s for s in sets]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.concatenate([*lists, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            marks = [prints(s).view(np.int64) if len(s) and not with_values else None for s in sets]
            columns = [batch.column(0), pa.array(keys), pa.array(sizes), values, pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "size", "values", "prints"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, key bigint, size int, values array<bigint>, prints array<bigint>")


def _alike(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can have the Jaccard asked for."""
    return F.least(a, b) * ALL >= F.greatest(a, b) * SHARED


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets have the Jaccard asked for."""
    one = sets.select(F.col("key").alias("a_key"), F.col("values").alias("a_values"))
    two = sets.select(F.col("key").alias("b_key"), F.col("values").alias("b_values"))
    met = pairs.join(two, F.col("b") == F.col("b_key")).join(one, F.col("a") == F.col("a_key"))
    shared = F.size(F.array_intersect("a_values", "b_values"))
    return met.filter(shared * (SHARED + ALL) >= (F.size("a_values") + F.size("b_values")) * SHARED).select("a", "b")


def _apart(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Rows of the buckets whose texts are not in one component of ``roots``, with their component, and the number of these rows."""
    known = stored(rows.drop("root").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node"))
    mixed = known.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    rows, seen = counted(known.join(mixed.select("bucket").hint("merge"), "bucket", "left_semi"))
    return rows, seen["n"]


def _with_stars(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` and one link for each node of earlier components: they connect as all earlier links did, and settle in fewer rounds."""
    return links.unionByName(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """One pair for each text: with one that is the first of a bucket in the order of this turn."""
    first = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("rank"), "key", "root", "size")).alias("x"))
    met = rows.join(first.hint("merge"), "bucket").filter((F.col("root") != F.col("x.root")) & _alike(F.col("size"), F.col("x.size")))
    return met.groupBy(F.col("key").alias("b")).agg(F.min(F.struct("x.rank", "x.key")).alias("x")).select(F.col("x.key").alias("a"), "b")


def _parities(sets: DataFrame) -> DataFrame:
    """(key, values, parities) of (key, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.array(v, dtype=np.int64).view(np.uint64) for v in batch.column("values").to_pylist()]
            odd = [np.bincount((v >> np.uint64(20) & np.uint64(511)).astype(np.int64), minlength=512) & 1 for v in each]
            packed = np.packbits(np.array(odd, dtype=np.uint8).reshape(len(each), 512), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("values"), *map(pa.array, packed.T.copy())], names=["key", "values", *PARITIES])

    return sets.select("key", "values").mapInArrow(run, "key bigint, values array<bigint>, " + ", ".join(f"{p} bigint" for p in PARITIES))


def _prefixes(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(element, pos, key, size, parities): the first size / 5 + 1 elements of each set in ``keys`` that another of them has as well."""
    own = _parities(sets.join(keys, "key", "left_semi"))
    each = stored(own.select("key", F.size("values").alias("size"), *PARITIES, F.explode("values").alias("element")))
    n = each.groupBy("element").agg(F.count("*").alias("n"))
    ranked = each.join(n.hint("merge"), "element").groupBy("key", "size", *PARITIES).agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("ranked"))
    first = F.slice("ranked", F.lit(1), F.expr(f"size * {ALL - SHARED} DIV {ALL} + 1").cast("int"))
    rows = ranked.select("key", "size", *PARITIES, F.posexplode(first).alias("pos", "x"))
    return stored(rows.filter("x.n > 1").select(F.col("x.element").alias("element"), "pos", "key", "size", *PARITIES))


def _may_link(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """False only for sets that cannot have the Jaccard asked for, from their sizes, the places of an element that both have, and their parities.

    Sets differ in at least as many elements as parities; of sets that link at most (n + m) / 9 differ.
    """
    n, m, i, j = a("size"), b("size"), a("pos"), b("pos")
    short = F.when(n <= m, i * (SHARED + ALL) <= n * (ALL - SHARED)).otherwise(j * (SHARED + ALL) <= m * (ALL - SHARED))
    places = (F.least(i, j) + F.least(n - i, m - j)) * (SHARED + ALL) >= (n + m) * SHARED
    differing = reduce(lambda x, y: x + y, [F.bit_count(a(p).bitwiseXOR(b(p))) for p in PARITIES])
    return _alike(n, m) & short & places & (differing * (SHARED + ALL) <= (n + m) * (ALL - SHARED))


def _mixed(prefixes: DataFrame, links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Prefix rows of the elements whose texts are not yet in one component, with the largest component there and its first text.

    ``roots`` are the components of ``links``, where these are known.
    """
    roots = stored(components(links)) if roots is None else roots
    known = prefixes.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    known = stored(known)
    of_root = known.groupBy("element", "root").agg(F.count("*").alias("n"), F.min(F.struct("pos", "size", "key", *PARITIES)).alias("first"))
    largest = of_root.groupBy("element").agg(F.count("*").alias("n_roots"), F.max(F.struct("n", "root", "first")).alias("x")).filter("n_roots > 1")
    largest = largest.select("element", F.col("x.root").alias("main"), F.col("x.first").alias("first"))
    return stored(known.join(largest.hint("merge"), "element"))


def _first_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of the texts outside an element's largest component with the first text of that."""
    met = mixed.filter("root <> main").filter(_may_link(F.col, lambda c: F.col(f"first.{c}")))
    return met.select(F.col("first.key").alias("a"), F.col("key").alias("b")).distinct()


def _other_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs in different components that share a prefix element and may link; one text at least is outside the element's largest component."""
    a, b = mixed.filter("root <> main").alias("a"), mixed.alias("b")
    apart = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.key") < F.col("b.key")))
    met = a.join(b, (F.col("a.element") == F.col("b.element")) & apart & _may_link(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")))
    return met.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, component_id): component_id is the smallest id whose text is reachable over pairs of Jaccard 0.8.

    Every row is returned, whole texts are read. Texts are lower-cased (A-Z); null and wordless texts are one
    component. Repeated ids and rows stay separate rows; a null id is never the smallest unless a component has no
    other. Texts with equal sets are counted once before anything is compared.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = stored(_sets(texts, with_values=False))
    each = marked.select("key", "size", F.explode("values").alias("bucket")).distinct()
    full = each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    met = stored(_meetings(marked.filter("size > 0").select("key", "prints").dropDuplicates(["key"])))
    sized = marked.select(F.col("key").alias("of_key"), "size").join(met.select("key").distinct(), F.col("of_key") == F.col("key"), "left_semi").distinct()
    meeting = met.join(sized, F.col("key") == F.col("of_key")).select("bucket", "key", "size")
    rows = stored(meeting.unionByName(each.join(full.hint("merge"), "bucket", "left_semi")))

    ids = marked.join(rows.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("id").alias("needed"))
    needed = texts.join(ids.select("needed").distinct(), F.col("id").eqNullSafe(F.col("needed")), "left_semi")
    sets = stored(_sets(needed, with_values=True).groupBy("key").agg(F.first("values").alias("values")))

    # components are computed anew only where links came in: each time is a few queries more, however few the links are
    links, roots, left = None, None, rows.withColumn("root", F.col("key"))
    for turn in range(STARS):
        found, seen = counted(_verified(_stars(left, turn), sets))
        if links is None or seen["n"]:
            links = found if roots is None else _with_stars(found, roots)
            roots = stored(components(links))
            left, n = _apart(left, roots)
        if n == 0:
            break
    else:
        prefixes = _prefixes(left.select("key").distinct(), sets)
        for pairs in (_first_pairs, _other_pairs):
            found, seen = counted(_verified(pairs(_mixed(prefixes, links, roots)), sets))
            if seen["n"]:
                links = _with_stars(found, roots)
                roots = stored(components(links))

    classes = marked.groupBy("key").agg(F.min("id").alias("least_id"))
    linked = classes.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "of")
    of_key = linked.join(least.hint("merge"), F.col("root") == F.col("of")).select(F.col("key").alias("class_key"), "component_id")
    return marked.join(of_key, F.col("key") == F.col("class_key")).select("id", "key", "component_id")
