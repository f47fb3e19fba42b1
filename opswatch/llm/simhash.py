"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most four bits agree up to one bit in one of three parts of the 64 bits
(22, 21 and 21 bits wide). Each part, padded with zeros, is a point of the 23-bit space whose anchors are the 4,096
codewords of the perfect binary Golay code: every point lies within the covering radius 3 of exactly one anchor,
its home. A fingerprint is replicated to every anchor within covering radius plus threshold, 3 + 1, of each of
its parts; one of two linked fingerprints is at home at an anchor the other one visits. At an anchor homes are
compared with visitors on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: (shift, width) of the parts
PARTS = ((0, 22), (22, 21), (43, 21))
RADIUS, CODE_BITS = 3, 23
#: generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code (fixed value)
GENERATOR = 0b101011100011
#: one part of two linked fingerprints differs in at most BITS // 3 bits
BITS = 4
#: homes compared with all visitors of an anchor at once, which bounds the comparison matrix
ROWS_AT_ONCE = 256

_UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _remainders(values: np.ndarray) -> np.ndarray:
    """Remainders of the 23-bit polynomials ``values`` by the generator (11 bits)."""
    out = values.astype(np.int64).copy()
    for shift in range(CODE_BITS - 12, -1, -1):
        out ^= np.where(out >> (shift + 11) & 1, GENERATOR << shift, 0)
    return out


@cache
def _coset_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each remainder: the error pattern of weight 3 or less, and the patterns of weight 4 (padded by -1)."""
    bits = [1 << k for k in range(CODE_BITS)]
    near = np.zeros(2048, dtype=np.int64)
    light = [0, *bits]
    light += [bits[a] | bits[b] for a in range(23) for b in range(a)]
    light += [bits[a] | bits[b] | bits[c] for a in range(23) for b in range(a) for c in range(b)]
    near[_remainders(np.array(light))] = light
    four = np.array(
        [bits[a] | bits[b] | bits[c] | bits[d] for a in range(23) for b in range(a) for c in range(b) for d in range(c)]
    )
    by = _remainders(four)
    order = np.argsort(by, kind="stable")
    counts = np.bincount(by, minlength=2048)
    wide = np.full((2048, counts.max()), -1, dtype=np.int64)
    column = np.arange(len(four)) - np.repeat(np.cumsum(counts) - counts, counts)
    wide[by[order], column] = four[order]
    return near, wide, counts


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, at home) of every anchor within radius 4 of every part; the key holds part and anchor."""
    near, wide, _ = _coset_tables()
    rows, keys, homes = [], [], []
    for part, (shift, width) in enumerate(PARTS):
        point = (prints >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        rest = _remainders(point)
        home = point ^ near[rest]
        rows.append(np.arange(len(point)))
        keys.append(home | part << CODE_BITS)
        homes.append(np.ones(len(point), dtype=bool))
        patterns = wide[rest]
        row, column = np.nonzero(patterns >= 0)
        rows.append(row)
        keys.append((point[row] ^ patterns[row, column]) | part << CODE_BITS)
        homes.append(np.zeros(len(row), dtype=bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def fingerprint(text: str | None, size: int, hasher) -> int:
    words = (text or "").encode().translate(_UPPER_TO_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= size:
        values = np.array([hasher(line, 42)], dtype=np.uint64)
    else:
        starts = np.concatenate(([0], stops[:-size] + 1)).tolist()
        values = np.fromiter(
            (hasher(line[a:b], 42) for a, b in zip(starts, stops[size - 1 :].tolist())),
            dtype=np.uint64,
            count=len(words) - size + 1,
        )
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(values), 65536):
        bits = np.unpackbits(values[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print bigint) of whole texts: bit set in over half of the shingles' 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            values = [fingerprint(t, size, xxh64_intdigest) for t in batch.column(1).to_pylist()]
            prints = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "print"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, print bigint")


def _replicas(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("print").to_numpy()
            for k in range(0, len(values), 50_000):
                some = values[k : k + 50_000]
                row, key, home = anchors(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(some[row]), pa.array(home)], names=["anchor", "print", "home"]
                )

    return prints.mapInArrow(run, "anchor bigint, print bigint, home boolean")


def _forest(homes: np.ndarray, visitors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor that connect whatever its comparisons connect, at most one for each visitor."""
    every = np.concatenate([homes, visitors])
    parent = np.arange(len(every))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    for k in range(0, len(homes), ROWS_AT_ONCE):
        near = np.bitwise_count(homes[k : k + ROWS_AT_ONCE, None] ^ every[None, :]) <= bits
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            a, b = root(i + k), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((i + k, j))
    if not found:
        return every[:0], every[:0]
    pairs = np.array(found)
    return every[pairs[:, 0]], every[pairs[:, 1]]


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most ``bits`` (0 to 5) bits.

    Of the links found at an anchor a spanning forest is kept, so an anchor returns no more rows than it was
    sent, however dense a group of near copies is; the connected components are those of all links.
    """
    if not 0 <= bits <= 5:
        raise ValueError("three parts with one differing bit cover up to 5 bits")

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visitors = [], []
        for batch in batches:
            value, home = batch.column("print").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)
            homes.append(value[home])
            visitors.append(value[~home])
        at_home = np.concatenate(homes)
        if len(at_home):
            a, b = _forest(at_home, np.concatenate(visitors), bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return _replicas(prints).groupBy("anchor").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, bits: int = BITS, size: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, print, component_id): component_id is the smallest id whose text is reachable over links.

    Every row is returned, whole texts are read. Texts are lower-cased (A-Z), a text with fewer words than
    ``size`` is one shingle, a null or wordless text has fingerprint zero and links like any other. Repeated
    ids and rows stay separate rows; a null id is never the smallest unless a component has no other. An
    empty table gives no rows; further columns are ignored. Copies share a fingerprint and are counted once
    before anything is compared.
    """
    marked = stored(fingerprints(docs, size, id_col, text_col))
    distinct = marked.groupBy("print").agg(F.min("id").alias("least_id"))
    roots = stored(components(links(distinct.select("print"), bits)))
    linked = distinct.join(roots, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = (
        linked.select("print", "root")
        .join(least.withColumnRenamed("root", "of"), F.col("root") == F.col("of"))
        .select(F.col("print").alias("class_print"), "component_id")
    )
    return marked.join(classes, F.col("print") == F.col("class_print")).select("id", "print", "component_id")
