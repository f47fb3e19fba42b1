"""Texts as codes of distinct words, and values of words joined back by position.

Each task packs its documents into blocks. A block holds a list of its distinct words and, for each document, the
positions' word numbers. (block, word) pairs are what meets other data by word; what is found for a word
comes back by block and is laid out by position. So a word travels once for each block, not once for each
occurrence, and every task holds one block at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes of text after which a block is closed; a longer text is a block of its own
BLOCK_BYTES = 24 << 20


def _pack(values: np.ndarray, compressor) -> bytes:
    return compressor.compress(np.ascontiguousarray(values, dtype="<u4").tobytes())


def _unpack(blob: bytes, decompressor) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(blob), dtype="<u4")


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks and stages, and keeps what it once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(docs: DataFrame, split: Callable[[], Callable[[str], list]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, id, counted, codes, words, sizes, uses): rows of documents, and one row of words for each block.

    ``docs`` has id, text and counted (boolean). ``split()`` is called once in each task and returns the function that
    splits a text. A block is closed after ``block_bytes`` of text. The row of words has them as one string with their lengths, and how often each occurs in
    counted documents.
    """
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor, cut = zstandard.ZstdCompressor(level=3), split()
        task = TaskContext.get().partitionId()
        number = 0
        known: dict = {}
        rows: list[dict] = []
        uses: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            words = [w if isinstance(w, bytes) else w.encode() for w in known]
            used = np.zeros(len(words), dtype=np.int64)
            for codes in uses:
                used += np.bincount(codes, minlength=len(words))
            rows.append(
                {
                    "words": compressor.compress(b"".join(words)),
                    "sizes": _pack(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), compressor),
                    "uses": _pack(used, compressor),
                }
            )
            for row in rows:
                row["block"] = task << 24 | number
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            schema = pa.schema(
                [("block", pa.int64()), ("id", batch.schema.field("id").type), ("counted", pa.bool_())]
                + [(c, pa.binary()) for c in ("codes", "words", "sizes", "uses")]
            )
            for row in zip(*[batch.column(c) for c in ("id", "text", "counted")]):  # one text at a time leaves Arrow's memory
                key, text, counted = (value.as_py() for value in row)
                codes = np.array([known.setdefault(w, len(known)) for w in cut(text or "")], dtype=np.int64)
                rows.append({"id": key, "counted": bool(counted), "codes": _pack(codes, compressor)})
                if counted:
                    uses.append(codes.astype(np.uint32))
                size += len(text or "") + 64
                if size >= block_bytes:
                    yield closed()
                    known, rows, uses, size, number = {}, [], [], 0, number + 1
                    _give_back()
        if rows:
            yield closed()
        known, rows, uses = {}, [], []
        _give_back()

    fields = f"block bigint, id {id_type}, counted boolean, codes binary, words binary, sizes binary, uses binary"
    return docs.select("id", "text", "counted").mapInArrow(run, fields)


def _word_list(words: bytes, sizes: bytes, decompressor) -> list[bytes]:
    text, stops = decompressor.decompress(words), np.cumsum(_unpack(sizes, decompressor)).tolist()
    return [text[a:b] for a, b in zip([0, *stops[:-1]], stops)]


def block_words(packed: DataFrame) -> DataFrame:
    """(block, word binary, uses) for every distinct word of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.filter(pc.is_valid(batch.column("words"))).to_pylist():
                words = _word_list(row["words"], row["sizes"], decompressor)
                uses = _unpack(row["uses"], decompressor).astype(np.int64)
                for k in range(0, len(words), 50_000):
                    some = words[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]] * len(some), pa.int64()), pa.array(some, pa.binary()), pa.array(uses[k : k + 50_000])],
                        names=["block", "word", "uses"],
                    )

    # no filter and no projection before: the exchange of ``packed`` stays the one that ``by_position`` reads
    return packed.mapInArrow(run, "block bigint, word binary, uses bigint")


def by_position(packed: DataFrame, values: DataFrame, lay_out: Callable, fields: str) -> DataFrame:
    """Join word values back to the documents of each block.

    ``values`` has block, word and further columns. ``lay_out(words, found, rows)`` gets a block's words, for each word its row number in
    the pyarrow table ``found`` (-1: absent), that table, and an iterator of (id, counted, codes); it returns columns of ``fields``.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        at = {w: k for k, w in enumerate(right.column("word").to_pylist())}
        listed = left.filter(pc.is_valid(left.column("words"))).to_pylist()
        words = _word_list(listed[0]["words"], listed[0]["sizes"], decompressor) if listed else []
        found = np.array([at.get(w, -1) for w in words], dtype=np.int64)
        texts = left.filter(pc.is_valid(left.column("codes"))).select(["id", "counted", "codes"])
        rows = (
            (i, c, _unpack(codes, decompressor))
            for i, c, codes in zip(*[texts.column(c).to_pylist() for c in ("id", "counted", "codes")])
        )
        columns = lay_out(words, found, right, rows)
        return pa.Table.from_arrays([texts.column("id").combine_chunks(), *columns], names=names)

    return packed.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, fields)


def requests(packed: DataFrame) -> DataFrame:
    """(bucket, block, slots, sizes, words): the words of each block, dealt by their hash to buckets that all blocks share.

    ``slots`` are the steps from one word's number in the block to the next one's, ``words`` the words as one string.
    """
    buckets = 2 * int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor, decompressor = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.filter(pc.is_valid(batch.column("words"))).to_pylist():
                words = _word_list(row["words"], row["sizes"], decompressor)
                bucket = np.fromiter((crc32(w) % buckets for w in words), dtype=np.int64, count=len(words))
                order = np.argsort(bucket, kind="stable")
                used, first = np.unique(bucket[order], return_index=True)
                out: list[list] = [[], [], []]
                for slots in np.split(order, first[1:]) if len(words) else []:
                    some = [words[k] for k in slots.tolist()]
                    out[0].append(_pack(np.diff(slots, prepend=0), compressor))
                    out[1].append(_pack(np.fromiter(map(len, some), dtype=np.int64, count=len(some)), compressor))
                    out[2].append(compressor.compress(b"".join(some)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int64()), pa.array([row["block"]] * len(used), pa.int64()), *[pa.array(c, pa.binary()) for c in out]],
                    names=["bucket", "block", "slots", "sizes", "words"],
                )

    # as in ``block_words``
    return packed.mapInArrow(run, "bucket bigint, block bigint, slots binary, sizes binary, words binary")


def answered(asked: DataFrame, prepare: Callable[[], Callable[[list[bytes]], list[np.ndarray]]]) -> DataFrame:
    """(block, slots, sizes, ids): for each row of ``requests`` the numbers that belong to its words.

    ``prepare()`` is called once in each task and returns the function from words to arrays of numbers below 2^32. All
    requests for a word reach one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor, decompressor, answer = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), prepare()
        for batch in batches:
            out: list[list] = [[], []]
            for words, sizes in zip(batch.column("words"), batch.column("sizes")):
                found = answer(_word_list(words.as_py(), sizes.as_py(), decompressor))
                out[0].append(_pack(np.fromiter(map(len, found), dtype=np.int64, count=len(found)), compressor))
                out[1].append(_pack(np.concatenate(found), compressor))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("slots"), *[pa.array(c, pa.binary()) for c in out]],
                names=["block", "slots", "sizes", "ids"],
            )
        del answer
        _give_back()

    return asked.repartition("bucket").mapInArrow(run, "block bigint, slots binary, sizes binary, ids binary")


def by_slot(packed: DataFrame, answers: DataFrame, lay_out: Callable, fields: str) -> DataFrame:
    """Join the numbers of words back to the documents of each block.

    ``lay_out(starts, sizes, ids, rows)`` gets the stretch of ``ids`` that belongs to each word number of the block, and an iterator of
    (id, counted, codes); it returns columns of ``fields``. A word without an answer is an error.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        decompressor = zstandard.ZstdDecompressor()

        def joined(column: str, read=lambda blob: blob) -> np.ndarray:
            parts = [read(_unpack(blob.as_py(), decompressor)) for blob in right.column(column)]
            return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")

        listed = left.filter(pc.is_valid(left.column("words"))).column("sizes").to_pylist()
        count = len(_unpack(listed[0], decompressor)) if listed else 0
        slots, length, ids = joined("slots", lambda steps: np.cumsum(steps, dtype=np.int64)), joined("sizes").astype(np.int64), joined("ids")
        if len(slots) != count or len(np.unique(slots)) != count:
            raise ValueError("a block lacks words that were split from it: the input changed between two reads")
        starts, sizes = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
        starts[slots], sizes[slots] = np.cumsum(length) - length, length
        texts = left.filter(pc.is_valid(left.column("codes"))).select(["id", "counted", "codes"])
        rows = (
            (i.as_py(), c.as_py(), _unpack(codes.as_py(), decompressor))
            for i, c, codes in zip(*[texts.column(c) for c in ("id", "counted", "codes")])
        )
        columns = lay_out(starts, sizes, ids, rows)
        _give_back()
        return pa.Table.from_arrays([texts.column("id").combine_chunks(), *columns], names=names)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, fields)


def numbered(docs: DataFrame, id_col: str, text_col: str, counted=None) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(False) if counted is None else counted).alias("counted")
    )
