"""Byte-level BPE encoding by a table of distinct words, and decoding by a join from ids to pieces.

Texts are split into words by the tokenizer's own pattern; no merge crosses a word, so each distinct word is
encoded once, in the partition that all its blocks' requests reach, and its ids are joined back by position.
Requests and answers travel as one row for each block and bucket of words; an answer names a word by its number in the block.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import answered, blocks, by_slot, numbered, requests

#: the tokenizer's pattern (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same for texts without the characters of ``_uncommon``
FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

#: bytes of text in a block of words; a longer text is a block of its own
BLOCK_BYTES = 16 << 20
#: words whose ids a task keeps; beyond that it starts a new table
TABLE_WORDS = 300_000
#: documents that leave the decoder together
ROWS_AT_ONCE = 256


@cache
def _uncommon() -> frozenset[str]:
    """Characters that the standard library's classes place elsewhere: letter and other numbers, separators 28 to 31."""
    odd = (c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
    return frozenset("\x1c\x1d\x1e\x1f") | frozenset(odd)


def splitter(special: tuple[str, ...]) -> Callable[[str], list[str]]:
    """Split a text into words; the strings of ``special`` are words of their own wherever they stand."""
    import regex

    fast, exact, uncommon = re.compile(FAST), regex.compile(PATTERN), _uncommon()
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def cut(text: str) -> list[str]:
        find = fast.findall if uncommon.isdisjoint(set(text)) else exact.findall
        if cuts is None or not cuts.search(text):
            return find(text)
        out: list[str] = []
        for k, part in enumerate(cuts.split(text)):
            out += [part] if k % 2 else find(part)
        return out

    return cut


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids): the ids of each whole text as little-endian unsigned 32-bit integers; with ``decoded`` also the text read back from them.

    A null text is empty and has no ids. Rows are encoded one by one, so repeated rows and null or repeated ids
    give as many rows. An empty table gives none; further columns are ignored.
    """
    special = special_strings(tokenizer_path)
    packed = blocks(numbered(docs, id_col, text_col), lambda: splitter(special), BLOCK_BYTES).repartition("block")

    def encoder() -> Callable[[list[bytes]], list[np.ndarray]]:
        tokenizer = _tokenizer(tokenizer_path)
        known: dict[bytes, np.ndarray] = {}  # the distinct words of this partition, at most TABLE_WORDS at a time

        def encoded(words: list[bytes]) -> list[np.ndarray]:
            if len(known) > TABLE_WORDS:
                known.clear()
            new = [w for w in words if w not in known]
            codes = tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)
            known.update((w, np.array(c.ids, dtype="<u4")) for w, c in zip(new, codes))
            return [known[w] for w in words]

        return encoded

    def lay_out(starts, sizes, ids, rows):
        joined = [gathered(starts, sizes, ids, codes).tobytes() for _, _, codes in rows]
        read_back = [pa.array([text_of(i, tokenizer_path) for i in joined], pa.string())] if decoded else []
        return [pa.array(joined, pa.binary()), *read_back]

    id_type = docs.schema[id_col].dataType.simpleString()
    return by_slot(packed, answered(requests(packed), encoder), lay_out, f"id {id_type}, ids binary" + ", text string" * decoded)


def gathered(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The values of each code's stretch, one after another."""
    length = sizes[codes]
    shift = starts[codes] - (np.cumsum(length) - length)
    return values[np.repeat(shift, length) + np.arange(length.sum())]


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces(tokenizer_path: str) -> list[bytes]:
    """The bytes of every id; the vocabulary's size is fixed."""
    tokenizer, byte = _tokenizer(tokenizer_path), byte_of_character()
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, k in tokenizer.get_vocab(with_added_tokens=True).items():
        table[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return table


@cache
def _piece_table(tokenizer_path: str) -> pa.Array:
    return pa.array(pieces(tokenizer_path), pa.large_binary())


def text_of(ids: bytes | None, tokenizer_path: str) -> str:
    """The text of packed ids: the piece of each id, taken by position; bytes that are no UTF-8 become U+FFFD."""
    joined = _piece_table(tokenizer_path).take(pa.array(np.frombuffer(ids or b"", dtype="<u4")))
    stops = np.frombuffer(joined.buffers()[1], dtype=np.int64)
    return joined.buffers()[2].to_pybytes()[: stops[len(joined)]].decode(errors="replace") if len(joined) else ""


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(id, text) of (id, ids): every id is joined to its piece, bytes that are no UTF-8 become U+FFFD.

    The table of pieces is dense in the id and of fixed size, so the join takes pieces by position in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):  # ids and texts of a whole batch would be held twice over
                some = batch.slice(start, ROWS_AT_ONCE)
                texts = pa.array([text_of(ids.as_py(), tokenizer_path) for ids in some.column("ids")], pa.string())
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("ids"), texts], names=["id", "ids", "text"])

    id_type = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {id_type}, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
