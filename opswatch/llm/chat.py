"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, encoded once with character offsets, and the sorted spans of the
assistant texts are intersected with the sorted token spans by binary search.

Template: ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>\\n`` for each turn. Inside roles and texts ``<|`` becomes ``<||``,
so no text can hold a control string; ``unescape`` undoes it. The three marks are tokens of their own, added behind the
tokenizer's vocabulary where it lacks them, so every text lies between two marks and no token reaches over its edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)

FORMATTED = (
    "conv_id bigint, n_turns bigint, formatted string, input_ids array<int>, token_starts array<int>, token_stops array<int>, "
    "loss_mask array<tinyint>"
)


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def render(turns: list[tuple[str, str]], learned: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the escaped texts of learned roles, in order."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        at += len(head)
        if role in learned and body:
            spans.append((at, at + len(body)))
        parts += (head, body, END, "\n")
        at += len(body) + len(END) + 1
    return "".join(parts), spans


def masked(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """One for each token that lies in a span.

    Token starts and ends never decrease, so both borders of every span are found by binary search.
    """
    mask = np.zeros(len(starts), dtype=np.int8)
    if spans:
        borders = np.asarray(spans)
        first = np.searchsorted(starts, borders[:, 0], side="left")
        end = np.searchsorted(stops, borders[:, 1], side="right")
        for i, j in zip(first, end):
            mask[i:j] = 1
    return mask


def masked_text(text: str, starts: np.ndarray, stops: np.ndarray, mask: np.ndarray) -> list[str]:
    """The pieces of the text under the mask, one for each unbroken run of masked tokens."""
    edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
    return [text[starts[i] : stops[j - 1]] for i, j in zip(edges[::2].tolist(), edges[1::2].tolist())]


def format_conversations(
    rows: DataFrame, tokenizer_path: str, learned_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: formatted text, token ids with their character offsets, and the loss mask.

    Input: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, role, text (a null
    turn comes first, null roles and texts are empty), repeated rows are repeated turns, a row with a null conv_id
    is a conversation of its own, an empty table gives no rows. A conversation is one value by nature, so its turns
    meet in one row; nothing else is gathered.
    """
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    known = turns.filter(F.col("conv_id").isNotNull())
    alone = turns.filter(F.col("conv_id").isNull()).select("conv_id", F.array("t").alias("turns"))
    grouped = known.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).unionByName(alone)
    learned = frozenset(learned_roles)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        tokenizer.add_tokens([AddedToken(mark, normalized=False, special=False) for mark in (START, SEPARATOR, END)])
        for batch in batches:
            rendered = [
                render([(t["role"], t["text"]) for t in turns], learned) for turns in batch.column("turns").to_pylist()
            ]
            out: dict[str, list[np.ndarray]] = {"ids": [], "starts": [], "stops": [], "mask": []}
            for k in range(0, len(rendered), 64):
                some = rendered[k : k + 64]
                codes = tokenizer.encode_batch([text for text, _ in some], add_special_tokens=False)
                for (_, spans), code in zip(some, codes):
                    starts, stops = np.asarray(code.offsets, dtype=np.int32).reshape(-1, 2).T.copy()
                    out["ids"].append(np.asarray(code.ids, dtype=np.int32))
                    out["starts"].append(starts)
                    out["stops"].append(stops)
                    out["mask"].append(masked(starts, stops, spans))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array([len(t) for t in batch.column("turns")], pa.int64()),
                    pa.array([text for text, _ in rendered], pa.string()),
                    pa.array(out["ids"], ints),
                    pa.array(out["starts"], ints),
                    pa.array(out["stops"], ints),
                    pa.array(out["mask"], pa.list_(pa.int8())),
                ],
                names=[column.split()[0] for column in FORMATTED.split(", ")],
            )

    return grouped.mapInArrow(encode, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read the turns back from a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


READ_BACK = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "n_tokens bigint, n_loss_tokens bigint"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests read from the operator's output alone: turns from the text, the learned text from the offsets of masked tokens."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            lists = [batch.column(c) for c in ("token_starts", "token_stops", "loss_mask")]
            for k, (conv, text) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist())):
                turns = parse(text)
                all_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                starts, stops, mask = (column[k].values.to_numpy() for column in lists)
                loss = "".join(unescape(piece) for piece in masked_text(text, starts, stops, mask))
                rows.append(
                    {
                        "conv_id": conv,
                        "n_turns": len(turns),
                        "turns_sha256": sha256(all_turns.encode()).hexdigest(),
                        "loss_chars": len(loss),
                        "loss_sha256": sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(text),
                        "n_tokens": len(mask),
                        "n_loss_tokens": int(mask.sum()),
                    }
                )
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema(
                    [
                        (name, pa.string() if kind == "string" else pa.int64())
                        for name, kind in (c.split() for c in READ_BACK.split(", "))
                    ]
                ),
            )

    return formatted.mapInArrow(digest, READ_BACK)
