"""Detection of personal data in text and in the string leaves of JSON.

One Arrow UDF finds matches with their positions, because Spark's own regular expression functions report no
positions and cannot normalise Unicode. A native filter decides which rows need it at all; the rest reach Python
as NULL and cost nothing there.
"""

from __future__ import annotations

import functools
import json
import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from opswatch.functions.field_paths import child_path

MATCH = "struct<path: string, ordinal: int, start: int, end: int, match: string>"
DETECTION = f"struct<structured: boolean, normalized: string, matches: array<{MATCH}>>"
SPACE = r"\t\n\f\r "
UNSUPPORTED = re.compile(r"\(\?(?:<?[=!]|P=|\()|(?<!\\)(?:\\\\)*\\[1-9]")
POSSESSIVE = re.compile(r"\(\?>|[*+?}]\+")
FLAGS = re.compile(r"\(\?([A-Za-z-]+)[:)]")
NAMED_CLASS = re.compile(r"\[:(\^?\w+):\]")
#: fixed values: the named classes of the pattern language, as ASCII ranges
NAMED = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7f",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1f\x7f",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0b\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
#: a class by general category: ``\pL``, ``\p{Lu}``, negated ``\PL``, ``\p{^Lu}``
CATEGORY = re.compile(r"\\([pP])(?:([A-Z])|\{(\^?)(\w+)\})")
REPEAT = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
FLAG_GROUP = re.compile(r"\(\?([A-Za-z-]+)([:)])")
CLASS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]")


class NotJson(ValueError):
    """Text that is not one JSON object, array or string."""


# --- patterns ---


def code_point(code: int) -> str:
    return f"\\x{code:02x}" if code < 128 else chr(code)


@functools.cache
def category_ranges(name: str, negated: bool) -> str:
    """Code points of a general category, or of all that begin with the letter, as ranges for the inside of a class.

    Lone surrogates stand in no text and in no range.
    """
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        held = name == "Any" or (kind != "Cn" and kind.startswith(name))
        if kind != "Cs" and held != negated:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(code_point(a) if a == b else f"{code_point(a)}-{code_point(b)}" for a, b in ranges)


@functools.cache
def categories() -> frozenset[str]:
    found = {unicodedata.category(chr(code)) for code in range(sys.maxunicode + 1)} - {"Cs", "Cn"}
    return frozenset(found | {kind[0] for kind in found} | {"Any"})


def category_class(m: re.Match, native: bool) -> str:
    """What a category class stands for, for the inside of a class; with ``native`` by the JVM's own table."""
    name, negated = m.group(2) or m.group(4), (m.group(1) == "P") != (m.group(3) == "^")
    if name not in categories() or (name == "Any" and negated):
        raise re.error("unknown or empty category", m.string, m.start())
    if native and name != "Any":
        return f"\\{'P' if negated else 'p'}{{{name}}}"
    return category_ranges(name, negated)


def greedy_by_default(pattern: str) -> str:
    """The pattern without the flag U, which swaps the meaning of ``x*`` and ``x*?`` up to the end of its group."""
    if not any("U" in flags for flags, _ in FLAG_GROUP.findall(pattern)):
        return pattern
    out: list[str] = []
    swapped, i = [False], 0
    while i < len(pattern):
        if quoted := re.compile(r"\\Q.*?(?:\\E|\Z)", re.DOTALL).match(pattern, i):
            out.append(quoted.group())
            i = quoted.end()
        elif escaped := re.compile(r"\\[pPx]\{[^}]*\}").match(pattern, i) or CLASS.match(pattern, i):
            out.append(escaped.group())
            i = escaped.end()
        elif flags := FLAG_GROUP.match(pattern, i):
            on, _, off = flags.group(1).partition("-")
            state = True if "U" in on else False if "U" in off else swapped[-1]
            kept = on.replace("U", "") + ("-" + off.replace("U", "") if off.replace("U", "") else "")
            if flags.group(2) == ":":
                swapped.append(state)
                out.append(f"(?{kept}:")
            else:
                swapped[-1] = state
                out.append(f"(?{kept})" if kept else "")
            i = flags.end()
        elif pattern[i] == "(":
            swapped.append(swapped[-1])
            out.append("(?" if pattern.startswith("(?", i) else "(")
            i += len(out[-1])
        elif pattern[i] == ")":
            if len(swapped) > 1:
                swapped.pop()
            out.append(")")
            i += 1
        elif repeat := REPEAT.match(pattern, i):
            lazy = pattern.startswith("?", repeat.end())
            out.append(repeat.group() + ("?" if lazy != swapped[-1] else ""))
            i = repeat.end() + lazy
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def portable(pattern: str, end_of_text: str, native: bool = False) -> str:
    """The pattern with one meaning in every engine used: ASCII classes, ``$`` only at the very end.

    Named classes, general categories, quoted text and code points in braces are written out, the flag U is resolved; an unknown
    or negated named class and an unknown category are errors. With ``native`` categories keep their name, which the JVM looks up
    in one step while it tries ranges one by one; its table may differ outside ASCII.
    """
    pattern = greedy_by_default(pattern)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            following = pattern[i + 1]
            if following == "Q" and not in_class:
                end = pattern.find("\\E", i + 2)
                end = len(pattern) if end < 0 else end
                out.append(re.escape(pattern[i + 2 : end]))
                i = end + 2
                continue
            if point := re.match(r"\\x\{([0-9A-Fa-f]{1,6})\}", pattern[i:]):
                code = int(point.group(1), 16)
                if code > 0x10FFFF:
                    raise re.error("no such code point", pattern, i)
                out.append(re.escape(chr(code)))
                i += point.end()
                continue
            if following in "pP":
                kind = CATEGORY.match(pattern, i)
                if kind is None:
                    raise re.error("malformed category", pattern, i)
                members = category_class(kind, native)
                out.append(members if in_class else f"[{members}]")
                i = kind.end()
                continue
            if following == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif following == "S" and not in_class:
                out.append(f"[^{SPACE}]")
            elif following == "z":
                out.append(end_of_text)
            else:
                out.append(c + following)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "$" and not in_class:
            out.append(end_of_text)
        elif in_class and (named := NAMED_CLASS.match(pattern, i)):
            if named.group(1) not in NAMED:
                raise re.error("unknown named class", pattern, i)
            out.append(NAMED[named.group(1)])
            i = named.end()
            continue
        elif c in "[&" and in_class:
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def anchored(pattern: str) -> bool:
    """Whether the pattern looks at the edges of the text."""

    def plain(m: re.Match) -> str:
        return m.group() if m.group() in (r"\A", r"\z", r"\Z", r"\B") else ""

    rest = CLASS.sub(plain, pattern)
    return any(edge in rest for edge in ("^", "$", "\\"))


def compiles(pattern: str) -> bool:
    """Whether the detector can run.

    Look-around, back references, atomic groups, possessive repeats and flags other than i, m and s are not part of the
    pattern language.
    """
    try:
        written = portable(pattern, r"\Z")
        plain = CLASS.sub("x", written)
        if UNSUPPORTED.search(written) or POSSESSIVE.search(plain) or any(set(f) - set("ims-") for f in FLAGS.findall(plain)):
            return False
        re.compile(written, re.ASCII)
    except re.error:
        return False
    return True


def compiled(patterns: list[tuple[int, str]]) -> list[tuple[int, re.Pattern]]:
    return [(ordinal, re.compile(portable(p, r"\Z"), re.ASCII)) for ordinal, p in patterns]


def may_match(text: Column, patterns: list[str], in_json: bool) -> Column:
    """False only for text that certainly holds no match.

    Text outside ASCII may change when normalised, escaped JSON hides its characters, and anchors mean another
    place inside a leaf; such text is always examined.
    """
    certain = F.octet_length(text) == F.char_length(text)
    if in_json:
        if any(anchored(p) for p in patterns):
            return text.isNotNull()
        certain = certain & ~text.contains("\\")
    hit: Column = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike("(?d)" + portable(p, r"\z", native=True))
    return ~certain | hit


# --- JSON ---


def _number(text: str):
    if math.isinf(float(text)):
        raise NotJson("number out of range")
    return RawNumber(text)


def _no_constant(text: str):
    raise NotJson(text)


class RawNumber:
    """A number kept as its own text."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def parse_json(text: str):
    """Root object, array or string of strict JSON, numbers kept as text."""
    try:
        root = json.loads(text, parse_float=_number, parse_int=_number, parse_constant=_no_constant)
    except (ValueError, RecursionError) as problem:
        raise NotJson(str(problem)) from problem
    if not isinstance(root, dict | list | str):
        raise NotJson("neither object, array nor string")
    return root


def string_leaves(node, path: str = "") -> Iterator[tuple[str, str]]:
    """Every string leaf with its path."""
    if isinstance(node, str):
        yield path, LONE_SURROGATE.sub("�", node)
    elif isinstance(node, dict):
        for key, value in node.items():
            yield from string_leaves(value, child_path(path, LONE_SURROGATE.sub("�", key)))
    elif isinstance(node, list):
        for i, value in enumerate(node):
            yield from string_leaves(value, f"{path}[{i}]")


def json_text(node) -> str:
    """Compact JSON with sorted keys and untouched number text."""
    if isinstance(node, dict):
        inner = ",".join(f"{json_text(k)}:{json_text(node[k])}" for k in sorted(node))
        return "{" + inner + "}"
    if isinstance(node, list):
        return "[" + ",".join(json_text(v) for v in node) + "]"
    if isinstance(node, RawNumber):
        return node.text
    if isinstance(node, str):
        return json.dumps(LONE_SURROGATE.sub("�", node), ensure_ascii=False)
    return json.dumps(node)


def map_strings(node, change: Callable[[str, str], str], path: str = ""):
    """The same structure with every string leaf replaced by ``change(path, leaf)``."""
    if isinstance(node, str):
        return change(path, LONE_SURROGATE.sub("�", node))
    if isinstance(node, dict):
        return {k: map_strings(v, change, child_path(path, LONE_SURROGATE.sub("�", k))) for k, v in node.items()}
    if isinstance(node, list):
        return [map_strings(v, change, f"{path}[{i}]") for i, v in enumerate(node)]
    return node


# --- matches ---


def matches_in(text: str, patterns: list[tuple[int, re.Pattern]], path: str = "") -> list[dict]:
    """Matches of every pattern in normalised text, positions counted in characters."""
    return [
        {"path": path, "ordinal": ordinal, "start": m.start(), "end": m.end(), "match": m.group()}
        for ordinal, pattern in patterns
        for m in pattern.finditer(text)
    ]


def examine(text: str, patterns: list[tuple[int, re.Pattern]], in_json: bool) -> tuple[bool, str | None, list[dict]]:
    """(structured, normalised text if it differs, matches in order of path, detector and position)."""
    if in_json:
        try:
            root = parse_json(text)
        except NotJson:
            pass
        else:
            found = [
                m for path, leaf in string_leaves(root) for m in matches_in(unicodedata.normalize("NFC", leaf), patterns, path)
            ]
            return True, None, sorted(found, key=lambda m: (m["path"], m["ordinal"], m["start"]))
    normal = unicodedata.normalize("NFC", text)
    return False, None if normal == text else normal, matches_in(normal, patterns)


def detector_udf(patterns: list[tuple[int, str]], in_json: bool):
    """UDF text -> detection; NULL text gives NULL.

    Declared non-deterministic so that the optimizer never copies it, or what is built on it, into a later UDF.
    """

    @F.pandas_udf(DETECTION)
    def detect(texts: pd.Series) -> pd.DataFrame:
        ready = compiled(patterns)
        rows = [(None, None, None) if t is None else examine(t, ready, in_json) for t in texts]
        return pd.DataFrame(rows, columns=["structured", "normalized", "matches"], dtype=object)

    return detect.asNondeterministic()


LEAF = "array<struct<path: string, value: string>>"


def leaf_rows(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    try:
        return [{"path": p, "value": v} for p, v in string_leaves(parse_json(text))]
    except NotJson:
        return None


def json_leaves(text: Column) -> Column:
    """Array of the string leaves (path, value) of JSON text; NULL when the text is not JSON."""

    @F.pandas_udf(LEAF)
    def leaves(texts: pd.Series) -> pd.Series:
        return pd.Series([leaf_rows(t) for t in texts], dtype=object)

    return leaves(text)


def replaced(text: str, todo: list[dict]) -> str:
    """Text with spans replaced, from the pieces between them; ``todo`` is in order of start.

    Where spans overlap they are replaced one after the other, last first.
    """
    stops = [0, *(s["end"] for s in todo)]
    if any(s["start"] < stop for s, stop in zip(todo, stops)):
        for s in reversed(todo):
            text = text[: s["start"]] + s["replacement"] + text[s["end"] :]
        return text
    pieces = [part for s, stop in zip(todo, stops) for part in (text[stop : s["start"]], s["replacement"])]
    return "".join([*pieces, text[stops[-1] :]])


def rewrite_leaves(text: str, spans: list[dict]) -> str | None:
    """JSON with the spans of its leaves replaced; NULL when a span does not hold what was found there.

    A span without replacement is only verified. Text without a replacement comes back byte for byte.
    """
    try:
        root = parse_json(text)
    except NotJson:
        return None
    by_path: dict[str, list[dict]] = {}
    for span in spans:
        by_path.setdefault(span["path"], []).append(span)
    verified = 0

    def change(path: str, leaf: str) -> str:
        nonlocal verified
        mine = by_path.get(path)
        if not mine:
            return leaf
        normal = unicodedata.normalize("NFC", leaf)
        good = [s for s in mine if 0 <= s["start"] < s["end"] <= len(normal) and normal[s["start"] : s["end"]] == s["match"]]
        verified += len(good)
        todo = sorted((s for s in good if s["replacement"] is not None), key=lambda s: s["start"])
        return replaced(normal, todo) if todo else leaf

    changed = map_strings(root, change)
    if verified != len(spans):
        return None
    return json_text(changed) if any(s["replacement"] is not None for s in spans) else text


def rewrite_json(text: Column, spans: Column) -> Column:
    """Rewritten JSON; NULL text, or a rewrite that failed, gives NULL."""

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewrite_leaves(t, list(s)) for t, s in zip(texts, found)], dtype=object)

    return rewrite(text, spans)
