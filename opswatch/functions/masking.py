"""Masking of matched values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mask strategies and defaults of the policy format.
STRATEGIES = ("FULL", "KEEP_PREFIX", "KEEP_SUFFIX", "KEEP_PREFIX_SUFFIX", "PRESERVE_FORMAT", "EMAIL", "FIXED")
DEFAULT_CHARACTER = "*"
DEFAULT_TOKEN = "[MASKED]"
ALPHANUMERIC = r"[\p{L}\p{Nd}]"


def mask_settings(config: dict | None) -> dict:
    """Usable settings from a policy's mask block: upper-case words, counts not below zero, one mask character."""
    config = config or {}
    strategy = str(config.get("strategy") or "").strip().upper()
    text = config.get("maskCharacter") or ""
    if strategy == "FIXED":
        text = text or DEFAULT_TOKEN
    else:
        text = (text or DEFAULT_CHARACTER)[0]
    return {
        "strategy": strategy,
        "character": text,
        "visible": max(int(config.get("visibleCharacters") or 0), 0),
        "local_prefix": max(int(config.get("localVisiblePrefix") or 0), 0),
        "mask_domain": str(config.get("domainMode") or "").strip().upper() == "MASK",
    }


def _fill(character: str, count: Column) -> Column:
    return F.repeat(F.lit(character), F.greatest(count, F.lit(0)).cast("int"))


def _email(value: Column, s: dict) -> Column:
    visible = s["local_prefix"] or s["visible"]
    at = F.instr(value, "@")
    size = F.char_length(value)
    local = F.when(at > 0, at - 1).otherwise(size)
    head = value.substr(F.lit(1), F.least(F.lit(visible), local).cast("int"))
    rest = value.substr((local + 1).cast("int"), size)
    if s["mask_domain"]:
        rest = F.when(at > 0, F.concat(F.lit("@"), _fill(s["character"], size - at))).otherwise(F.lit(""))
    return F.concat(head, _fill(s["character"], local - visible), rest)


def mask(value: Column, config: dict | None) -> Column:
    """Masked form of ``value``. Never the value itself when it holds a letter or digit (FIXED excepted)."""
    s = mask_settings(config)
    character, visible = s["character"], s["visible"]
    size = F.char_length(value)
    everything = _fill(character, size)
    if s["strategy"] == "FIXED":
        return F.when(value.isNotNull(), F.lit(character))
    if s["strategy"] == "KEEP_PREFIX":
        out = F.concat(value.substr(1, visible), _fill(character, size - visible))
    elif s["strategy"] == "KEEP_SUFFIX":
        out = F.concat(_fill(character, size - visible), F.right(value, F.lit(visible)))
    elif s["strategy"] == "KEEP_PREFIX_SUFFIX":
        middle = F.concat(value.substr(1, visible), _fill(character, size - 2 * visible), F.right(value, F.lit(visible)))
        out = F.when(F.lit(2 * visible) >= size, value).otherwise(middle)
    elif s["strategy"] == "PRESERVE_FORMAT":
        replacement = character if character not in "\\$" else "\\" + character
        out = F.regexp_replace(value, ALPHANUMERIC, replacement)
    elif s["strategy"] == "EMAIL":
        out = _email(value, s)
    else:
        out = everything
    unchanged = (out == value) & value.rlike(ALPHANUMERIC)
    return F.when(unchanged, everything).otherwise(out)


def place_marker(text: Column, match: Column, kind: Column, index: Column) -> Column:
    """``text`` with the first occurrence of ``match`` replaced by ``[Type-index]``."""
    marker = F.concat(F.lit("["), kind, F.lit("-"), index.cast("string"), F.lit("]"))
    at = F.position(match, text)
    head = text.substr(F.lit(1), (at - 1).cast("int"))
    tail = text.substr((at + F.char_length(match)).cast("int"), F.char_length(text))
    return F.when(at > 0, F.concat(head, marker, tail)).otherwise(text)


def luhn_valid(match: Column) -> Column:
    """Card check on the letters and digits of a match; anything but digits fails."""
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(match, r"[^\p{L}\p{Nd}]", "")), F.lit(False))
