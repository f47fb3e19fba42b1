"""Paths of JSON leaves such as ``customers[0].phone`` and the patterns that match them."""

from __future__ import annotations

import re


def escape_key(key: str) -> str:
    """Object key as a path segment: ``\\ . [ ]`` are escaped."""
    return re.sub(r"([\\.\[\]])", r"\\\1", key)


def child_path(prefix: str, key: str) -> str:
    return f"{prefix}.{escape_key(key)}" if prefix else escape_key(key)


def pattern_regex(pattern: str) -> str:
    """Anchored regular expression for a path pattern; ``name[*]`` stands for one index of ``name``."""
    segments = []
    for segment in pattern.split("."):
        if segment.endswith("[*]"):
            segments.append(re.escape(segment[:-3]) + r"\[[+-]?[0-9]+\]")
        else:
            segments.append(re.escape(segment))
    return r"\A" + r"\.".join(segments) + r"\z"
