"""Policy documents: detectors, rule matching, overlap resolution, replacements, all inside a row.

A policy is configuration held by the driver. Rules compile to ``CASE`` expressions in priority order, so every
finding gets its rule without a join, and overlaps are settled, findings numbered and texts rewritten inside a row, in time
in proportion to its findings but for sorting them: a scan never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from opswatch.functions.field_paths import pattern_regex
from opswatch.functions.masking import luhn_valid, mask
from opswatch.operators.detection import DETECTION, compiles, detector_udf, may_match

MAX_RULES = 2_000
CARD_TYPE = "CreditCard"
DEFAULT_RULE = "default"
REPLACED = ("REDACT", "BLOCK", "MASK")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    detectors: list[dict]
    rules: list[dict]
    default_action: str = "OBSERVE"
    checksum: str = ""
    labels: list[str] = field(default_factory=list)

    @property
    def ordered_rules(self) -> list[dict]:
        return sorted(self.rules, key=lambda r: -int(r.get("priority") or 0))

    @property
    def usable_detectors(self) -> list[tuple[int, dict]]:
        return [(i, d) for i, d in enumerate(self.detectors) if d.get("enabled", True) and compiles(d["pattern"])]

    @property
    def failed_detectors(self) -> list[str]:
        """Detectors whose pattern cannot run; a scan with such a detector is not trusted."""
        return sorted({d["id"] for d in self.detectors if d.get("enabled", True) and not compiles(d["pattern"])})


def policy_from_document(document: dict) -> Policy:
    """Policy from its JSON document."""
    spec, meta = document["spec"], document.get("metadata", {})
    rules = spec.get("rules") or []
    if len(rules) > MAX_RULES:
        raise ValueError(f"a policy holds at most {MAX_RULES} rules, got {len(rules)}")
    return Policy(
        name=meta.get("name", ""),
        version=int(meta.get("version") or 0),
        checksum=meta.get("checksum", ""),
        detectors=spec.get("detectors") or [],
        rules=rules,
        default_action=(spec.get("defaults") or {}).get("action", ""),
    )


def _detector(ident: str, kind: str, pattern: str) -> dict:
    return {"id": ident, "piiType": kind, "pattern": pattern, "enabled": True}


_CONTENT = ["JOB_PAYLOAD", "JOB_RESULT", "ERROR_MESSAGE", "STRUCTURED_LOG"]

# The default policy, version 1.
DEFAULT_DETECTORS = [
    _detector("builtin-phone", "Phone", r"\d{3}-\d{3}-\d{4}"),
    _detector("builtin-ssn", "SSN", r"\d{3}-\d{2}-\d{4}"),
    _detector("builtin-email", "Email", r"[^\s@]+@[^\s@]+\.[^\s@]+"),
    _detector("builtin-creditcard", CARD_TYPE, r"\d{4}-\d{4}-\d{4}-\d{4}"),
]
DEFAULT_RULES = [
    {"id": "redact-phone-ssn", "priority": 100, "match": {"sources": _CONTENT, "piiTypes": ["Phone", "SSN"]}, "action": {"type": "REDACT"}},
    {
        "id": "mask-creditcard", "priority": 200, "match": {"sources": _CONTENT, "piiTypes": [CARD_TYPE]},
        "action": {"type": "MASK", "mask": {"strategy": "FULL", "maskCharacter": "*"}},
    },
    {
        "id": "mask-email", "priority": 300, "match": {"sources": _CONTENT, "piiTypes": ["Email"]},
        "action": {"type": "MASK", "mask": {"strategy": "EMAIL", "visibleCharacters": 2, "maskCharacter": "*", "domainMode": "PRESERVE"}},
    },
    {"id": "redact-pii-in-metadata", "priority": 400, "match": {"sources": ["JOB_METADATA"]}, "action": {"type": "REDACT"}},
]
DEFAULT_POLICY = Policy("default", 1, DEFAULT_DETECTORS, DEFAULT_RULES)


# --- rules as columns ---


@dataclass(frozen=True)
class Context:
    """What is known about a scanned column besides the finding itself."""

    source: str
    job_type: Column
    queue: Column


def context(source: str, job_type: Column | None = None, queue: Column | None = None) -> Context:
    blank = F.lit("")
    return Context(source, blank if job_type is None else job_type, blank if queue is None else queue)


def rule_condition(rule: dict, finding: Column, where: Context, labels: list[str]) -> Column | None:
    """Condition under which a rule answers a finding; None when it never can in this context."""
    match = rule.get("match") or {}
    if match.get("sources") and where.source not in match["sources"]:
        return None
    if float(match.get("minimumConfidence") or 0) > 1.0:
        return None  # every match is certain: confidence is 1
    if any(label not in labels for label in match.get("labels") or []):
        return None
    parts: list[Column] = [F.lit(True)]
    for key, column in (
        ("jobTypes", where.job_type),
        ("queues", where.queue),
        ("piiTypes", finding["type"]),
        ("detectorIds", finding["detector_id"]),
    ):
        if match.get(key):
            parts.append(F.coalesce(column.isin(*match[key]), F.lit(False)))
    if match.get("fieldPaths"):
        parts.append(reduce(lambda a, b: a | b, [finding["path"].rlike(pattern_regex(p)) for p in match["fieldPaths"]]))
    return reduce(lambda a, b: a & b, parts)


def resolved_rule(finding: Column, policy: Policy, where: Context) -> Column:
    """Struct (rule_id, priority, action, mask_strategy) of the first matching rule in priority order."""

    def described(ident: str, priority: int, action: str, strategy: str | None) -> Column:
        return F.struct(
            F.lit(ident).alias("rule_id"),
            F.lit(priority).alias("priority"),
            F.lit(action).alias("action"),
            F.lit(strategy).cast("string").alias("mask_strategy"),
        )

    out = None
    for rule in policy.ordered_rules:
        condition = rule_condition(rule, finding, where, policy.labels)
        if condition is None:
            continue
        action = rule.get("action") or {}
        kind = action.get("type", "")
        strategy = (action.get("mask") or {}).get("strategy") if kind == "MASK" else None
        answer = described(rule["id"], int(rule.get("priority") or 0), kind, strategy)
        out = F.when(condition, answer) if out is None else out.when(condition, answer)
    default = described(DEFAULT_RULE, 0, policy.default_action, None)
    return default if out is None else out.otherwise(default)


def masked_value(match: Column, rule_id: Column, policy: Policy) -> Column:
    """Mask of a match under the rule that answered it."""
    out = None
    for rule in policy.rules:
        action = rule.get("action") or {}
        if action.get("type") != "MASK":
            continue
        value = mask(match, action.get("mask"))
        out = F.when(rule_id == rule["id"], value) if out is None else out.when(rule_id == rule["id"], value)
    return mask(match, None) if out is None else out.otherwise(mask(match, None))


# --- findings of a row ---


def detected(text: Column, policy: Policy, in_json: bool) -> Column:
    """Detection struct of a text column."""
    usable = [(i, d["pattern"]) for i, d in policy.usable_detectors]
    if not usable:
        return F.lit(None).cast(DETECTION)
    needed = may_match(text, [p for _, p in usable], in_json)
    return detector_udf(usable, in_json)(F.when(needed, text))


def evaluated(matches: Column, policy: Policy, where: Context, fixed_path: str | None = None) -> Column:
    """Matches as findings in detection order: cards checked, type, detector and rule attached."""
    kinds = F.array(*[F.lit(d["piiType"]) for d in policy.detectors])
    idents = F.array(*[F.lit(d["id"]) for d in policy.detectors])

    def finding(m: Column) -> Column:
        return F.struct(
            kinds[m["ordinal"]].alias("type"),
            idents[m["ordinal"]].alias("detector_id"),
            m["ordinal"].alias("ordinal"),
            (m["path"] if fixed_path is None else F.lit(fixed_path)).alias("path"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["match"].alias("match"),
        )

    found = F.transform(F.coalesce(matches, F.array().cast(EMPTY_MATCHES)), finding)
    checked = F.filter(found, lambda f: (f["type"] != CARD_TYPE) | luhn_valid(f["match"]))
    return F.transform(checked, lambda f: F.struct(*[f[c].alias(c) for c in FINDING], resolved_rule(f, policy, where).alias("rule")))


def kept_findings(findings: Column) -> Column:
    """Overlaps settled first, then IGNORE dropped: an ignored finding may still push out a weaker one."""
    return F.filter(settle_overlaps(findings), lambda f: f["rule"]["action"] != "IGNORE")


FINDING = ("type", "detector_id", "ordinal", "path", "start", "end", "match")
EMPTY_TYPES = "array<struct<type: string>>"
#: code points as four bytes each
WIDE = "UTF-32"
EMPTY_MATCHES = "array<struct<path: string, ordinal: int, start: int, end: int, match: string>>"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; an expression inside a lambda function is computed for every element."""
    return F.transform(F.array(value), use)[0]


def _behind(xs: Column) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))


def some_cross(ordered: Column) -> Column:
    """Whether any of these (path, start, end) overlap. They are in this order, so two neighbours do if any two do."""
    pairs = F.zip_with(_behind(ordered), ordered, lambda b, a: F.coalesce((a["path"] == b["path"]) & (b["start"] < a["end"]), F.lit(False)))
    return F.exists(pairs, lambda crosses: crosses)


def settled_positions(findings: list[dict]) -> list[int]:
    """Positions of the findings that stay, in the order of the places they hold.

    A finding that meets a held place takes it if it ranks higher (priority, then length, then smaller detector id) and goes otherwise;
    one that meets none holds a place of its own. Only findings of one stretch can meet, a stretch being findings of one path
    that cover a span without a gap, so each stretch is settled by itself.
    """
    paths = {f["path"] for f in findings}
    anywhere = "" in paths and len(paths) > 1  # a finding without path may meet those of any path

    def line(i: int) -> str:
        return "" if anywhere else findings[i]["path"]

    stretches: list[list[int]] = []
    at, reach = None, 0
    for i in sorted(range(len(findings)), key=lambda i: (line(i), findings[i]["start"])):
        f = findings[i]
        if line(i) != at or f["start"] >= reach:
            stretches.append([])
            at, reach = line(i), f["end"]
        stretches[-1].append(i)
        reach = max(reach, f["end"])

    def rank(i: int) -> tuple:
        return -findings[i]["priority"], -findings[i]["size"], findings[i]["detector_id"]

    def meet(a: dict, b: dict) -> bool:
        return a["start"] < b["end"] and b["start"] < a["end"] and (a["path"] == b["path"] or "" in (a["path"], b["path"]))

    places: dict[int, int] = {}
    for members in stretches:
        held: dict[int, int] = {}
        for i in sorted(members):
            place = next((p for p, j in held.items() if meet(findings[i], findings[j])), i)
            held[place] = min(held.get(place, i), i, key=rank)
        places.update(held)
    return [places[p] for p in sorted(places)]


def settle_overlaps(findings: Column) -> Column:
    """Of overlapping findings the better ones (``settled_positions``). Only rows that hold an overlap reach Python."""

    @F.pandas_udf("array<int>")
    def positions(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else settled_positions(list(r)) for r in rows], dtype=object)

    def facts(f: Column) -> Column:
        size = F.octet_length(f["match"]).alias("size")
        return F.struct(f["path"].alias("path"), f["start"].alias("start"), f["end"].alias("end"), f["rule"]["priority"].alias("priority"), size, f["detector_id"].alias("detector_id"))

    places = F.array_sort(F.transform(findings, lambda f: F.struct(f["path"].alias("path"), f["start"].alias("start"), f["end"].alias("end"))))
    mixed = F.exists(findings, lambda f: f["path"] == "") & F.exists(findings, lambda f: f["path"] != "")
    asked = F.when((F.size(findings) > 1) & (mixed | once(places, some_cross)), F.transform(findings, facts))
    kept = positions.asNondeterministic()(asked)
    return once(F.struct(findings.alias("all"), kept.alias("kept")), lambda x: F.when(x["kept"].isNull(), x["all"]).otherwise(F.transform(x["kept"], lambda i: x["all"][i])))


def numbered(findings: Column, already: Column | None = None) -> Column:
    """Findings with ``index``: their 1-based position among findings of the same type in the document."""
    placed = F.transform(findings, lambda f, i: F.struct(f["type"].alias("type"), i.alias("at"), f.alias("f")))
    earlier = F.array().cast(EMPTY_TYPES) if already is None else F.transform(already, lambda a: F.struct(a["type"].alias("type")))

    def ranked(x: Column) -> Column:
        # in order of type and place an index is the rank less the number of findings of smaller types
        kinds = F.array_distinct(F.transform(x["by_type"], lambda p: p["type"]))
        less = F.transform(kinds, lambda k: F.size(F.filter(x["by_type"], lambda p: p["type"] < k)) - F.size(F.filter(x["earlier"], lambda e: e["type"] == k)))

        def with_index(before: Column) -> Column:
            def one(p: Column, rank: Column) -> Column:
                index = (rank + 1 - before[p["type"]]).alias("index")
                return F.struct(p["at"].alias("at"), F.struct(*[p["f"][c].alias(c) for c in (*FINDING, "rule")], index).alias("f"))

            return F.array_sort(F.transform(x["by_type"], one), lambda a, b: a["at"] - b["at"])

        return F.transform(once(F.map_from_arrays(kinds, less), with_index), lambda p: p["f"])

    by_type = F.array_sort(placed, lambda a, b: F.when(a["type"] < b["type"], -1).when(a["type"] > b["type"], 1).otherwise(a["at"] - b["at"]))
    return once(F.struct(by_type.alias("by_type"), earlier.alias("earlier")), ranked)


def replacement(finding: Column, policy: Policy, marker: Column) -> Column:
    """What stands in for a match; NULL when the text stays."""
    action = finding["rule"]["action"]
    return F.when(action.isin("REDACT", "BLOCK"), marker).when(
        action == "MASK", masked_value(finding["match"], finding["rule"]["rule_id"], policy)
    )


def numbered_marker(f: Column) -> Column:
    return F.concat(F.lit("["), f["type"], F.lit("-"), f["index"].cast("string"), F.lit("]"))


def plain_marker(f: Column) -> Column:
    return F.concat(F.lit("["), f["type"], F.lit("-REDACTED]"))


def spans(findings: Column, policy: Policy, marker) -> Column:
    """Findings as spans (path, start, end, match, replacement)."""
    return F.transform(
        findings,
        lambda f: F.struct(
            *[f[c].alias(c) for c in ("path", "start", "end", "match")], replacement(f, policy, marker(f)).alias("replacement")
        ),
    )


def rewritten_text(text: Column, text_spans: Column) -> Column:
    """Text with its spans replaced.

    The text is put together from the pieces between spans, each cut out of its four-byte form, where a place is found
    without counting characters. Spans that still overlap are replaced one after the other, last first, so that earlier positions stay true.
    """
    todo = F.filter(text_spans, lambda s: s["replacement"].isNotNull())

    def apply(out: Column, s: Column) -> Column:
        tail = out.substr(s["end"] + 1, F.char_length(out))
        return F.concat(out.substr(F.lit(1), s["start"]), s["replacement"], tail)

    def pieces(x: Column) -> Column:
        def between(start: Column, size: Column) -> Column:
            return F.decode(F.substr(x["wide"], 4 * start + 1, 4 * size), WIDE)

        stops = F.concat(F.array(F.lit(0)), F.transform(x["todo"], lambda s: s["end"]))
        heads = F.zip_with(x["todo"], F.slice(stops, F.lit(1), F.size(x["todo"])), lambda s, stop: F.concat(between(stop, s["start"] - stop), s["replacement"]))
        last = F.element_at(x["todo"], -1)["end"]
        return F.concat(F.array_join(heads, ""), between(last, F.octet_length(x["wide"])))

    forwards = F.array_sort(todo, lambda a, b: (a["start"] - b["start"]).cast("int"))
    whole = once(F.struct(F.encode(text, WIDE).alias("wide"), forwards.alias("todo")), pieces)
    line = F.transform(forwards, lambda s: F.struct(F.lit("").alias("path"), s["start"].alias("start"), s["end"].alias("end")))
    one_by_one = F.aggregate(F.reverse(forwards), text, apply)
    return F.when(F.size(todo) == 0, text).when(once(line, some_cross), one_by_one).otherwise(whole)
