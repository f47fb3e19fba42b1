"""Scan jobs: findings, artifacts, submitted payloads, dry runs, vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions.crypto import decrypt, encrypt, fingerprint
from opswatch.functions.masking import mask
from opswatch.functions.status import lookup
from opswatch.operators.detection import rewrite_json
from opswatch.operators.policy import (
    REPLACED,
    Context,
    Policy,
    context,
    detected,
    evaluated,
    kept_findings,
    masked_value,
    numbered,
    numbered_marker,
    plain_marker,
    rewritten_text,
    settle_overlaps,
    spans,
)

MAX_BODY_BYTES = 8 * 1024
METADATA_SOURCE = "JOB_METADATA"
METADATA_PATH = "task_name"
PAYLOAD_WITHHELD = '"[payload withheld]"'

# Which scan status is worse.
STATUS_RANK = {"": 0, "CLEAN": 1, "DETECTED": 2, "SCAN_ERROR": 3}


def scan_status(findings: Column, policy: Policy) -> Column:
    if policy.failed_detectors:
        return F.lit("SCAN_ERROR")
    return F.when(F.size(findings) > 0, F.lit("DETECTED")).otherwise(F.lit("CLEAN"))


def worse_status(a: Column, b: Column) -> Column:
    def rank(s: Column) -> Column:
        return lookup(s, STATUS_RANK, 0)

    return F.when(rank(b) > rank(a), b).otherwise(a)


def with_findings(df: DataFrame, text: str, policy: Policy, where: Context, in_json: bool = True, prefix: str = "") -> DataFrame:
    """Add ``findings`` (array) and ``structured`` for a text column. Row-local: no shuffle.

    The detection sits alone in its projection so that it is evaluated once.
    """
    d = f"{prefix}detection"
    scanned = df.withColumn(d, detected(F.col(text), policy, in_json))
    found = scanned.withColumn("_found", evaluated(F.col(d)["matches"], policy, where))
    kept = found.withColumn("_found", kept_findings(F.col("_found")))
    return kept.withColumn(f"{prefix}findings", numbered(F.col("_found"))).withColumn(
        f"{prefix}structured", F.coalesce(F.col(d)["structured"], F.lit(False))
    ).drop("_found")


def with_sanitized(df: DataFrame, text: str, policy: Policy, out: str, prefix: str = "") -> DataFrame:
    """Add the rewritten text: JSON leaves with plain markers, other text with numbered ones.

    NULL means that a rewrite failed. The spans have a column of their own, so the UDF sees plain columns only.
    """
    findings, structured = F.col(f"{prefix}findings"), F.col(f"{prefix}structured")
    normalized = F.col(f"{prefix}detection")["normalized"]
    # overlapping findings of one leaf are settled once more before they are replaced
    staged = df.withColumn(
        "_spans", F.when(structured, spans(settle_overlaps(findings), policy, plain_marker)).otherwise(spans(findings, policy, numbered_marker))
    )
    found = F.size("_spans") > 0
    rewritten = staged.withColumn("_json", rewrite_json(F.when(structured & found, F.col(text)), F.col("_spans")))
    replaces = F.exists("_spans", lambda s: s["replacement"].isNotNull())
    as_text = rewritten_text(F.coalesce(normalized, F.col(text)), F.col("_spans"))
    value = (
        F.when(~found, F.col(text)).when(structured, F.col("_json")).when(replaces, as_text).otherwise(F.col(text))
    )
    return rewritten.withColumn(out, value).drop("_spans", "_json")


# --- finding rows ---


def finding_rows(scanned: DataFrame, keys: list[str], policy: Policy, source: str, key: bytes = b"", findings: str = "findings") -> DataFrame:
    """One row per finding: never the value, only its keyed fingerprint."""
    exploded = scanned.select(*keys, F.explode(findings).alias("f"))
    f = F.col("f")
    return exploded.select(
        *keys,
        f["type"].alias("type"),
        f["detector_id"].alias("detector_id"),
        F.lit(1.0).alias("confidence"),
        F.lit(source).alias("source"),
        f["index"].alias("index"),
        fingerprint(f["match"], key).alias("fingerprint_value"),
        f["rule"]["action"].alias("policy_action"),
        f["path"].alias("field_path"),
        f["rule"]["rule_id"].alias("rule_id"),
        F.coalesce(f["rule"]["mask_strategy"], F.lit("")).alias("mask_strategy"),
        F.lit(policy.name).alias("policy_name"),
        F.lit(policy.version).alias("policy_version"),
        F.lit(policy.checksum).alias("policy_checksum"),
    )


def vault_rows(scanned: DataFrame, keys: list[str], secret: bytes, findings: str = "findings") -> DataFrame:
    """Encrypted values of the findings that may be restored; blocked values are never stored."""
    exploded = scanned.select(*keys, F.explode(findings).alias("f")).filter(F.col("f")["rule"]["action"] != "BLOCK")
    f = F.col("f")
    return exploded.select(
        *keys, f["type"].alias("type"), f["index"].alias("index"), encrypt(f["match"], secret).alias("encrypted_value")
    )


def open_vault(vault: DataFrame, secret: bytes) -> DataFrame:
    """Vault rows with their clear value; rows that cannot be decrypted carry NULL and ``readable`` false."""
    value = decrypt(F.col("encrypted_value"), secret)
    return vault.withColumn("value", value).withColumn("readable", F.col("value").isNotNull())


def unreadable_count(opened: DataFrame) -> DataFrame:
    return opened.agg(F.count_if(F.col("readable")).alias("readable"), F.count_if(~F.col("readable")).alias("unreadable"))


def dry_run(df: DataFrame, keys: list[str], text: str, policy: Policy, source: str = "JOB_PAYLOAD") -> DataFrame:
    """What a candidate policy would find: matched text, action and masked preview, before overlaps are settled."""
    scanned = df.withColumn("detection", detected(F.col(text), policy, in_json=False))
    found = evaluated(F.col("detection")["matches"], policy, context(source))
    exploded = scanned.select(*keys, F.explode(found).alias("f"))
    f = F.col("f")
    preview = F.when(f["rule"]["action"] == "MASK", masked_value(f["match"], f["rule"]["rule_id"], policy))
    return exploded.select(
        *keys,
        f["type"].alias("type"),
        f["detector_id"].alias("detector_id"),
        f["match"].alias("match"),
        f["rule"]["rule_id"].alias("rule_id"),
        f["rule"]["action"].alias("action"),
        preview.alias("masked_preview"),
    )


# --- artifacts ---


def clean_body(body: Column) -> Column:
    """Valid UTF-8 without NUL characters."""
    return F.replace(F.make_valid_utf8(body), F.lit("\0"), F.lit(""))


def truncated_body(body: Column, limit: int = MAX_BODY_BYTES) -> Column:
    """At most ``limit`` bytes, cut where a character starts."""
    data = F.encode(body, "UTF-8")

    def starts_character(at: int) -> Column:
        first = F.hex(F.substring(data, at + 1, 1))
        return ~((first >= "80") & (first < "C0"))

    def cut(at: int) -> Column:
        return F.decode(F.substring(data, 1, at), "UTF-8")

    out = F.when(F.octet_length(body) <= limit, body)
    for back in range(3):
        out = out.when(starts_character(limit - back), cut(limit - back))
    return out.otherwise(cut(limit - 3))


def joined_log(lines: Column, shown: int | None = None) -> Column:
    """Lines of a log; where only the first ``shown`` are asked for, with a note on how many were left out."""
    if shown is None:
        return F.array_join(lines, "\n")
    text = F.array_join(F.slice(lines, 1, shown), "\n")
    note = F.format_string("\n[%d more log lines omitted]", F.size(lines) - shown)
    return F.when(F.size(lines) > shown, F.concat(text, note)).otherwise(text)


def scan_artifacts(
    artifacts: DataFrame, policy: Policy, source: str, body: str = "body", job_type: Column | None = None, queue: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Artifacts with scan status, findings and the sanitized body, whole; where a limit is given, of at most ``limit`` bytes and flagged.

    A scan that cannot be trusted withholds the body.
    """
    where = context(source, job_type, queue)
    cleaned = artifacts.withColumn("original_bytes", F.octet_length(body)).withColumn("_body", clean_body(F.col(body)))
    scanned = with_findings(cleaned, "_body", policy, where)
    rewritten = with_sanitized(scanned, "_body", policy, "_sanitized")
    failed = F.col("_sanitized").isNull() & F.col("_body").isNotNull()
    empty = F.col("_body") == ""
    status = (
        F.when(empty, F.lit("CLEAN")).when(failed, F.lit("SCAN_ERROR")).otherwise(scan_status(F.col("findings"), policy))
    )
    judged = rewritten.withColumn("scan_status", status)
    withheld = F.col("scan_status") == "SCAN_ERROR"
    shown = F.col("_sanitized") if limit is None else truncated_body(F.col("_sanitized"), limit)
    truncated = F.lit(False) if limit is None else ~withheld & (F.octet_length("_sanitized") > limit)
    return judged.select(
        *artifacts.columns,
        "original_bytes",
        "scan_status",
        F.size("findings").alias("finding_count"),
        "findings",
        withheld.alias("withheld"),
        F.when(~withheld, shown).otherwise(F.lit("")).alias("sanitized_body"),
        truncated.alias("truncated"),
    )


# --- submitted runs ---


def scan_submissions(tasks: DataFrame, policy: Policy) -> DataFrame:
    """Submitted runs with payload and name sanitized, their findings, scan status and whether they are blocked.

    Adds ``payload_findings``, ``name_findings`` (numbered on from the payload's), ``scan_status``, ``blocked`` and
    ``applied``; a payload that cannot be rewritten safely is withheld and blocks the run.
    """
    job_type, queue = F.col("task_type"), F.col("queue")
    payload = with_findings(tasks, "payload", policy, context("JOB_PAYLOAD", job_type, queue), prefix="payload_")
    named = payload.withColumn("name_detection", detected(F.col("task_name"), policy, in_json=False))
    name_found = evaluated(
        F.col("name_detection")["matches"], policy, context(METADATA_SOURCE, job_type, queue), METADATA_PATH
    )
    settled = named.withColumn("_found", name_found).withColumn("_found", kept_findings(F.col("_found")))
    numbered_on = settled.withColumn("name_findings", numbered(F.col("_found"), F.col("payload_findings")))
    scanned = with_sanitized(numbered_on, "payload", policy, "_payload", prefix="payload_")
    withheld = F.col("_payload").isNull() & F.col("payload").isNotNull()
    name = rewritten_text(
        F.coalesce(F.col("name_detection")["normalized"], F.col("task_name")), spans(F.col("name_findings"), policy, plain_marker)
    )
    payload_status = F.when(withheld, F.lit("SCAN_ERROR")).otherwise(scan_status(F.col("payload_findings"), policy))
    name_status = F.when(F.coalesce("task_name", F.lit("")) == "", F.lit("")).otherwise(scan_status(F.col("name_findings"), policy))
    every = F.concat(F.col("payload_findings"), F.col("name_findings"))
    blocked = withheld | F.exists(every, lambda f: f["rule"]["action"] == "BLOCK")
    kept = [c for c in tasks.columns if c not in ("payload", "task_name", "scan_status", "status")]
    return scanned.select(
        *kept,
        F.when(withheld, F.lit(PAYLOAD_WITHHELD)).otherwise(F.col("_payload")).alias("payload"),
        F.when(F.size("name_findings") > 0, name).otherwise(F.col("task_name")).alias("task_name"),
        worse_status(payload_status, name_status).alias("scan_status"),
        F.when(blocked, F.lit("Blocked")).otherwise(F.col("status") if "status" in tasks.columns else F.lit("Pending")).alias("status"),
        blocked.alias("blocked"),
        F.exists(every, lambda f: f["rule"]["action"].isin(*REPLACED)).alias("applied"),
        "payload_findings",
        "name_findings",
    )


def submission_findings(scanned: DataFrame, policy: Policy, key: bytes = b"") -> DataFrame:
    """Finding rows of submitted runs, payload and name together."""
    return finding_rows(scanned, ["job_id"], policy, "JOB_PAYLOAD", key, "payload_findings").unionByName(
        finding_rows(scanned, ["job_id"], policy, METADATA_SOURCE, key, "name_findings")
    )


def masked_column(df: DataFrame, column: str, config: dict, out: str) -> DataFrame:
    """Mask a whole column of known values."""
    return df.withColumn(out, mask(F.col(column), config))
