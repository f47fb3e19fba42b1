"""PII detection, policy, masking, rewriting and scan jobs over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.catalog.registry import query
from opswatch.functions.crypto import fingerprint
from opswatch.functions.masking import luhn_valid, mask, place_marker
from opswatch.operators.detection import json_leaves
from opswatch.operators.policy import DEFAULT_DETECTORS, DEFAULT_RULES, Policy, context
from opswatch.plans import pii_scan
from opswatch.sources.tables import Tables

ALL_CONTENT = ["JOB_PAYLOAD", "JOB_RESULT", "ERROR_MESSAGE", "STRUCTURED_LOG"]
KEY = b"sample-fingerprint-key"
SECRET = b"sample-vault-secret"

# The default policy plus detectors that the sample texts hold, one of which lies inside e-mail addresses.
EXTRA_DETECTORS = [
    {"id": "card16", "piiType": "CreditCard", "pattern": r"\b\d{16}\b", "enabled": True},
    {"id": "ipv4", "piiType": "IP", "pattern": r"\d+\.\d+\.\d+\.\d+", "enabled": True},
    {"id": "host", "piiType": "Host", "pattern": r"[a-z0-9]+\.example\.com", "enabled": True},
    {"id": "off", "piiType": "Word", "pattern": r"\w+", "enabled": False},
]
EXTRA_RULES = [
    {"id": "redact-ip", "priority": 150, "match": {"sources": ALL_CONTENT, "piiTypes": ["IP"]}, "action": {"type": "REDACT"}},
    {"id": "ignore-host", "priority": 10, "match": {"detectorIds": ["host"]}, "action": {"type": "IGNORE"}},
]
POLICY = Policy("sample", 3, DEFAULT_DETECTORS + EXTRA_DETECTORS, DEFAULT_RULES + EXTRA_RULES, checksum="c0ffee")

# --- expected results ---

PATTERNS = [(i, d["id"], d["piiType"], d["pattern"]) for i, d in enumerate(POLICY.detectors) if d["enabled"]]
LUHN = (
    "(kind <> 'CreditCard' OR list_sum(list_transform(range(1, length(regexp_replace(match, '[^0-9]', '', 'g')) + 1), lambda k:"
    " CASE WHEN k % 2 = 1 THEN CAST(regexp_replace(match, '[^0-9]', '', 'g')[-k] AS INT)"
    " ELSE CAST(regexp_replace(match, '[^0-9]', '', 'g')[-k] AS INT) * 2 - CASE WHEN CAST(regexp_replace(match, '[^0-9]', '', 'g')[-k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"
)


def matches_sql(source: str, key: str, text: str) -> str:
    """Every match with its character positions, from the pieces between matches."""
    parts = [
        f"SELECT {key} AS key, {i} AS ordinal, '{ident}' AS detector_id, '{kind}' AS kind, {text} AS text,"
        f" regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS p FROM {source}"
        for i, ident, kind, pattern in PATTERNS
    ]
    return f"""
SELECT *, start + length(match) AS stop FROM (
 SELECT key, ordinal, detector_id, kind, text, m[i] AS match,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({' UNION ALL '.join(parts)}) AS a WHERE len(m) > 0) AS b) AS c WHERE {LUHN}"""


RULE_CASE = (
    "CASE kind WHEN 'Email' THEN 'mask-email' WHEN 'CreditCard' THEN 'mask-creditcard' WHEN 'Phone' THEN 'redact-phone-ssn'"
    " WHEN 'SSN' THEN 'redact-phone-ssn' WHEN 'IP' THEN 'redact-ip' ELSE 'ignore-host' END"
)
ACTION_CASE = "CASE kind WHEN 'Email' THEN 'MASK' WHEN 'CreditCard' THEN 'MASK' WHEN 'Host' THEN 'IGNORE' ELSE 'REDACT' END"
# in the sample texts only hosts overlap anything (the e-mail around them), and hosts are ignored in any case
FOUND = f"SELECT *, {RULE_CASE} AS rule_id, {ACTION_CASE} AS action, row_number() OVER (PARTITION BY key, kind ORDER BY ordinal, start) AS idx FROM (@MATCHES) AS x WHERE kind <> 'Host'"
MASKED = (
    "CASE kind WHEN 'Email' THEN CASE WHEN concat(left(match, 2), '@') = left(match, 3) OR strpos(match, '@') <= 3 THEN repeat('*', length(match))"
    " ELSE concat(left(match, 2), repeat('*', strpos(match, '@') - 3), substr(match, strpos(match, '@'))) END ELSE repeat('*', length(match)) END"
)


def found_sql(source: str, key: str, text: str) -> str:
    return FOUND.replace("@MATCHES", matches_sql(source, key, text))


def sanitized_sql(source: str, key: str, text: str, marker: str) -> str:
    """Texts put together again from the parts between findings and their replacements."""
    replaced = f"CASE action WHEN 'MASK' THEN {MASKED} ELSE {marker} END"
    return f"""
SELECT s.{key} AS key, CASE WHEN r.key IS NULL THEN s.{text} ELSE concat(r.head, substr(s.{text}, r.last + 1)) END AS sanitized, coalesce(r.n, 0) AS n
FROM {source} AS s LEFT JOIN (
 SELECT key, string_agg(concat(substr(text, before + 1, start - before), repl), '' ORDER BY start) AS head, max(stop) AS last, count(*) AS n
 FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY key ORDER BY start), 0) AS before, {replaced} AS repl FROM ({found_sql(source, key, text)}) AS f) AS g GROUP BY key) AS r ON r.key = s.{key}"""


NUMBERED = "concat('[', kind, '-', idx, ']')"
PLAIN = "concat('[', kind, '-REDACTED]')"


# --- findings ---


def documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").alias("body"))


def scanned_documents(t: Tables) -> DataFrame:
    return pii_scan.with_findings(documents(t), "body", POLICY, context("JOB_RESULT"))


@query(
    "pii_findings",
    f"SELECT key AS doc_id, kind AS type, detector_id, match, start, stop AS finish, rule_id, action, idx AS number FROM ({found_sql('documents', 'doc_id', 'text')}) AS f",
)
def _(t: Tables) -> DataFrame:
    f = F.col("f")
    return scanned_documents(t).select("doc_id", F.explode("findings").alias("f")).select(
        "doc_id", f["type"].alias("type"), f["detector_id"].alias("detector_id"), f["match"].alias("match"), f["start"].alias("start"),
        f["end"].alias("finish"), f["rule"]["rule_id"].alias("rule_id"), f["rule"]["action"].alias("action"), f["index"].alias("number"),
    )


# hosts outrank the e-mail addresses around them: an address whose host is found goes, and its first host takes its place
HOST_FIRST = Policy(
    "host-first", 1, DEFAULT_DETECTORS + EXTRA_DETECTORS, [*DEFAULT_RULES, EXTRA_RULES[0], {"id": "redact-host", "priority": 900, "match": {"detectorIds": ["host"]}, "action": {"type": "REDACT"}}]
)


@query(
    "pii_overlaps",
    f"""WITH met AS ({matches_sql('documents', 'doc_id', 'text')}),
crossed AS (SELECT e.key, e.ordinal, e.start, h.start AS host_start, row_number() OVER (PARTITION BY e.key, e.ordinal, e.start ORDER BY h.start) AS nth
 FROM met AS e JOIN met AS h ON h.key = e.key AND h.kind = 'Host' AND e.kind <> 'Host' AND h.start < e.stop AND e.start < h.stop),
placed AS (SELECT m.*, coalesce(c.ordinal, m.ordinal) AS place, coalesce(c.start, m.start) AS place_start FROM met AS m
 LEFT JOIN crossed AS c ON m.kind = 'Host' AND c.key = m.key AND c.host_start = m.start AND c.nth = 1
 WHERE (m.key, m.ordinal, m.start) NOT IN (SELECT (key, ordinal, start) FROM crossed))
SELECT key AS doc_id, kind AS type, match, start, stop AS finish, {RULE_CASE.replace('ignore-host', 'redact-host')} AS rule_id, {ACTION_CASE.replace('IGNORE', 'REDACT')} AS action,
 row_number() OVER (PARTITION BY key, kind ORDER BY place, place_start) AS number FROM placed""",
)
def _(t: Tables) -> DataFrame:
    """Findings where each of two overlapping ones would be reported without the other."""
    found = pii_scan.with_findings(documents(t), "body", HOST_FIRST, context("JOB_RESULT"))
    f = F.col("f")
    return found.select("doc_id", F.explode("findings").alias("f")).select(
        "doc_id", f["type"].alias("type"), f["match"].alias("match"), f["start"].alias("start"), f["end"].alias("finish"),
        f["rule"]["rule_id"].alias("rule_id"), f["rule"]["action"].alias("action"), f["index"].alias("number"),
    )


IPAD, OPAD = ("".join(f"\\x{b ^ pad:02X}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
HMAC = f"sha256('{OPAD}'::BLOB || unhex(sha256('{IPAD}'::BLOB || encode(match))))"


# named classes, general categories, quoted text and repeats that are short by default
WRITTEN_OUT = {
    "digits": r"[[:digit:]]{3}-[[:digit:]]{4}",
    "names": r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+",
    "marks": r"[^\pL\pN\pZ\pC\x00-\x7f]+",
    "hosts": r"(?U)@.+\Q.\E[[:alpha:]]{2,3}",
    "codes": r"[\p{Lu}\p{Nd}]{6,}",
}
CLASS_POLICY = Policy(
    "classes", 1, [{"id": ident, "piiType": "Text", "pattern": p, "enabled": True} for ident, p in WRITTEN_OUT.items()], [], checksum="c1a55e5"
)


@query(
    "pii_classes",
    " UNION ALL ".join(
        f"SELECT doc_id, '{ident}' AS detector_id, unnest(regexp_extract_all(nfc_normalize(text), '{p}')) AS match FROM documents" for ident, p in WRITTEN_OUT.items()
    ),
)
def _(t: Tables) -> DataFrame:
    """Detectors written with classes and flags that the engines below spell differently."""
    found = pii_scan.with_findings(documents(t), "body", CLASS_POLICY, context("JOB_RESULT"))
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.detector_id", "f.match")


@query(
    "finding_records",
    f"""SELECT key AS page_id, kind AS type, detector_id, 1.0::DOUBLE AS confidence, 'ERROR_MESSAGE' AS source, idx AS index, {HMAC} AS fingerprint_value, action AS policy_action, '' AS field_path, rule_id,
 CASE kind WHEN 'Email' THEN 'EMAIL' WHEN 'CreditCard' THEN 'FULL' ELSE '' END AS mask_strategy, 'sample' AS policy_name, 3 AS policy_version, 'c0ffee' AS policy_checksum
FROM ({found_sql('pages', 'page_id', 'html')}) AS f""",
)
def _(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.col("html").alias("body"))
    scanned = pii_scan.with_findings(pages, "body", POLICY, context("ERROR_MESSAGE"))
    return pii_scan.finding_rows(scanned, ["page_id"], POLICY, "ERROR_MESSAGE", KEY)


@query("pii_sanitized_text", f"SELECT key AS doc_id, sanitized FROM ({sanitized_sql('documents', 'doc_id', 'text', NUMBERED)}) AS s")
def _(t: Tables) -> DataFrame:
    return pii_scan.with_sanitized(scanned_documents(t), "body", POLICY, "sanitized").select("doc_id", "sanitized")


SCANNED = f"""SELECT key AS doc_id, CASE WHEN n > 0 THEN 'DETECTED' ELSE 'CLEAN' END AS scan_status, n AS finding_count, false AS withheld, strlen(text) AS original_bytes, sanitized AS sanitized_body, false AS truncated
FROM ({sanitized_sql('documents', 'doc_id', 'text', NUMBERED)}) AS s JOIN documents AS d ON d.doc_id = s.key"""


@query("artifact_scan", SCANNED)
@query("artifact_scan_whole", SCANNED)
def _(t: Tables) -> DataFrame:
    return pii_scan.scan_artifacts(documents(t), POLICY, "JOB_RESULT").select(
        "doc_id", "scan_status", "finding_count", "withheld", "original_bytes", "sanitized_body", "truncated"
    )


SCANNED_PAGES = f"""SELECT key AS page_id, CASE WHEN n > 0 THEN 'DETECTED' ELSE 'CLEAN' END AS scan_status, n AS finding_count, sanitized AS sanitized_body
FROM ({sanitized_sql('pages', 'page_id', 'html', NUMBERED)}) AS s"""


@query("artifact_scan_pages", SCANNED_PAGES)
@query("artifact_scan_pages_whole", SCANNED_PAGES)
def _(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.col("html").alias("body"))
    return pii_scan.scan_artifacts(pages, POLICY, "ERROR_MESSAGE").select("page_id", "scan_status", "finding_count", "sanitized_body")


@query("artifact_scan_failed", "SELECT conv_id, turn, 'SCAN_ERROR' AS scan_status, true AS withheld, '' AS sanitized_body FROM conversations")
def _(t: Tables) -> DataFrame:
    """A detector that cannot run makes every scan untrusted, so the bodies are withheld."""
    broken = Policy("broken", 1, [*DEFAULT_DETECTORS, {"id": "bad", "piiType": "X", "pattern": "(?=a)b", "enabled": True}], DEFAULT_RULES)
    talks = t.conversations.select("conv_id", "turn", F.col("text").alias("body"))
    return pii_scan.scan_artifacts(talks, broken, "STRUCTURED_LOG").select("conv_id", "turn", "scan_status", "withheld", "sanitized_body")


# --- JSON ---


def json_documents(t: Tables) -> DataFrame:
    """Documents as JSON objects with the text in a nested leaf."""
    body = F.to_json(F.struct(F.col("doc_id"), F.struct(F.array(F.struct("text")).alias("parts")).alias("body.v1")))
    return t.documents.select("doc_id", body.alias("body"))


@query("json_leaves", "SELECT doc_id, 'body\\.v1.parts[0].text' AS path, text AS value FROM documents")
def _(t: Tables) -> DataFrame:
    leaves = json_documents(t).select("doc_id", F.explode(json_leaves(F.col("body"))).alias("leaf"))
    return leaves.select("doc_id", "leaf.path", "leaf.value")


@query(
    "json_scan",
    f"""SELECT key AS doc_id, CASE WHEN n > 0 THEN 'DETECTED' ELSE 'CLEAN' END AS scan_status, n AS finding_count, sanitized AS text
FROM ({sanitized_sql('documents', 'doc_id', 'text', PLAIN)}) AS s""",
)
def _(t: Tables) -> DataFrame:
    scanned = pii_scan.with_findings(json_documents(t), "body", POLICY, context("JOB_PAYLOAD"))
    rewritten = pii_scan.with_sanitized(scanned, "body", POLICY, "sanitized")
    text = F.from_json("sanitized", "doc_id BIGINT, `body.v1` STRUCT<parts: ARRAY<STRUCT<text: STRING>>>")["body.v1"]["parts"][0]["text"]
    return rewritten.select(
        "doc_id", pii_scan.scan_status(F.col("findings"), POLICY).alias("scan_status"), F.size("findings").alias("finding_count"), text.alias("text")
    )


@query("json_numbers_clean", "SELECT event_id, props AS sanitized_body, 'CLEAN' AS scan_status FROM events")
def _(t: Tables) -> DataFrame:
    """JSON without string leaves holds nothing to find and stays byte for byte."""
    props = t.events.select("event_id", F.col("props").alias("body"))
    return pii_scan.scan_artifacts(props, POLICY, "JOB_RESULT").select("event_id", "sanitized_body", "scan_status")


# --- submissions ---


def submissions(t: Tables) -> DataFrame:
    """Documents submitted as run payloads, the language as queue, a name that holds an address for some."""
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("mail owner"), F.col("doc_id"), F.lit("@corp.example.org"))).otherwise(F.lit("nightly"))
    return t.documents.select(
        F.concat(F.lit("d"), "doc_id").alias("job_id"), name.alias("task_name"), F.col("text").alias("payload"), F.col("source").alias("task_type"),
        F.col("lang").alias("queue"), F.lit("Pending").alias("status"),
    )


BLOCKING = Policy(
    "blocking", 1, POLICY.detectors,
    [*POLICY.rules, {"id": "block-ip-fr", "priority": 500, "match": {"queues": ["fr", "de"], "piiTypes": ["IP"]}, "action": {"type": "BLOCK"}}],
)


@query(
    "submission_scan",
    f"""SELECT concat('d', key) AS job_id, sanitized AS payload, CASE WHEN key % 5 = 0 THEN 'mail [Email-REDACTED]' ELSE 'nightly' END AS task_name,
 CASE WHEN n > 0 OR key % 5 = 0 THEN 'DETECTED' ELSE 'CLEAN' END AS scan_status, coalesce(b.blocked, false) AS blocked, CASE WHEN b.blocked THEN 'Blocked' ELSE 'Pending' END AS status,
 n > 0 OR key % 5 = 0 AS applied
FROM ({sanitized_sql('documents', 'doc_id', 'text', NUMBERED)}) AS s
LEFT JOIN (SELECT doc_id, lang IN ('fr', 'de') AND regexp_matches(text, '\\d+\\.\\d+\\.\\d+\\.\\d+') AS blocked FROM documents) AS b ON b.doc_id = s.key""",
)
def _(t: Tables) -> DataFrame:
    return pii_scan.scan_submissions(submissions(t), BLOCKING).select("job_id", "payload", "task_name", "scan_status", "blocked", "status", "applied")


@query(
    "submission_findings",
    f"""SELECT concat('d', key) AS job_id, 'JOB_PAYLOAD' AS source, kind AS type, idx AS index, {HMAC} AS fingerprint_value FROM ({found_sql('documents', 'doc_id', 'text')}) AS f
UNION ALL SELECT concat('d', doc_id), 'JOB_METADATA', 'Email', 1 + len(regexp_extract_all(text, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+')), {HMAC}
FROM (SELECT *, concat('owner', doc_id, '@corp.example.org') AS match FROM documents WHERE doc_id % 5 = 0) AS n""",
)
def _(t: Tables) -> DataFrame:
    """Findings of payload and name; the index of a name finding counts on from the payload's."""
    rows = pii_scan.submission_findings(pii_scan.scan_submissions(submissions(t), POLICY), POLICY, KEY)
    return rows.select("job_id", "source", "type", "index", "fingerprint_value")


@query("vault_round_trip", f"SELECT key AS doc_id, kind AS type, idx AS index, match AS value, true AS readable FROM ({found_sql('documents', 'doc_id', 'text')}) AS f")
def _(t: Tables) -> DataFrame:
    """Stored values decrypt to what was found."""
    vault = pii_scan.vault_rows(scanned_documents(t), ["doc_id"], SECRET)
    return pii_scan.open_vault(vault, SECRET).select("doc_id", "type", "index", "value", "readable")


@query(
    "vault_unreadable",
    f"SELECT count(*) FILTER (WHERE key % 2 = 0) AS readable, count(*) FILTER (WHERE key % 2 = 1) AS unreadable FROM ({found_sql('documents', 'doc_id', 'text')}) AS f",
)
def _(t: Tables) -> DataFrame:
    """Damaged rows are counted, not fatal."""
    vault = pii_scan.vault_rows(scanned_documents(t), ["doc_id"], SECRET)
    damaged = F.when(F.col("doc_id") % 2 == 1, F.reverse("encrypted_value")).otherwise(F.col("encrypted_value"))
    return pii_scan.unreadable_count(pii_scan.open_vault(vault.withColumn("encrypted_value", damaged), SECRET))


@query(
    "policy_dry_run",
    f"""SELECT key AS doc_id, kind AS type, detector_id, match, rule_id, action, CASE WHEN action = 'MASK' THEN {MASKED} END AS masked_preview
FROM ({found_sql('documents', 'doc_id', 'text').replace(" WHERE kind <> 'Host'", "")}) AS f""",
)
def _(t: Tables) -> DataFrame:
    return pii_scan.dry_run(documents(t), ["doc_id"], "body", POLICY)


# --- masks and checks ---


@query(
    "pii_masked",
    """SELECT c_custkey, repeat('*', 18) AS full_mask, concat(left(c_name, 4), repeat('#', 14)) AS prefix, concat(repeat('*', 14), right(c_name, 4)) AS suffix,
 concat(left(c_name, 3), repeat('*', 12), right(c_name, 3)) AS both_ends, regexp_replace(c_name, '[\\p{L}\\p{Nd}]', 'x', 'g') AS format, '[MASKED]' AS fixed, repeat('*', 18) AS unknown,
 repeat('*', 18) AS too_wide, concat('c', repeat('*', length(CAST(c_custkey AS VARCHAR))), '@', repeat('*', 11)) AS email FROM customer""",
)
def _(t: Tables) -> DataFrame:
    name = F.col("c_name")
    address = F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com"))
    return t.customer.select(
        "c_custkey",
        mask(name, {"strategy": "FULL"}).alias("full_mask"),
        mask(name, {"strategy": "keep_prefix", "visibleCharacters": 4, "maskCharacter": "#-"}).alias("prefix"),
        mask(name, {"strategy": "KEEP_SUFFIX", "visibleCharacters": 4}).alias("suffix"),
        mask(name, {"strategy": "KEEP_PREFIX_SUFFIX", "visibleCharacters": 3}).alias("both_ends"),
        mask(name, {"strategy": "PRESERVE_FORMAT", "maskCharacter": "x"}).alias("format"),
        mask(name, {"strategy": "FIXED"}).alias("fixed"),
        mask(name, {"strategy": "SOMETHING"}).alias("unknown"),
        mask(name, {"strategy": "KEEP_SUFFIX", "visibleCharacters": 99}).alias("too_wide"),
        mask(address, {"strategy": "EMAIL", "visibleCharacters": 1, "domainMode": "mask"}).alias("email"),
    )


@query(
    "card_checks",
    f"""SELECT o_orderkey, number, {LUHN.replace("kind <> 'CreditCard' OR ", "").replace("match", "number")} AS valid FROM (
 SELECT o_orderkey, printf('4%03d-%04d-%04d-%04d', o_custkey % 1000, o_orderkey % 10000, o_custkey % 10000, (o_orderkey * 7) % 10000) AS number FROM orders) AS x""",
)
def _(t: Tables) -> DataFrame:
    number = F.format_string(
        "4%03d-%04d-%04d-%04d", F.col("o_custkey") % 1000, F.col("o_orderkey") % 10000, F.col("o_custkey") % 10000, (F.col("o_orderkey") * 7) % 10000
    )
    return t.orders.select("o_orderkey", number.alias("number")).withColumn("valid", luhn_valid(F.col("number")))


@query("fingerprints", f"SELECT c_custkey, {HMAC.replace('match', 'c_name')} AS fingerprint FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fingerprint(F.col("c_name"), KEY).alias("fingerprint"))


LINES = "SELECT doc_id, array_to_string(string_split(text, ' '), chr(10)) AS log FROM documents"


@query("log_lines_joined", LINES)
@query("log_lines_whole", LINES)
def _(t: Tables) -> DataFrame:
    """Every word of a document as a log line."""
    return t.documents.select("doc_id", pii_scan.joined_log(F.split("text", " ")).alias("log"))


@query("placeholders", "SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN concat(left(text, strpos(text, 'the') - 1), '[Word-1]', substr(text, strpos(text, 'the') + 3)) ELSE text END AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", place_marker(F.col("text"), F.lit("the"), F.lit("Word"), F.lit(1)).alias("text"))
