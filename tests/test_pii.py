"""Masks, detection, policy and rewriting."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opswatch.functions.crypto import MissingKey, decrypt, encrypt, fingerprint
from opswatch.functions.field_paths import pattern_regex
from opswatch.functions.masking import STRATEGIES, luhn_valid, mask
from opswatch.operators.detection import NotJson, anchored, compiles, parse_json, rewrite_leaves, string_leaves
from opswatch.operators.policy import DEFAULT_DETECTORS, DEFAULT_POLICY, DEFAULT_RULES, Policy, context, policy_from_document
from opswatch.plans import pii_scan

GOLDEN = [
    ("4111-1111-1111-1111", {"strategy": "KEEP_SUFFIX", "visibleCharacters": 4}, "***************1111"),
    ("jane.doe@example.com", {"strategy": "EMAIL", "visibleCharacters": 2, "domainMode": "PRESERVE"}, "ja******@example.com"),
    ("jane.doe@example.com", {"strategy": "EMAIL", "visibleCharacters": 2, "domainMode": "MASK"}, "ja******@***********"),
    ("jane.doe@example.com", {"strategy": "email", "visibleCharacters": 9, "localVisiblePrefix": 1}, "j*******@example.com"),
    ("abcd1234", {"strategy": "KEEP_PREFIX_SUFFIX", "visibleCharacters": 4}, "********"),
    ("ab@x.com", {"strategy": "EMAIL", "visibleCharacters": 5}, "********"),
    ("secret", {"strategy": "NOPE"}, "******"),
    ("secret", {}, "******"),
    ("secret", {"strategy": "FIXED"}, "[MASKED]"),
    ("secret", {"strategy": "FIXED", "maskCharacter": "gone"}, "gone"),
    ("abc", {"strategy": "KEEP_PREFIX", "visibleCharacters": 10}, "***"),
    ("abcdef", {"strategy": "KEEP_PREFIX", "visibleCharacters": 2, "maskCharacter": "#x"}, "ab####"),
    ("abc", {"strategy": "KEEP_SUFFIX", "visibleCharacters": -3}, "***"),
    ("12-ab", {"strategy": "PRESERVE_FORMAT"}, "**-**"),
    ("12-ab", {"strategy": "PRESERVE_FORMAT", "maskCharacter": "$"}, "$$-$$"),
    ("no at sign", {"strategy": "EMAIL", "visibleCharacters": 2}, "no********"),
    ("-- --", {"strategy": "KEEP_SUFFIX", "visibleCharacters": 9}, "-- --"),
    ("日本語テキスト", {"strategy": "KEEP_PREFIX", "visibleCharacters": 2}, "日本*****"),
]


@pytest.mark.parametrize("value, config, expected", GOLDEN)
def test_mask(spark, value, config, expected):
    frame = spark.createDataFrame([(value,)], "v string")
    assert frame.select(mask(F.col("v"), config)).first()[0] == expected


def test_a_mask_never_returns_what_it_hides(spark):
    values = ["a", "ab", "a@b", "@", "1", "é", "x" * 40, "A-1", "4111-1111", "me@x.com", "*a*", "**"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for strategy in [s for s in STRATEGIES if s != "FIXED"] + ["", "odd"]:
        for visible in (0, 1, 2, 50):
            config = {"strategy": strategy, "visibleCharacters": visible}
            for row in frame.select("v", mask(F.col("v"), config).alias("m")).collect():
                assert row.m != row.v or not any(c.isalnum() for c in row.v), (config, row)


def test_luhn(spark):
    cases = {"4111-1111-1111-1111": True, "4111-1111-1111-1112": False, "": False, "---": False, "4111a": False}
    frame = spark.createDataFrame([(v,) for v in cases], "v string")
    assert {r.v: r.ok for r in frame.select("v", luhn_valid(F.col("v")).alias("ok")).collect()} == cases


@pytest.mark.parametrize(
    "path, hit",
    [("customers[7].phone", True), ("customers[0].name", False), ("vendors[0].phone", False), ("customers[0].phone.ext", False), ("", False)],
)
def test_field_path(spark, path, hit):
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(F.col("p").rlike(pattern_regex("customers[*].phone"))).first()[0] is hit


def test_fingerprint_is_a_keyed_hash(spark):
    import hashlib
    import hmac

    frame = spark.createDataFrame([("me@x.com",)], "v string")
    for key in (b"", b"k", b"long" * 40):
        expected = hmac.new(key, b"me@x.com", hashlib.sha256).hexdigest()
        assert frame.select(fingerprint(F.col("v"), key)).first()[0] == expected


def test_vault(spark):
    frame = spark.createDataFrame([("4111",), ("",)], "v string")
    stored = frame.select("v", encrypt(F.col("v"), b"s").alias("e"))
    opened = stored.select("v", decrypt(F.col("e"), b"s").alias("d"), decrypt(F.col("e"), b"other").alias("wrong")).collect()
    assert all(r.d == r.v and r.wrong is None for r in opened)
    broken = spark.createDataFrame([("short",), ("not base64!",), (None,)], "e string")
    assert all(r[0] is None for r in broken.select(decrypt(F.col("e"), b"s")).collect())
    with pytest.raises(MissingKey):
        encrypt(F.lit("x"), b"")


def scan(spark, texts, policy=DEFAULT_POLICY, source="JOB_RESULT", limit=None):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    return pii_scan.scan_artifacts(frame, policy, source, limit=limit).orderBy("id").collect()


def test_detects_the_four_built_in_types(spark):
    row = scan(spark, ["Email me@x.com call 081-234-5678 ssn 123-45-6789 card 4111-1111-1111-1111"])[0]
    assert [f.type for f in row.findings] == ["Phone", "SSN", "Email", "CreditCard"]
    assert row.sanitized_body == "Email ******** call [Phone-1] ssn [SSN-1] card *******************"


@pytest.mark.parametrize(
    "text, expected",
    [
        ('[{"p":"555-123-4567"}]', '[{"p":"[Phone-REDACTED]"}]'),
        ('{"n":"call 555-123-4567 or 555-987-6543"}', '{"n":"call [Phone-REDACTED] or [Phone-REDACTED]"}'),
        ('{"b":"555-123-4567","a":12345678901234567890,"c":10.50}', '{"a":12345678901234567890,"b":"[Phone-REDACTED]","c":10.50}'),
        ('"555-123-4567"', '"[Phone-REDACTED]"'),
        ('{ "a" : 10.50 }', '{ "a" : 10.50 }'),
        ('{"a":"\\u0035\\u0035\\u0035-123-4567"}', '{"a":"[Phone-REDACTED]"}'),
        ('{"a":1} tail 555-123-4567', '{"a":1} tail [Phone-1]'),
        ("5551234567", "5551234567"),
        ('{"x":NaN,"p":"555-123-4567"}', '{"x":NaN,"p":"[Phone-1]"}'),
        ("é 555-123-4567 é", "é [Phone-1] é"),
        ("", ""),
    ],
)
def test_rewriting(spark, text, expected):
    assert scan(spark, [text])[0].sanitized_body == expected


def test_long_bodies_are_cut_where_a_character_starts(spark):
    rows = scan(spark, ["a" * 8192, "a" * 8193, "a" * 8191 + "é", "日" * 4000, "a" * 8190 + "😀"], limit=pii_scan.MAX_BODY_BYTES)
    assert [(r.truncated, len(r.sanitized_body)) for r in rows] == [(False, 8192), (True, 8192), (True, 8191), (True, 2730), (True, 8190)]
    assert rows[3].original_bytes == 12000


def test_nul_characters_are_removed(spark):
    assert scan(spark, ["a\0b 555-123-4567"])[0].sanitized_body == "ab [Phone-1]"


def test_failed_detectors_withhold(spark):
    broken = Policy("b", 1, [*DEFAULT_DETECTORS, {"id": "x", "piiType": "X", "pattern": "(", "enabled": True}], DEFAULT_RULES)
    row = scan(spark, ["call 555-123-4567", ""], broken)
    assert broken.failed_detectors == ["x"]
    assert (row[0].scan_status, row[0].withheld, row[0].sanitized_body) == ("SCAN_ERROR", True, "")
    assert (row[1].scan_status, row[1].withheld) == ("CLEAN", False)


def test_rewrite_fails_closed():
    good = {"path": "a", "start": 0, "end": 3, "match": "abc", "replacement": "X"}
    assert rewrite_leaves('{"a":"abcd"}', [good]) == '{"a":"Xd"}'
    assert rewrite_leaves('{"a":"abcd"', [good]) is None
    assert rewrite_leaves('{"a":"abcd"} x', [good]) is None
    assert rewrite_leaves('{"b":"abcd"}', [good]) is None
    assert rewrite_leaves('{"a":"zbcd"}', [good]) is None
    assert rewrite_leaves('{"a": "abcd"}', [{**good, "replacement": None}]) == '{"a": "abcd"}'


def test_json_paths():
    leaves = dict(string_leaves(parse_json('{"a":{"b":["x",{"c.d":"y"}]},"n":1,"t":true,"e[0]":"z"}')))
    assert leaves == {"a.b[0]": "x", "a.b[1].c\\.d": "y", "e\\[0\\]": "z"}
    for bad in ("1", "true", "null", "{", '{"a":1} {}', '{"a":1e999}', "NaN"):
        with pytest.raises(NotJson):
            parse_json(bad)


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.text(max_size=8) | st.integers() | st.booleans() | st.none(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=12))
def test_untouched_json_comes_back_as_it_was(value):
    import json

    text = json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict | list | str):
        assert rewrite_leaves(text, []) == text


def test_pattern_language():
    assert compiles(r"\d+") and compiles("(?i)abc") and compiles(r"a\\1")
    assert not compiles("(?=a)b") and not compiles(r"(a)\1") and not compiles("(") and not compiles("(?<!a)b")
    assert anchored("^a") and anchored("a$") and not anchored(r"[^\s@]+@") and not anchored(r"\bx")


RULED = Policy(
    "p", 1,
    [
        {"id": "long", "piiType": "A", "pattern": r"\d{6}", "enabled": True},
        {"id": "short", "piiType": "B", "pattern": r"\d{3}", "enabled": True},
        {"id": "word", "piiType": "C", "pattern": r"[a-z]+", "enabled": True},
    ],
    [
        {"id": "ignore-words", "priority": 1, "match": {"piiTypes": ["C"]}, "action": {"type": "IGNORE"}},
        {"id": "path", "priority": 50, "match": {"fieldPaths": ["items[*].code"]}, "action": {"type": "BLOCK"}},
        {"id": "labelled", "priority": 99, "match": {"labels": ["gdpr"]}, "action": {"type": "REDACT"}},
    ],
)


def test_overlaps_keep_the_better_finding(spark):
    row = scan(spark, ["123456 789 abc"], RULED)[0]
    assert [(f.detector_id, f.match, f.rule.rule_id, f["index"]) for f in row.findings] == [("long", "123456", "default", 1), ("short", "789", "default", 1)]


def test_field_path_rules_match_json_only(spark):
    rows = scan(spark, ['{"items":[{"code":"123"}],"other":"456"}', "items 123"], RULED)
    assert [(f.path, f.rule.rule_id) for f in rows[0].findings] == [("items[0].code", "path"), ("other", "default")]
    assert [f.rule.rule_id for f in rows[1].findings] == ["default"]


def test_blocked_submission(spark):
    tasks = spark.createDataFrame(
        [("j1", "n 123", '{"items":[{"code":"123"}]}', "T", "q", "Pending"), ("j2", "", "plain", "T", "q", "Pending")],
        "job_id string, task_name string, payload string, task_type string, queue string, status string",
    )
    rows = {r.job_id: r for r in pii_scan.scan_submissions(tasks, RULED).collect()}
    assert (rows["j1"].status, rows["j1"].blocked, rows["j1"].payload) == ("Blocked", True, '{"items":[{"code":"[B-REDACTED]"}]}')
    assert [f["index"] for f in rows["j1"].name_findings] == [2]
    assert (rows["j2"].status, rows["j2"].scan_status) == ("Pending", "CLEAN")
    vault = pii_scan.vault_rows(pii_scan.scan_submissions(tasks, RULED), ["job_id"], b"s", "payload_findings")
    assert vault.count() == 0


def test_policy_document():
    policy = policy_from_document(
        {"metadata": {"name": "n", "version": 2, "checksum": "c"}, "spec": {"defaults": {"action": "MASK"}, "detectors": DEFAULT_DETECTORS, "rules": DEFAULT_RULES}}
    )
    assert (policy.name, policy.version, policy.default_action) == ("n", 2, "MASK")
    assert [r["id"] for r in policy.ordered_rules][0] == "redact-pii-in-metadata"


def test_findings_of_every_row_keep_their_row(spark):
    texts = [f"row {i} 555-123-{i:04d}" if i % 3 == 0 else f"row {i}" for i in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(7)
    scanned = pii_scan.with_findings(frame, "body", DEFAULT_POLICY, context("JOB_RESULT"))
    got = {r.id: [f.match for f in r.findings] for r in scanned.select("id", "findings").collect()}
    assert got == {i: ([f"555-123-{i:04d}"] if i % 3 == 0 else []) for i in range(500)}


def test_pattern_language():
    from opswatch.operators.detection import compiled, compiles

    def finds(pattern, text):
        return compiles(pattern) and [m.group() for m in compiled([(0, pattern)])[0][1].finditer(text)]

    assert finds("[[:digit:]]{3}-[[:digit:]]{4}", "call 555-1234") == ["555-1234"]
    assert finds("[[:alpha:]_]+", "ab_c 12") == ["ab_c"]
    assert finds("[^[:space:][:punct:]]+", "a, b]") == ["a", "b"]
    assert finds(r"\Qa.b[\E+", "a.b[[ axb[") == ["a.b[["]
    assert finds(r"\x{41}\x{1F600}", "A\U0001F600") == ["A\U0001F600"]
    assert finds("[a&&b]+", "a&b") == ["a&b"]
    assert finds(r"\d*\++", "1++") == ["1++"]
    assert finds("[*+]+", "*+") == ["*+"]
    for refused in ("[[:^digit:]]", "[[:what:]]", "a++", "a*+b", "(?>a)", "(?x)a b", r"\p{Nope}", r"\pX", r"\p{L", r"\P{Any}", "(?Ux)a", "(?U)a++", "(?=a)", r"(a)\1", r"\x{110000}"):
        assert not compiles(refused), refused
    assert compiles("(?i)abc") and compiles("(?i:abc)") and compiles("a+?")


def test_categories_and_the_ungreedy_flag():
    from opswatch.operators.detection import compiled, compiles

    def finds(pattern, text):
        return compiles(pattern) and [m.group() for m in compiled([(0, pattern)])[0][1].finditer(text)]

    assert finds(r"\pL+", "abc Éa1 жк_") == ["abc", "Éa", "жк"]
    assert finds(r"\p{Lu}\p{Ll}+", "Émile Zola zola") == ["Émile", "Zola"]
    assert finds(r"[\p{Nd}_-]+", "٣4_-a\U0001d7d8") == ["٣4_-", "\U0001d7d8"]
    assert finds(r"\PL+", "a1 b") == ["1 "] and finds(r"\p{^L}+", "a1 b") == ["1 "] and finds(r"\P{^L}+", "a1 b") == ["a", "b"]
    assert finds(r"[^\pL\s]+", "a1]b \\^-") == ["1]", "\\^-"]
    assert finds(r"[\P{L}]+", "a1 b") == ["1 "]
    assert finds(r"\p{Any}", "a\n\U0001F600") == ["a", "\n", "\U0001F600"]
    assert finds(r"\pC", "a\t\u0378\u200b") == ["\t", "\u200b"]
    assert finds(r"\p{Sm}\p{Ps}\pP", "+(]") == ["+(]"]
    assert finds("(?U)a+", "aaa") == ["a", "a", "a"] and finds("(?U)a+?", "aaa") == ["aaa"]
    assert finds("(?U)<.*>", "<a><b>") == ["<a>", "<b>"] and finds("(?U:<.*>)-.*", "<a><b>-xy") == ["<a><b>-xy"]
    assert finds("(?iU)A{2,3}", "aaaa") == ["aa", "aa"] and finds("((?U)a+)b*", "aabb") == ["a", "abb"]
    assert finds("(?U)(?-U:a+)b+", "aabb") == ["aab"] and finds(r"(?U)[*+]+\Q*+\E\++", "*+*+++") == ["*+*++"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30), st.sampled_from(["L", "Lu", "Nd", "P", "Zs", "M", "Cc", "So"]), st.booleans())
def test_category_equals_the_character_table(text, name, negated):
    from opswatch.operators.detection import compiled

    pattern = compiled([(0, f"\\{'P' if negated else 'p'}{{{name}}}")])[0][1]
    expected = [c for c in text if unicodedata.category(c) != "Cs" and unicodedata.category(c).startswith(name) != negated]
    assert pattern.findall(text) == expected


def test_patterns_mean_the_same_in_the_jvm(spark):
    """The native filter and the search agree on text that the filter decides."""
    from opswatch.operators.detection import compiled, portable

    patterns = [r"\pL\pN+", r"[\p{Lu}\-]{2,}", r"\P{L}\p{Ps}", "(?U)x.*y", r"[^\p{L}\p{Zs}\pP]+", r"\p{Sm}", "(?U:a+)b"]
    texts = ["a1", "ab", "AB-", " (", "a(", "x--y", "1+1", "<a>", "aab", "\\[]^", "", "\t~", "é1", "Жд", "\U0001d7d8+"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in patterns:
        native = [r[0] for r in frame.selectExpr("t").select(F.col("t").rlike("(?d)" + portable(pattern, r"\z", native=True))).collect()]
        assert native == [bool(compiled([(0, pattern)])[0][1].search(t)) for t in texts], pattern


def test_bodies_are_whole_without_a_limit(spark):
    text = "日" * 4000 + " 555-123-4567 " + "a" * 9000
    frame = spark.createDataFrame([(1, text)], "id int, body string")
    row = pii_scan.scan_artifacts(frame, DEFAULT_POLICY, "JOB_RESULT").first()
    assert row.sanitized_body == text.replace("555-123-4567", "[Phone-1]") and not row.truncated


def test_log_keeps_every_line(spark):
    frame = spark.createDataFrame([([str(k) for k in range(50)],)], "lines array<string>")
    assert frame.select(pii_scan.joined_log(frame.lines)).first()[0] == "\n".join(str(k) for k in range(50))


def walked(findings):
    """Every finding against every kept one, in order."""
    kept = []
    for i, f in enumerate(findings):
        for k, j in enumerate(kept):
            g = findings[j]
            apart = f["path"] and g["path"] and f["path"] != g["path"]
            if not apart and f["start"] < g["end"] and g["start"] < f["end"]:
                if (-f["priority"], -f["size"], f["detector_id"]) < (-g["priority"], -g["size"], g["detector_id"]):
                    kept[k] = i
                break
        else:
            kept.append(i)
    return kept


def test_settled_positions_against_all_pairs():
    from opswatch.operators.policy import settled_positions

    rng = random.Random(12)
    for _ in range(600):
        paths = rng.choice([[""], ["a", "b"], ["", "a", "b"]])
        found = []
        for _ in range(rng.randrange(25)):
            start, size = rng.randrange(40), rng.randrange(8)
            found.append({"path": rng.choice(paths), "start": start, "end": start + size, "size": size, "priority": rng.randrange(3), "detector_id": rng.choice("xyz")})
        assert settled_positions(found) == walked(found)


def test_ten_thousand_findings_in_one_text(spark):
    """Numbers, places and rewriting of many findings, with characters of every width and overlaps."""
    line = "日 555-123-{:04d} é \U0001F600 "
    rows = [(n, "".join(line.format(k) for k in range(n))) for n in (1, 1000, 10_000)]
    frame = spark.createDataFrame(rows, "id int, body string").repartition(3)
    scanned = pii_scan.with_sanitized(pii_scan.with_findings(frame, "body", DEFAULT_POLICY, context("JOB_RESULT")), "body", DEFAULT_POLICY, "clean")
    for r in scanned.select("id", "findings", "clean").collect():
        assert [f["index"] for f in r.findings] == list(range(1, r.id + 1))
        assert r.clean == "".join(f"日 [Phone-{k + 1}] é \U0001F600 " for k in range(r.id))
    crossing = [{"path": "", "start": 3 * k, "end": 3 * k + 5, "size": 5, "priority": k % 2, "detector_id": "d"} for k in range(2000)]
    from opswatch.operators.policy import settled_positions

    assert settled_positions(crossing) == walked(crossing)


def test_rewriting_overlapping_spans_one_by_one(spark):
    from opswatch.operators.detection import replaced
    from opswatch.operators.policy import rewritten_text

    kind = "text string, spans array<struct<path: string, start: int, end: int, match: string, replacement: string>>"
    spans = [("", 2, 6, "cdef", "<1>"), ("", 4, 8, "efgh", "<2>"), ("", 0, 1, "a", None)]
    apart = [("", 8, 9, "i", "<3>"), ("", 0, 2, "ab", ""), ("", 2, 2, "", "<0>")]
    rows = [("abcdefghij", spans), ("abcdefghij", apart), ("abcdefghij", []), ("abc", [("", 0, 3, "abc", "x")]), (None, [])]
    found = [r[0] for r in spark.createDataFrame(rows, kind).select(rewritten_text(F.col("text"), F.col("spans"))).collect()]
    assert found == ["ab<1>>ij", "<0>cdefgh<3>j", "abcdefghij", "x", None]
    keys = ("path", "start", "end", "match", "replacement")
    todo = sorted((dict(zip(keys, s)) for s in spans if s[4] is not None), key=lambda s: s["start"])
    assert replaced("abcdefghij", todo) == "ab<1>>ij"
