import hashlib
import random
import zlib
from fractions import Fraction

from helpers import docs_frame, words_of

from opswatch.llm import periodic


def slow_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items() if not any(q % p == 0 and all(words[k] == words[k + p] for k in range(s, s + n - p)) for p in range(1, q)))


def slow_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def sequences():
    rng = random.Random(11)
    for k in range(250):
        letters = rng.choice([1, 2, 2, 3, 5])
        piece = [str(rng.randrange(letters)) for _ in range(rng.randrange(1, 14))]
        words = [str(rng.randrange(letters)) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(1, 4)):
            words += piece * rng.randrange(1, 9) + piece[: rng.randrange(len(piece))]
            words += [str(rng.randrange(letters + 1)) for _ in range(rng.randrange(30))]
            if k % 3 == 0:
                piece = piece + piece[: rng.randrange(len(piece))] * 2
        yield words
    yield ["a"] * 24
    yield ["a"] * 23
    yield [str(k) for k in range(8)] * 3
    yield [str(k) for k in range(9)] * 3
    yield ([str(k) for k in range(9)] * 3)[:-1]
    fib, nxt = ["0"], ["0", "1"]
    while len(nxt) < 400:
        fib, nxt = nxt, nxt + fib
    yield nxt


def test_runs_against_every_period():
    for words in sequences():
        expected = slow_runs(words)
        assert periodic.runs_of_words(words) == expected
        known = {}
        assert periodic.runs_of([known.setdefault(w, len(known)) for w in words]) == expected
        assert periodic.collapsed(words, expected) == slow_collapsed(words, expected)


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_every_period(spark, sf_dir):
    from opswatch.llm.queries import op13_periodic_runs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    actual = {r["doc_id"]: tuple(r)[1:] for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert len(actual) == len(docs)
    some = 0
    for key, text in docs:
        words = planted(key, words_of(text))
        if len(words) > 3000:
            continue
        runs = slow_runs(words)
        some += len(runs)
        s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), slow_collapsed(words, runs))]
        assert actual[key] == (len(runs), s, n, q, None if s is None else 1000 * n // q, *digests)
    assert some > 5


def test_odd_rows(spark):
    pairs = [(1, None), (2, ""), (3, " \n\t "), (4, "a  a\n" * 20), (4, "a  a\n" * 20), (None, "x y " * 12), (5, "b " * 60_000), (6, "Ü ü " * 12 + "\x1c")]
    docs = docs_frame(spark, pairs).selectExpr("*", "1 as runs", "2 as id", "3 as collapsed")
    rows = sorted(((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()), key=repr)
    expected = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 40, [(0, 40, 1)], "a"), (4, 40, [(0, 40, 1)], "a")]
    expected += [(None, 24, [(0, 24, 2)], "x y"), (5, 60_000, [(0, 60_000, 1)], "b"), (6, 25, [(0, 24, 2)], "Ü ü \x1c")]
    assert rows == sorted(expected, key=repr)
    assert periodic.periodic_runs(docs.filter("false")).count() == 0


def test_equal_exponents_go_to_the_earlier_and_shorter(spark):
    from pyspark.sql import functions as F

    kind = "runs array<struct<start: bigint, length: bigint, period: bigint>>"
    rows = [([(5, 24, 2), (0, 36, 3), (0, 24, 2)],), ([],), ([(9, 3 * 10**8 + 1, 10**8), (1, 3 * 10**8, 10**8)],)]
    found = spark.createDataFrame(rows, kind).select(periodic.exponent_first(F.col("runs")).alias("x")).collect()
    assert [r["x"] and tuple(r["x"]) for r in found] == [(0, 24, 2), None, (9, 3 * 10**8 + 1, 10**8)]
