import random
import re
import zlib
from collections import Counter

from helpers import docs_frame

from opswatch.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_counts(pairs, every):
    total = Counter()
    for key, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    total.pop("", None)
    return total


def slow_variants(total):
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and x != w and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), words[w], len(near[w]), words.get(form.get(w))) for w in words)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


def test_near_words_against_all_pairs(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abÀé") for _ in range(rng.randrange(5, 9))) for _ in range(400)}
    words |= {"aaaaa" + "a" * k for k in range(12)} | {"b" * k for k in range(2, 9)} | {"ab", "ba", "a", "b"}
    frame = spark.createDataFrame([(w, rng.randrange(1, 50)) for w in sorted(words)], "word string, n bigint")
    found = [(r["word"], r["near"]) for r in spelling.near_words(frame).collect()]
    sized = [w for w in words if len(w) > 1]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in sized for b in sized if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}


def test_variants_with_chains_and_ties(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 8))) for _ in range(300)]
    total = Counter({w: rng.choice([1, 2, 3, 3, 4, 6, 8, 16, 32, 64]) for w in words})
    total.update({"x" * 6 + "y" * k: 3 * 2 ** (9 - k) for k in range(10)})
    frame = spark.createDataFrame([(w, n) for w, n in total.items()] + [(None, 9)], "word string, n bigint").selectExpr("*", "1 as form", "2 as of")
    expected = slow_variants(total)
    assert rows_of(spelling.variants(frame)) == expected
    assert max(sum(r[2] == w for r in expected) for w in {r[2] for r in expected}) >= 10
    assert rows_of(spelling.variants(frame.filter("false"))) == []


def test_query_against_brute_force(spark, sf_dir):
    from opswatch.llm.queries import op12_spelling

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = slow_variants(slow_counts(docs, 97))
    assert rows_of(op12_spelling(spark, sf_dir)) == expected and any(r[1] for r in expected)


def test_counts_of_odd_texts(spark, monkeypatch):
    pairs = [(1, None), (2, ""), (3, "It's ÀÉ×÷é 12ab_cd"), (3, "It's ÀÉ×÷é 12ab_cd"), (None, "no id here"), (4, "long " * 90_000), (5, "a" * 70_000)]
    pairs += [(k, "some words that are often met and sometimes lose a letter") for k in range(100, 160)]
    docs = docs_frame(spark, pairs).selectExpr("*", "1 as n", "2 as word", "3 as id")
    for every in (None, 7):
        found = {r["word"]: r["n"] for r in spelling.word_counts(docs, misspell_every=every).collect()}
        assert found == dict(slow_counts(pairs, every))
    assert spelling.word_counts(docs.filter("false")).count() == 0
