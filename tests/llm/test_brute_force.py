import math
import random

import numpy as np
from helpers import docs_frame, edited, prose, words_of

from opswatch.llm import importance, lattice, line_dedup, quality_rules


def test_repeated_windows_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(60))]
        windows = [tuple(ids[i : i + 8]) for i in range(len(ids) - 7)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert quality_rules.repeated_words(np.array(ids, dtype=np.int64)) == len(covered)


def test_measured_counts():
    text = "One TWO\n\n one two # <b> x\nOne TWO\r\n"
    found = dict(zip(quality_rules.COUNTS, quality_rules.measure(text)))
    words = words_of(text)
    assert (found["n_words"], found["word_chars"]) == (len(words), sum(map(len, words)))
    assert found["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
    assert found["n_dup_lines"] == 0
    assert quality_rules.measure("a b\n\na b\na b")[3] == 2


def test_lattice_sums_all_segmentations():
    weights = {s: math.log(w) for s, w in {"▁a": 0.1, "▁": 0.05, "a": 0.2, "ab": 0.15, "b": 0.1, "▁ab": 0.02}.items()}
    single = [math.log(0.001)] * 256

    def total(text):
        if not text:
            return 1.0
        own = math.prod(math.exp(single[b]) for b in text[0].encode()) * total(text[1:])
        return own + sum(math.exp(w) * total(text[len(s) :]) for s, w in weights.items() if text.startswith(s))

    for word in ("a", "ab", "abab", "xa", "é", ""):
        found = lattice.word_log_probability(word, weights, single)
        assert math.isclose(found, math.log(total(lattice.MARK + word)), rel_tol=1e-9)


def test_kth_largest_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([-(10**12), 0, 7, 7, 10**9]) + rng.randrange(3) for _ in range(300)] + [10**15]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in (1, 2, 17, 150, len(values)):
        assert importance.kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]


def test_ratios_say_nothing_where_the_models_agree():
    raw = np.zeros(importance.SPACES * importance.SPACE, dtype=np.int64)
    raw[:1000] = 500
    assert np.abs(importance.log_ratios(raw, raw // 10)[:1000]).max() < 1e-6
    target = raw // 10
    target[0] *= 20
    ratios = importance.log_ratios(raw, target)
    assert ratios[0] > 1 > 0 > ratios[1]


def _runs(line):
    words = words_of(line)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_large_group_of_near_copies(spark):
    """Many copies around two centres, so that some are like no head of their tokens."""
    base = prose(1, 60)
    other = edited(base, 2, 2)
    lines = [" ".join(edited(base if k % 2 else other, k, k % 4)) for k in range(80)]
    texts = ["\n".join(lines[k : k + 4]) for k in range(0, 80, 4)]
    removed = {r["doc_id"]: list(r["removed_lines"]) for r in line_dedup.dedup_lines(docs_frame(spark, list(enumerate(texts)))).collect()}
    earlier, expected = [], {}
    for doc, text in enumerate(texts):
        for number, line in enumerate(text.split("\n")):
            own = _runs(line)
            if any(len(own & e) >= 0.8 * len(own | e) for e in earlier):
                expected.setdefault(doc, []).append(number)
            earlier.append(own)
    assert {d: r for d, r in removed.items() if r} == expected
    assert 0 < sum(map(len, expected.values())) < 80
