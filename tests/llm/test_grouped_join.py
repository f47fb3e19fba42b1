import random

from helpers import docs_frame, edited, prose, words_of

from opswatch.llm import grouped_join


def slow_sets(pairs):
    found = []
    for i, text in pairs:
        words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        own = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or ({tuple(words)} if words else set())
        found.append((i, own))
    return found


def slow_components(pairs):
    sets = slow_sets(pairs)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][1], sets[b][1]
            if one and two and 10 * min(len(one), len(two)) >= 9 * max(len(one), len(two)):
                if 100 * len(one & two) >= 90 * len(one | two):
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def found_in(docs):
    rows = grouped_join.similar_sets(docs).collect()
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def test_against_all_pairs(spark):
    """Copies with up to five edits around each text, chains, sizes at the limits, small and odd texts."""
    base = [prose(k, 9 + 14 * k, 60) for k in range(14)]
    pairs = [(1000 + k, " ".join(w)) for k, w in enumerate(base)]
    pairs += [(20 * k + j, " ".join(edited(w, j, j % 6))) for k, w in enumerate(base) for j in range(12)]
    chain = prose(77, 120)
    for k in range(12):
        chain = edited(chain, k, 1)
        pairs.append((2000 + k, " ".join(chain)))
    nine = [f"n{k}" for k in range(40)]
    pairs += [(3000 + k, " ".join(nine[:k])) for k in range(1, 40)]
    pairs += [(900, None), (901, ""), (902, " \n\t"), (903, "One Two"), (904, "one two"), (905, "a b c"), (905, "a b c"), (905, "other text here")]
    pairs += [(None, "one two"), (None, "only here without an id"), (906, "long " * 120_000), (907, "one"), (908, "Äb äb c")]
    assert found_in(docs_frame(spark, pairs)) == slow_components(pairs)


def test_dense_groups_with_common_surroundings(spark):
    """Members of one group (equal size and prefix) that differ in common elements only, and mixed elements' groups."""
    rng = random.Random(4)
    common = [prose(500 + k, 6, 12) for k in range(40)]
    pairs = [(k, " ".join(w for c in rng.sample(common, 30) for w in c)) for k in range(60)]
    rare = " ".join(f"r{k}" for k in range(30))
    pairs += [(100 + k, rare + " " + " ".join(w for c in common[k % 7 : k % 7 + 25] for w in c)) for k in range(40)]
    far = prose(9, 80)
    pairs += [(200 + k, " ".join(edited(far, k, k % 9))) for k in range(90)]
    assert found_in(docs_frame(spark, pairs)) == slow_components(pairs)


def test_filters_never_rule_out_a_link():
    rng = random.Random(8)
    import numpy as np

    counts = np.array([rng.randrange(1, 5) for _ in range(2 << grouped_join.COUNTER_BITS)])
    for _ in range(200):
        n = rng.randrange(1, 300)
        one = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        gone = rng.randrange(0, n // 10 + 1)
        two = np.unique(np.concatenate([one[gone:], np.array([rng.getrandbits(64) for _ in range(rng.randrange(2))], dtype=np.uint64)]))
        if 100 * len(np.intersect1d(one, two)) >= 90 * len(np.union1d(one, two)):
            a, b = grouped_join.prefix(one, counts).tolist(), grouped_join.prefix(two, counts).tolist()
            shared = [(a.index(x), b.index(x)) for x in a if x in b]
            assert shared
            assert all((min(i, j) + min(len(one) - i, len(two) - j)) * 19 >= 9 * (len(one) + len(two)) for i, j in shared)


def test_empty_table_and_extra_columns(spark):
    assert grouped_join.similar_sets(docs_frame(spark, []).filter("false")).count() == 0
    docs = docs_frame(spark, [(1, "a b c d"), (2, "A b c d")]).selectExpr("*", "1 as key", "2 as component_id", "3 as id", "4 as n", "5 as gid")
    assert found_in(docs) == [(1, 2, 1), (2, 2, 1)]
    named = docs_frame(spark, [(1, "a b c d"), (2, "A b c d")]).selectExpr("concat('k', doc_id) as doc_id", "text")
    assert found_in(named) == [("k1", 2, "k1"), ("k2", 2, "k1")]
