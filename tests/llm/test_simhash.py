import numpy as np
from helpers import docs_frame, edited, prose, words_of
from xxhash import xxh64_intdigest

from opswatch.llm import simhash


def slow_print(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    values = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def slow_components(pairs):
    prints = [(i, slow_print(t)) for i, t in pairs]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, p, least.get(root(k))) for k, (i, p) in enumerate(prints)), key=repr)


def test_against_all_pairs(spark):
    base = [prose(k, 60 + 20 * k) for k in range(12)]
    pairs = [(100 + k, " ".join(w)) for k, w in enumerate(base)]
    pairs += [(10 * k + j, " ".join(edited(w, j, j))) for k, w in enumerate(base) for j in range(6)]
    pairs += [(900, None), (901, ""), (902, " \n\t"), (903, "One Two"), (904, "one two"), (905, "a b c d e"), (905, "a b c d e")]
    pairs += [(None, "one two"), (None, "only here without an id at all"), (906, "long " * 120_000)]
    found = simhash.near_duplicates(docs_frame(spark, pairs)).collect()
    actual = sorted(((r["id"], r["print"] % 2**64, r["component_id"]) for r in found), key=repr)
    assert actual == slow_components(pairs)


def test_query_against_all_pairs(spark, sf_dir):
    from opswatch.llm.queries import op8_simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    actual = sorted(((r[0], int(r[1], 16), r[2]) for r in op8_simhash(spark, sf_dir).collect()), key=repr)
    assert actual == slow_components([tuple(r) for r in docs])


def test_every_point_has_one_home_and_links_meet():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 200, dtype=np.uint64)
    row, key, home = simhash.anchors(prints)
    assert (np.bincount(row[home]) == 3).all()
    for k in range(200):
        other = prints[k]
        for b in rng.choice(64, 4, replace=False):
            other ^= np.uint64(1 << int(b))
        _, keys, _ = simhash.anchors(np.array([other]))
        assert set(key[(row == k) & home]) & set(keys)


def test_empty_table_and_extra_columns(spark):
    assert simhash.near_duplicates(docs_frame(spark, []).filter("false")).count() == 0
    docs = docs_frame(spark, [(1, "a b c d e"), (2, "a b c d e")]).selectExpr("*", "1 as print", "2 as component_id", "3 as id")
    assert sorted(map(tuple, simhash.near_duplicates(docs).select("id", "component_id").collect())) == [(1, 1), (2, 1)]
