"""The pipeline's near-duplicate stage against all pairs of five-word Jaccard 0.8."""

import corpus_pipeline
import numpy as np
from helpers import docs_frame, edited, prose
from xxhash import xxh64_intdigest

from opswatch.llm import near_copies, simhash


def jaccard(a, b):
    a, b = ({tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_stage_keeps_one_of_each_group(spark):
    texts = []
    for k in range(12):
        words = prose(k, 150 + 40 * k, 3000)
        texts += [" ".join(edited(words, 100 * k + e, e)) for e in (0, 1, 2, 3, 5, 9)]
    parent = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    docs = docs_frame(spark, list(enumerate(texts)))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for i, p in enumerate(parent) if i == p}
    by_simhash = {r.id for r in simhash.near_duplicates(docs).collect() if r.id == r.component_id}
    assert len(by_simhash) > len(kept)


def test_blank_null_and_repeated_rows(spark):
    rows = [(3, None), (2, " \n"), (5, "A b"), (4, "a  B"), (4, "a  B"), (None, "a b"), (6, "other words")]
    found = near_copies.near_copies(docs_frame(spark, rows)).collect()
    assert sorted((r.id or 0, r.component_id) for r in found) == [(0, 4), (2, 2), (3, 2), (4, 4), (4, 4), (5, 4), (6, 6)]
    assert near_copies.near_copies(docs_frame(spark, rows).filter("false")).count() == 0


def test_bands_find_the_threshold():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        common, own = rng.integers(0, 2**64, 160, dtype=np.uint64), rng.integers(0, 2**64, (2, 20), dtype=np.uint64)
        a, b = (near_copies.buckets(np.unique(np.concatenate([common, x]))) for x in own)
        missed += not (a == b).any()
    assert missed == 0
    assert len(near_copies.shingles("one two", xxh64_intdigest)) == 1


def test_fingerprints_meet_at_anchors(spark):
    """All pairs of Jaccard 0.8 share a bucket made of SimHash meetings alone; other texts meet nobody."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(150):
        common, own = rng.integers(0, 2**64, 160, dtype=np.uint64), rng.integers(0, 2**64, (2, 20), dtype=np.uint64)
        sets += [np.unique(np.concatenate([common, x])) for x in own]
    sets += [rng.integers(0, 2**64, 200, dtype=np.uint64) for _ in range(100)]
    rows = [(k, near_copies.prints(s).view(np.int64).tolist()) for k, s in enumerate(sets)]
    met = near_copies._meetings(spark.createDataFrame(rows, "key bigint, prints array<bigint>")).collect()
    buckets = {}
    for r in met:
        buckets.setdefault(r.bucket, set()).add(r.key)
    assert {frozenset(b) for b in buckets.values()} == {frozenset((2 * k, 2 * k + 1)) for k in range(150)}


def test_groups_of_an_anchor_are_connected_components():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, (6, 3), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (900, 3, 14), dtype=np.uint64)
    words = centres[rng.integers(0, 6, 900)] ^ np.bitwise_xor.reduce(flips, axis=2)
    home = rng.random(900) < 0.3
    group = near_copies.gathered(words, home)
    met = np.bitwise_count(words[:, None, :] ^ words[None, :, :]).sum(axis=2) <= near_copies.APART
    met &= home[:, None] | home[None, :]
    np.fill_diagonal(met, True)
    label = np.arange(900)
    while (least := np.where(met, label[None, :], 900).min(axis=1)).tolist() != label.tolist():
        label = np.minimum(label, least)
    assert 6 < len(set(label.tolist())) < 900
    assert [group.tolist().index(g) for g in group.tolist()] == label.tolist()


def test_texts_beside_a_large_group_are_not_compared_with_all_of_it(spark, monkeypatch):
    """Comparisons grow with the texts, not with the square of a group; the components are those of all pairs."""
    words = prose(7, 200, 3000)
    texts = [" ".join(edited(words, 1000 + k, 1 + k % 2)) for k in range(120)] + [" ".join(edited(words, 5000 + k, 5 + k % 6)) for k in range(60)]
    least = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    compared, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets: (compared.append(pairs.count()), verified(pairs, sets))[1])
    found = near_copies.near_copies(docs_frame(spark, list(enumerate(texts)))).collect()
    assert {r.id: r.component_id for r in found} == dict(enumerate(least))
    assert 10 < len(set(least)) < 70
    assert sum(compared) < 4 * len(texts)


def test_no_linked_pair_is_ruled_out(spark):
    """Sets at and above the threshold, of equal and of different sizes, meet at a prefix element."""
    rng = np.random.default_rng(4)
    rows, linked = [], []
    for k in range(200):
        n = int(rng.integers(4, 300))
        common = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
        more = n // 4  # the most that may come on top: n shared of n + n // 4
        left = int(rng.integers(0, more + 1))
        for extra in (left, more - left):
            rows.append((len(rows), np.unique(np.concatenate([common, rng.integers(-(2**63), 2**63, extra, dtype=np.int64)])).tolist()))
        if rows[-1][1] != rows[-2][1]:
            linked.append((len(rows) - 2, len(rows) - 1))
    sets = spark.createDataFrame(rows, "key bigint, values array<bigint>")
    mixed = near_copies._mixed(near_copies._prefixes(sets.select("key"), sets), spark.createDataFrame([(-1, -2)], "a bigint, b bigint"))
    for pairs in (near_copies._other_pairs(mixed), near_copies._first_pairs(mixed)):
        assert {tuple(sorted(p)) for p in pairs.collect()} == set(linked)
