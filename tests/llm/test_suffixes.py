from hashlib import sha256

from helpers import docs_frame, edited, prose

from opswatch.llm import suffixes


def slow(texts, length):
    seen = {}
    for k, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((k, s))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s : s + length] = b"\1" * length
    return gone


def answer(raw, mask):
    flags = bytes(mask)
    spans = sum(1 for i, m in enumerate(flags) if m and (i == 0 or not flags[i - 1]))
    return len(raw), sum(flags), spans, sha256(bytes(c for c, m in zip(raw, flags) if not m)).hexdigest()


def test_query_against_every_string(spark, sf_dir):
    from opswatch.llm.queries import op3_suffixes

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    raws = [(t or "").encode() for _, t in docs]
    expected = sorted((d, *answer(r, m)) for (d, _), r, m in zip(docs, raws, slow(raws, 400)))
    assert sorted(map(tuple, op3_suffixes(spark, sf_dir).collect())) == expected


def test_short_strings_against_every_string(spark):
    docs = [(k, " ".join(edited(prose(k % 3, 60), k, k % 4))) for k in range(12)]
    docs += [(20, None), (21, ""), (22, "ab" * 200), (23, "é" * 60), (24, "x" * 39), (25, "x" * 40), (26, "x" * 41), (None, docs[0][1]), (27, "y" * 40)]
    docs += [(28, "same row " * 9), (28, "same row " * 9)]
    raws = [(t or "").encode() for _, t in docs]
    found = suffixes.remove_repeats(docs_frame(spark, docs).selectExpr("*", "1 as uid", "2 as id"), length=40, gram=24).collect()
    actual = sorted(((r["id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), sha256(r["kept"]).hexdigest()) for r in found), key=repr)
    assert actual == sorted(((d, *answer(r, m)) for (d, _), r, m in zip(docs, raws, slow(raws, 40))), key=repr)


def test_loser_tree_sorts_and_counts():
    runs = [sorted({f"{a * b % 7:03d}{b % 5}".encode() for b in range(a, 60)}) for a in range(1, 8)]
    coded = []
    for k, run in enumerate(runs):
        before, out = b"", []
        for s in run:
            out.append((suffixes.common_prefix(before, s), s, k))
            before = s
        coded.append(iter(out))
    merged = list(suffixes.LoserTree(coded))
    assert [s for _, s, _ in merged] == sorted(s for run in runs for s in run)
    for (_, a, _), (shared, b, _) in zip(merged, merged[1:]):
        assert shared == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_empty_table(spark):
    assert suffixes.remove_repeats(docs_frame(spark, []).filter("false")).count() == 0
