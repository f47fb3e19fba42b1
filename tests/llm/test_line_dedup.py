from helpers import docs_frame, edited, prose, words_of

from opswatch.llm import line_dedup


def tokens(line):
    words = words_of(line)
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def slow(docs):
    order = sorted({d for d, _ in docs}, key=lambda d: (d is not None, d or 0))
    lines = []
    for d in order:
        for at, text in docs:
            if at == d:
                lines += [(order.index(d), n, tokens(line)) for n, line in enumerate((text or "").split("\n")) if tokens(line)]
    gone = {}
    for d, n, have in lines:
        if n not in gone.get(order[d], ()) and any((e, m) < (d, n) and not have.isdisjoint(other) and len(have & other) >= 0.8 * len(have | other) for e, m, other in lines):
            gone.setdefault(order[d], set()).add(n)
    return {d: sorted(x) for d, x in gone.items()}


def cut(text, numbers):
    return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in numbers)


def test_against_all_pairs(spark):
    docs = []
    for k in range(12):
        words = prose(k, 8 + 6 * k)
        docs.append((k, "\n".join([" ".join(words), "short line", "", " ".join(prose(900 + k, 20))])))
        docs += [(100 + 4 * k + e, "x\n" + " ".join(edited(words, 7 * e, e))) for e in range(4)]
    docs += [(700, None), (701, ""), (702, "\n\n"), (703, "short  line\n"), (None, "null id line stands first"), (704, "null id line stands first")]
    docs += [(705, "same row\nonce more"), (705, "same row\nonce more"), (706, " ".join(prose(5, 30_000)))]
    expected = slow(docs)
    found = line_dedup.dedup_lines(docs_frame(spark, docs)).collect()
    assert len(found) == len(docs)
    assert {r["doc_id"]: list(r["removed_lines"]) for r in found if r["removed_lines"]} == expected
    texts = sorted(repr((r["doc_id"], r["text"])) for r in found)
    assert texts == sorted(repr((d, t if t is None else cut(t, expected.get(d, ())))) for d, t in docs)


def test_query_against_all_pairs(spark, sf_dir):
    from opswatch.llm.queries import op7_line_dedup

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["removed_lines"] for r in op7_line_dedup(spark, sf_dir).collect()}
    expected = {d: ",".join(map(str, n)) for d, n in slow(docs).items()}
    assert {d: n for d, n in found.items() if n} == expected and len(found) == len(docs)


def test_empty_table_and_extra_columns(spark):
    docs = docs_frame(spark, [(1, "a b c\na b c")])
    assert line_dedup.dedup_lines(docs.filter("false")).count() == 0
    clash = docs.selectExpr("*", "1 as n_lines", "2 as token", "3 as line_no", "4 as n", "5 as gone_id")
    row = line_dedup.dedup_lines(clash.drop("gone_id")).first()
    assert row["text"] == "a b c" and row["n_lines"] == 2 and row["token"] == 2
