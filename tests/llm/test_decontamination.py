from collections import Counter

from helpers import docs_frame, edited, prose, words_of

from opswatch.llm import decontamination


def runs(words, size=5):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or Counter([tuple(words)])


def slow(docs, items):
    out = {}
    for d, text in docs:
        words = words_of((text or "").lower())
        for i, item in items:
            have = words_of((item or "").lower())
            if not have or len(words) < len(have):
                continue
            want = runs(have)
            if len(have) >= 5 and not want.keys() & runs(words).keys():
                continue
            best = max(
                sum((runs(words[s : s + len(have)]) & want).values()) / sum((runs(words[s : s + len(have)]) | want).values())
                for s in range(len(words) - len(have) + 1)
            )
            if best >= 0.8:
                out[d, i] = round(max(best, out.get((d, i), 0)), 9)
    return out


def frames(spark, docs, items):
    return docs_frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")


def test_against_every_window(spark):
    items = [(k, " ".join(prose(k, 12 + 7 * k))) for k in range(6)]
    items += [(50, "two words"), (51, None), (52, ""), (53, items[2][1]), (54, "r r r r r r r r r r r r")]
    docs = []
    for k in range(6):
        inside = prose(k, 12 + 7 * k)
        for e in range(4):
            docs.append((10 * k + e, " ".join(prose(100 + k, 30) + edited(inside, e, e) + prose(200 + k, 5 * e))))
    docs += [(500, "here are Two  Words."), (501, "two\nwords"), (502, None), (503, ""), (504, "r " * 40), (505, "x two words y z a b")]
    docs += [(None, items[3][1]), (506, items[0][1][:-4]), (507, items[1][1]), (507, items[1][1])]
    found = decontamination.contaminated(*frames(spark, docs, items)).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found} == slow(docs, items)
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})


def test_query_against_every_window(spark, sf_dir):
    from opswatch.llm.queries import op5_decontamination

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in op5_decontamination(spark, sf_dir).collect()}
    texts = dict(docs)
    some = {d for d, _ in found} | {d for d, _ in docs if d % 10 == 0}
    assert {k: v for k, v in found.items() if k[0] in some} == slow([(d, texts[d]) for d in some], items)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c d e f")], [(1, "a b c d e f")])
    assert decontamination.contaminated(docs.filter("false"), items).count() == 0
    assert decontamination.contaminated(docs, items.filter("false")).count() == 0
    clash = docs.selectExpr("*", "1 as item_id", "2 as pos", "3 as words")
    assert decontamination.contaminated(clash, items.selectExpr("*", "7 as doc_id")).count() == 1
