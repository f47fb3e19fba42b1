import numpy as np
from helpers import docs_frame
from tokenizers import Tokenizer

from opswatch.llm import bpe, html_content, lattice, quality_rules
from opswatch.llm.queries import tokenizer_path
from pyspark.sql import functions as F

TEXTS = [None, "", " \n", "It's  here<|endoftext|> now", "½²x \x1c a", "a" * 50_000, "ünï 12³", "same row", "same row"]


def test_bpe_round_trip(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = docs_frame(spark, list(enumerate(TEXTS[:-1])) + [(7, "same row"), (None, "no id")]).selectExpr("*", "1 as block", "2 as id")
    found = bpe.decode(bpe.encode(docs, path), path).collect()
    expected = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in enumerate(TEXTS[:-1])]
    expected += [(7, expected[7][1], "same row"), (None, tokenizer.encode("no id").ids, "no id")]
    actual = [(r["id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in found]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)
    both = [(r["id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in bpe.encode(docs, path, decoded=True).collect()]
    assert sorted(both, key=repr) == sorted(expected, key=repr)
    assert bpe.encode(docs.filter("false"), path).count() == 0


def test_ids_that_break_a_character_decode_like_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    whole = tokenizer.encode("日本 é 😀 end", add_special_tokens=False).ids
    for ids in ([], whole, whole[1:], whole[:-3], whole[::-1], whole[::2]):
        assert bpe.text_of(np.array(ids, dtype="<u4").tobytes(), path) == tokenizer.decode(ids, skip_special_tokens=False)


def test_gathered_stretches():
    starts, sizes, values = np.array([3, 0, 5]), np.array([2, 3, 0]), np.arange(10, 15)
    assert bpe.gathered(starts, sizes, values, np.array([1, 2, 0, 1])).tolist() == [10, 11, 12, 13, 14, 10, 11, 12]
    assert bpe.gathered(starts, sizes, values, np.zeros(0, dtype="<u4")).tolist() == []


def test_lattice_and_rules_keep_every_row(spark):
    docs = docs_frame(spark, list(enumerate(TEXTS)) + [(None, "no id")])
    rows = lattice.score(docs, tokenizer_path("piece_bpe_32k.model"), F.coalesce(F.col("doc_id") == 3, F.lit(False))).collect()
    assert len(rows) == len(TEXTS) + 1 and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    judged = quality_rules.judge(docs).collect()
    assert len(judged) == len(TEXTS) + 1 and all(r["base_failed"] and not r["kept"] for r in judged)
    assert quality_rules.judge(docs.filter("false")).count() == 0


def test_main_text():
    weights, ties = html_content.fitted()
    page = (
        "<body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  line,\nwith <em>words</em>.</p>"
        "<p>Second one.</p></article><footer>Rights reserved</footer></body>"
    )
    assert html_content.main_text(page, weights, ties) == "A & B First line, with words. Second one."
    assert html_content.main_text(None, weights, ties) == html_content.main_text("", weights, ties) == ""


def test_lattice_score_has_no_whole_word_arc(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    docs = docs_frame(spark, [(k, "the same seven words again and again") for k in range(50)] + [(99, "the")])
    rows = {r.id: r for r in lattice.score(docs, path, F.col("doc_id") == 99).collect()}
    assert np.isfinite(rows[99].lattice_score) and rows[99].lattice_score < rows[99].score
