import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in GAP.split(text or "") if w]


def docs_frame(spark, pairs):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(words, seed, edits):
    rng, out = random.Random(seed), list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out
