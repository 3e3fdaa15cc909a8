import random
import re

import pytest

from keytide.llm.decontaminate import decontaminate, repeated

DOCS, ITEMS = "doc_id long, text string, win string, w int, tok string", "item_id long, text string, tok string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, width):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(width, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [64 << 20, 400])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(4)
    vocab = ["the", "of", "Zed", "é", "É", "K", "İ", "x1"] + [f"w{i}" for i in range(6)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, k=n))
    items = [(i, text(rng.randrange(1, 8))) for i in range(12)] + [(50, None), (51, ""), (52, " .. "), (53, "the"), (3, "of the Zed"), (54, "the of the of the of")]
    docs = [(i % 35, text(rng.randrange(0, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "the of " * 4000), (None, "of THE zed"), (7, "K k"), (7, "K k")]
    got = decontaminate(spark.createDataFrame([(*d, "a", 1, "b") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS), width=5, block_bytes=block_bytes)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 1, "")], DOCS), spark.createDataFrame([(1, "a b", "")], ITEMS)
    assert decontaminate(docs.limit(0), items).count() == 0
    assert [(r.n_words, r.n_hit) for r in decontaminate(docs, items.limit(0)).collect()] == [(2, 0)]


def test_many_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "", 1, "")] * 50 + [(2, "x", "", 1, "")], DOCS)
    got = decontaminate(docs, spark.createDataFrame([(1, "b c", ""), (2, "q", "")], ITEMS)).groupBy("doc_id", "n_words", "n_hit").count().collect()
    assert sorted(map(tuple, got)) == [(1, 3, 2, 50), (2, 1, 0, 1)]
    rows = spark.createDataFrame([(1, 10), (2, 1), (3, 4), (4, 5)], "id int, n long")
    for block in (1, 4, 100):
        assert sorted(r.id for r in repeated(rows, "n", block).collect()) == [1] * 10 + [2] + [3] * 4 + [4] * 5
