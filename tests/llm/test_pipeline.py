"""Each stage of the pipeline against a plain version of its decision on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from keytide.llm import quality, toxicity
from keytide.llm.common import cut, table
from tests.llm.test_near_dups import brute as components

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        got = cut(stage(spark, docs, SF))
        out.append((name, docs, got))
        docs = got
    return {n: (a, b) for n, a, b in out}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_shape(stages):
    assert list(stages) == ["toxicity", "quality", "near_dups", "decontaminate", "pack"]
    for name, (a, b) in stages.items():
        if name != "pack":
            assert b.columns == COLS == a.columns and set(ids(b)) <= set(ids(a)) and b.count() > 0
            assert b.exceptAll(a).count() == 0


def test_toxicity(spark, stages):
    a, b = stages["toxicity"]
    model = toxicity.fit(a, table(spark, SF, "labels"))
    want = []
    for r in a.collect():
        w = (r.text or "").split()
        at = [i for i, x in enumerate(w) if model.weight_of(x)]
        import numpy as np

        e = model.evidence(len(w), toxicity.segments(np.array(at, int), np.array([model.weight_of(w[i]) for i in at]), model.drift)) if at else 0.0
        if model.probability(e) < 0.7:
            want.append(r.doc_id)
    assert ids(b) == sorted(want)


def test_quality(spark, stages):
    a, b = stages["quality"]
    model = quality.fit(a, table(spark, SF, "labels"))
    rows = quality.resample(a, model).collect()
    k = sum(r.log_weight >= model.threshold for r in rows)
    assert ids(b) == sorted(r.doc_id for r in sorted(rows, key=lambda r: -r.gumbel_key)[:k])
    good = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()} & set(ids(a))
    assert len(good & set(ids(b))) >= 0.95 * len(good)


def test_near_dups(stages):
    a, b = stages["near_dups"]
    assert ids(b) == [d for d, _, _, kept in components([(r.doc_id, r.text) for r in a.collect()], 5) if kept]


def test_decontaminate(spark, stages):
    a, b = stages["decontaminate"]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = set()
    for r in table(spark, SF, "benchmark").collect():
        w = low(r.text)
        n = min(10, len(w))
        wins |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    lens = {len(x) for x in wins}

    def clean(t):
        w = low(t)
        return not any(tuple(w[i : i + n]) in wins for n in lens for i in range(len(w) - n + 1))

    assert ids(b) == sorted(r.doc_id for r in a.collect() if clean(r.text))


def test_pack(stages):
    a, b = stages["pack"]
    assert set(ids(b)) == set(ids(a))
    rows = b.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rows = [(1, None, "en", None, 3, "x", 1), (1, None, "en", None, 3, "x", 1), (2, "", None, "s", None, "x", 1), (3, "word " * 30_000, "en", "s", 1, "x", 1), (3, "word " * 30_000, "en", "s", 1, "x", 1), (4, "a b c d e f", "en", "s", 1, "x", 1), (5, "A b c d e f", "en", "s", 1, "x", 1), (None, "lonely", "en", "s", 1, "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, _id int"
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], schema)
        for name, stage in P.STAGES:
            docs = cut(stage(spark, docs, str(tmp_path)))
            if name != "pack":
                assert docs.columns == [*COLS, "h", "_id"]
            if name == "near_dups" and n:
                assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "4", "None"]
    assert F is not None


def test_unrelated_texts_without_or_under_one_id_all_stay(spark):
    t = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(9)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (None, t[2]), (None, ""), (None, ""), (5, t[3]), (5, t[4]), (5, t[4]), (5, ""), (5, ""), (6, t[3]), (None, t[3]), (7, t[5]), (7, t[5] + " z"), (8, t[6])]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_dups(spark, docs, "").collect()]
    seven = [x for x in got if x[0] == 7]
    assert len(seven) == 1 and seven[0][1] in (t[5], t[5] + " z")
    key = lambda x: (str(x[0]), x[1])
    want = [(None, t[0]), (None, t[1]), (None, t[2]), (None, ""), (None, ""), (5, t[3]), (5, t[4]), (5, ""), (8, t[6])]
    assert sorted((x for x in got if x[0] != 7), key=key) == sorted(want, key=key)
