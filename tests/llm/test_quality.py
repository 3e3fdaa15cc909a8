import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from keytide.llm import quality as Q
from keytide.llm.common import table

SF = "/root/testdata/sf0.1"


def test_ngrams_mark_capitals_and_repeats():
    g = Q.ngrams("Spam spam SPAM !! !!")
    assert (g == Q._CAPS).sum() == 1 and (g == Q._REPEAT).sum() == 3 and len(g) == 5 + 4 + 1 + 3
    assert len(Q.ngrams(None)) == len(Q.ngrams("")) == len(Q.ngrams(" \n")) == 0
    assert (Q.ngrams("a b")[:2] != Q.ngrams("b a")[:2]).all() and Q.ngrams("a b")[2] != Q.ngrams("b a")[2]


def plain_buckets(text):
    """The buckets by their definition, one token at a time in unbounded integers."""
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    bucket = lambda h: 16 + (wrap(h * 0x9E3779B1) >> 7) % (10_000 - 16)
    out, before = [], None
    for token in re.findall(r"\w+|[^\w\s]+", text or ""):
        h = zlib.crc32(token.lower().encode())
        out.append(bucket(h))
        if before is not None:
            out.append(bucket(wrap(before * 31 + h)))
            out += [2] if before == h else []
        out += [1] if len(token) > 1 and token.isupper() else []
        before = h
    return sorted(out)


def test_ngrams_against_their_definition(spark):
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect()[:120]:
        assert plain_buckets(r.text) == sorted(Q.ngrams(r.text).tolist())


def test_weights_against_brute_force(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = Q.fit(docs, labels)
    rows, good = docs.collect(), {r.doc_id for r in labels.collect() if r.quality == 1}
    raw = sum(np.bincount(Q.ngrams(r.text), minlength=Q.BUCKETS) for r in rows) + 1e-3
    target = sum(np.bincount(Q.ngrams(r.text), minlength=Q.BUCKETS) for r in rows if r.doc_id in good)
    p = raw / raw.sum()
    t = target + p * Q.BUCKETS / 100
    want = np.log(t / t.sum() / p)
    out = {r.doc_id: r for r in Q.resample(docs, model).collect()}
    for r in rows:
        g = Q.ngrams(r.text)
        assert out[r.doc_id].n_grams == len(g) and abs(out[r.doc_id].log_weight - want[g].sum()) < 1e-6 * (1 + len(g))


def test_top_k_is_exact(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = Q.fit(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    for k in (1, 137, 1000):
        out = Q.resample(docs, model, k=k, seed=k).collect()
        cut = sorted((r.gumbel_key for r in out), reverse=True)[k - 1]
        assert all(r.selected == (r.gumbel_key >= cut) for r in out) and sum(r.selected for r in out) == k
    assert not any(r.selected for r in Q.resample(docs, model, k=0).collect())


def test_kth_largest_with_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [3, 1, 1, 1, 2, -5, 1e300, -1e300]], "x double")
    s = sorted((r.x for r in df.collect()), reverse=True)
    assert [Q.kth_largest(df, "x", k) for k in range(1, 9)] == s and Q.kth_largest(df.limit(0), "x", 1) is None


def test_separates_labelled_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = Q.resample(docs, Q.fit(docs, labels)).join(labels, "doc_id")
    got = {(r.quality, r.selected): r.n for r in out.groupBy("quality", "selected").agg(F.count("*").alias("n")).collect()}
    assert got.get((1, False), 0) <= 0.005 * got[1, True] and got.get((0, True), 0) <= 0.1 * got[0, False], got


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 1), (None, "a", 1), (3, "x y " * 40_000, 1)], "doc_id long, text string, n_grams int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.resample(docs, Q.fit(docs, none)).collect()
    assert len(out) == 5 and all(r.selected and r.log_weight == 0 for r in out)
    assert Q.resample(docs.limit(0), Q.fit(docs.limit(0), none)).count() == 0
