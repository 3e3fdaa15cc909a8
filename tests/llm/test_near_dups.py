import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keytide.llm import near_dups as N
from keytide.llm.common import join_counted

SCHEMA = "doc_id long, text string, node string, n int, h string"


def sets_of(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    sets = [sets_of(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows, k):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in N.near_dups(df, shingle=k).select("doc_id", "n_shingles", "component_id", "kept").collect())


def edited(rng, words, p):
    return [f"w{rng.randrange(10**6)}" if rng.random() < p else w for w in words]


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(3, None), (1, ""), (2, " \t\n"), (9, "one"), (8, "One"), (7, "a b c"), (6, "A B\fC"), (5, "a b"), (4, "x " * 5000), (14, "X " * 6000), (10, "é É"), (11, "É é"), (12, "a b")]
    for g in range(12):
        base = [f"b{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 200]))]
        for _ in range(rng.randrange(2, 14)):
            rows.append((100 + len(rows) * 7 % 1000, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.1])))))
    rows += rows[20:23]
    rng.shuffle(rows)
    assert run(spark, rows, k) == brute(rows, k)


def test_large_group_of_near_copies(spark):
    """Copies of one text with edits: many pairs fall on either side of the threshold."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.04, 0.06, 0.08])))) for i in range(250)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_sketch_is_filled_and_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for n in (1, 7, 200, 2000):
        a, b = np.unique(pool[:n]), np.unique(pool[n // 4 : n // 4 + n])
        sk = N.sketches([a, b])
        assert (sk != N._EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sk[0] == sk[1]).mean() - true) < 0.17
    assert (N.sketches([pool[:0]]) == N._EMPTY).all()


def test_empty_table(spark):
    assert run(spark, [], 4) == []


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 200)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]
    assert (N.intersections(sets[:12], sets[12:], width=64) == want).all()
    assert (N.intersections([sets[0]], [sets[0][:0]]) == 0).all()


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 16)
    monkeypatch.setattr(N, "SKETCH_TILE", 40)
    test_large_group_of_near_copies(spark)


def test_members_met_in_a_tile_against_brute_force():
    rng = np.random.default_rng(4)
    for whole in (True, False):
        n, least = 300, 100
        base = rng.integers(0, 256, N.T)
        sk = np.where(rng.random((n, N.T)) < rng.choice([0.1, 0.2, 0.3, 0.9], (n, 1)), rng.integers(0, 256, (n, N.T)), base).astype(np.uint8)
        comp, side, keys = rng.integers(0, 40, n), rng.integers(0, 2, n), rng.integers(0, 30, (n, N.BANDS)).astype(np.uint64)
        want = np.zeros(n, bool)
        for i in range(n):
            for j in range(n):
                if comp[i] != comp[j] and (whole or side[i] != side[j]) and (sk[i] == sk[j]).sum() >= least and not (keys[i, :5] == keys[j, :5]).any():
                    want[i] = True
        assert (N.met_by(sk, comp, keys, 5, side, whole, least) == want).all() and 0 < want.sum() < n


def test_sketches_rarely_rule_out_a_link():
    assert 100 <= N.agreement(80) < 0.8 * N.T and N.agreement(80, 0.5) == 128
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(200):
        x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        sets += [np.unique(x[:900]), np.unique(x[100:])]  # similarity 0.8
    sk = N.sketches(sets).astype(np.uint8)
    assert ((sk[::2] == sk[1::2]).sum(1) >= N.agreement(80)).all()


def test_rows_dealt_for_a_template_grow_in_proportion(spark, monkeypatch):
    """One text with 3 % edits: most pairs share a band and are below the threshold; full sets go only where sketches leave a doubt."""
    dealt = []

    def counted(members, node, *more):
        out = deal(members, node, *more)
        dealt.append((more, out.count()))
        return out

    deal = N.deal
    monkeypatch.setattr(N, "deal", counted)
    seen = []
    for n in (150, 600):
        rng = random.Random(n)
        base = [f"b{i}" for i in range(300)]
        rows = [(i, " ".join(edited(rng, base, 0.03))) for i in range(n)]
        dealt.clear()
        got = run(spark, rows, 4)
        assert len(got) == n
        seen.append((sum(c for m, c in dealt if "t" in m), sum(c for m, c in dealt if "t" not in m)))
    assert 0 < seen[1][0] <= 6 * seen[0][0] and seen[1][1] <= seen[1][0]


def test_hot_keys_are_joined_by_broadcast(spark):
    left = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(3000)] + [(None, 1)], "k int, v int")
    counts = left.groupBy("k").count().filter("k is not null and k != 5").withColumnRenamed("count", "c").withColumn("name", F.concat(F.lit("n"), "k"))
    for how in ("inner", "left"):
        want = sorted((tuple(r) for r in left.join(counts.drop("c"), "k", how).collect()), key=repr)
        assert sorted((tuple(r) for r in join_counted(left, counts, "k", "c", how, share=4).collect()), key=repr) == want


def test_null_ids(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (None, "q r s t u"), (None, "")]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in N.near_dups(df, shingle=4).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (None, 2, None, True), (None, 0, None, True)], key=repr)
