import math

import numpy as np
import pytest

from keytide.llm import vectors as V
from keytide.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n int, key string"


def brute(rows, cosine=0.98):
    n = len(rows)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    x = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        u = np.array(v, np.float32).astype(float) if ok else None
        x.append(u / np.abs(u).max() / np.linalg.norm(u / np.abs(u).max()) if ok else None)
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine - 1e-15:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return sorted((r[0], links[i], least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in V.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1), (6, [], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0], 2), (12, [1.0, 2.0, 0.0], 1),
            (13, [1e-30, 2e-30], 1), (14, [1e30, 2e30], 1), (9, [1.0, 2.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_large_cell_is_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.25])).tolist(), 0) for i in range(260)]
    monkeypatch.setattr(V, "TILE", 64)
    got, want = run(spark, rows), brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    a, b = sum(g[1] for g in got), sum(w[1] for w in want)
    assert b * 0.98 <= a <= b and all(g[1] <= w[1] for g, w in zip(got, want))


def test_recall_on_the_test_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute(rows)
    got = sorted(tuple(r) for r in V.query(spark, "/root/testdata/sf0.01").collect())
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2:] == w[2:] for g, w in zip(got, want)) >= 0.99 * len(want)


def test_calibration():
    assert V.calibrated(0.98) >= 20
    bits, tables = V.plan(10**9, 0.98)
    assert 1 - (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables > 0.997


def test_counting_in_two_steps_loses_few_true_pairs():
    rng = np.random.default_rng(5)
    for dim in (8, 64):
        x = rng.standard_normal((400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        off = rng.standard_normal(x.shape)
        off -= (off * x).sum(1, keepdims=True) * x
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * off / np.linalg.norm(off, axis=1, keepdims=True)  # all at the threshold
        way = V.directions(dim, V.M, 1)
        a, b = V.counted(x @ way, y @ way, 0.98)
        assert (a == b).sum() >= 399 and len(a) < (0.3 * 400**2 if dim == 8 else 410)


def test_collisions_count_windows():
    rng = np.random.default_rng(0)
    p, q = rng.standard_normal((7, 5)), rng.standard_normal((9, 5))
    assert (V.collisions(p, q) == (np.abs(p[:, None] - q[None]) <= V.WINDOW).sum(-1)).all()
