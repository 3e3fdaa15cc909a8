import random

from keytide.llm.graph import components


def test_components_of_random_and_hard_graphs(spark):
    rng = random.Random(0)
    cases = [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(99, i) for i in range(80)], [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]]
    for edges in cases:
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            if a != b:
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
        want = {x: root(x) for x in up if root(x) != x}
        got = components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.root for r in got.collect()} == want
