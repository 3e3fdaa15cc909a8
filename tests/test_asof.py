import random

from keytide.operators.asof import as_of_join

LOG = "key string, seq long, op int, value string"


def brute(probes, log):
    out = []
    for key, seq, n in probes:
        seen = [(s, -op, v) for k, s, op, v in log if k == key and key is not None and seq is not None and s <= seq]
        s, op, v = max(seen, key=lambda x: x[:2], default=(None, -2, None))
        out.append((key, seq, n, *((s, v) if op == -1 else (None, None))))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(0)
    keys = ["a"] * 5 + ["b", "c", "d"]
    log = [(rng.choice(keys), s, rng.choice([1, 1, 2]), f"v{s}") for s in rng.sample(range(1, 3000), 400)]
    log = [(k, s, op, v if op == 1 else None) for k, s, op, v in log]
    log += [(k, s, 3 - op, "tie" if op == 2 else None) for k, s, op, _ in log[:20]]
    probes = [(rng.choice([*keys, "never"]), rng.randrange(0, 3200), i) for i in range(500)] + [(None, 5, 1), ("a", None, 2)]
    probes += probes[:5]
    for block in (3, 16, 4096):
        got = as_of_join(spark.createDataFrame(probes, "key string, seq long, v int").repartition(3), spark.createDataFrame(log, LOG), block).collect()
        assert sorted(map(tuple, got), key=repr) == brute(probes, log)


def test_empty_sides(spark):
    probes, log = spark.createDataFrame([("a", 1)], "key string, seq long"), spark.createDataFrame([], LOG)
    assert [tuple(r) for r in as_of_join(probes, log).collect()] == [("a", 1, None, None)]
    assert as_of_join(probes.limit(0), log).count() == 0
