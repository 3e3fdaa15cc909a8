import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from keytide.llm.sharding import interleave, write_shards

SCHEMA = "doc_id long, text string, source string, s int, hash string, rank int"


def make(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i if i % 50 else 7, None if i % 97 == 0 else "é" * rng.randrange(30) if i % 3 else "", rng.choice(["a"] * 6 + ["b", "c", None, ""]), 1, "x", 2) for i in range(n)]
    return rows, spark.createDataFrame(rows + rows[:9], SCHEMA).repartition(6)


def test_law_mixture_and_digests(spark):
    rows, df = make(spark, 3000)
    out = interleave(df, 8, per_bucket=100).collect()
    rows = rows + rows[:9]
    assert Counter((r.doc_id, r.size, r.text_crc32, r.source) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for d, t, s, *_ in rows)
    by = [sorted(r.slot for r in out if r.shard == k) for k in range(8)]
    assert all(x == list(range(len(x))) for x in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert sorted(r["rank"] for r in out) == list(range(len(rows)))
    all_of = Counter(r.source for r in out)
    for k in range(8):
        for s, n in Counter(r.source for r in out if r.shard == k).items():
            assert abs(n - all_of[s] / 8) <= 2


def test_brute_force_order(spark):
    df = make(spark, 500)[1].dropDuplicates(["doc_id", "text"]).coalesce(3)
    df = spark.createDataFrame(df.collect(), SCHEMA)
    out = interleave(df, 3, per_bucket=50, seed=4)
    again = {(r["rank"], r.doc_id, r.text_crc32) for r in interleave(df.repartition(2), 3, per_bucket=7, seed=4).collect()}
    assert again == {(r["rank"], r.doc_id, r.text_crc32) for r in out.collect()}
    got = out.orderBy("rank").collect()
    n = Counter(r.source for r in got)
    seen, fractions = Counter(), []
    for r in got:
        fractions.append((seen[r.source] + 0.5) / n[r.source])
        seen[r.source] += 1
    assert fractions == sorted(fractions)


def test_small_and_empty(spark):
    _, df = make(spark, 3)
    assert interleave(df.limit(0), 8).count() == 0
    assert sorted(r.slot for r in interleave(df.limit(5), 8).collect()) == [0] * 5


def test_write_shards(spark, tmp_path):
    rows, df = make(spark, 300)
    at = write_shards(df.drop("s", "hash", "rank"), str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == at.count() == 309
    key = lambda d: Counter((r.doc_id, r.text or "", r.shard) for r in d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "shard").collect())
    assert sum(key(back).values()) == 309
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((r.shard, r.slot) for r in at.collect())
