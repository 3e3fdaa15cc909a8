"""Extra columns named like everything the operators use inside change no result."""

import random

import pytest
from pyspark.sql import functions as F

from keytide.llm import chat, decontaminate, licenses, near_dups, packing, quality, sharding, token_counts, toxicity, vectors

HELPERS = """id h v n w x y b m r s k t p i j a at by of key keys node comp root tie crc norm part rank rule rows row both many hash
fraction one gates found label win tok place len start stop spans items copies c e size cell class links least piece length ids before
starts bytes digest rep step path turns all score name source_ p_ l_ id_ h_ _n _r _i _b _hb _fb _block _copy _start _all one_""".split()
BITS = ["the mit license", "idiot", "copy of a text that is long enough to be shingled by five words", "GPL v3", "x", "é 1", "\n", "window of the benchmark text here"]


def docs_of(spark, clash):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(BITS, k=rng.randrange(12))) if i % 9 else None, "en", rng.choice("ab"), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in HELPERS]) if clash else df


def labels_of(spark, clash):
    df = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    return df.select("*", *[F.lit("clash").alias(c) for c in HELPERS]) if clash else df


def items_of(spark, clash):
    df = spark.createDataFrame([(1, "window of the benchmark text here"), (2, "x x")], "item_id long, text string")
    return df.select("*", *[F.lit("clash").alias(c) for c in HELPERS]) if clash else df


def turns_of(spark, clash):
    df = spark.createDataFrame([(i // 3, i % 3, ["user", "assistant"][i % 2], BITS[i % 4]) for i in range(60)], "conv_id long, turn long, role string, text string")
    return df.select("*", *[F.lit("clash").alias(c) for c in HELPERS if c != "turns"]) if clash else df


def vectors_of(spark, clash):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, 2.0], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit("clash").alias(c) for c in HELPERS if c != "label"]) if clash else df


RUNS = {
    "tokens": lambda s, c: token_counts.count_tokens(docs_of(s, c)).select("doc_id", "tokens"),
    "decontaminate": lambda s, c: decontaminate.decontaminate(docs_of(s, c), items_of(s, c), width=5),
    "toxicity": lambda s, c: toxicity.score(docs_of(s, c), toxicity.fit(docs_of(s, c), labels_of(s, c))).select("doc_id", "toxicity"),
    "near_dups": lambda s, c: near_dups.near_dups(docs_of(s, c)).select("doc_id", "n_shingles", "component_id", "kept"),
    "sharding": lambda s, c: sharding.interleave(docs_of(s, c), 4),
    "licenses": lambda s, c: licenses.scan_licenses(docs_of(s, c)),
    "quality": lambda s, c: quality.resample(docs_of(s, c), quality.fit(docs_of(s, c), labels_of(s, c))),
    "vectors": lambda s, c: vectors.near_vectors(vectors_of(s, c)),
    "packing": lambda s, c: packing.pack(docs_of(s, c), capacity=32).select("doc_id", "piece", "start", "length", "ids"),
    "chat": lambda s, c: chat.digests(chat.format_tree(turns_of(s, c))),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_same_result(spark, name):
    got, want = (sorted(map(repr, RUNS[name](spark, c).collect())) for c in (True, False))
    assert got == want and want
