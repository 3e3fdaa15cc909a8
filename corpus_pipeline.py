"""The corpus pipeline: toxicity, quality, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. Learned models come from the labels and the documents that a stage is
given; statistics of the corpus are those of the stage's own input.

toxicity: drops texts that score at least 0.7.
quality: draws k texts in proportion to their importance weights, without replacement (Gumbel top-k), k being the number of
    texts above the weight that best separates labelled good from bad.
near_dups: of each component of 5-word-shingle similarity >= 0.8, one row stays, which has the smallest id (a null
    one only if there is no other); texts without words stay. Unrelated texts under one id, or without an id, are
    different texts and all stay; rows that repeat both an id and a text stay once.
decontaminate: drops texts in which a 10-word window of a benchmark item occurs.
pack: pieces of at most 2048 tokens with their place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keytide.llm import decontaminate as _decontaminate, near_dups as _near_dups, packing, quality as _quality, toxicity as _toxicity
from keytide.llm.common import cut, row_key, table

#: SQL can't express the stages' models; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _only(docs: DataFrame, decided: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose id and text ``decided`` (doc_id, row_key) holds, or (left_anti) doesn't hold."""
    d = decided.select(F.col("doc_id").alias("_decided_id"), F.col("row_key").alias("_decided_key"))
    return docs.join(d, F.col("doc_id").eqNullSafe(F.col("_decided_id")) & (row_key(F.col("text")) == F.col("_decided_key")), how)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = _toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _toxicity.score(docs, model, into="_toxicity").filter(F.col("_toxicity.score") < 0.7).drop("_toxicity")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = _quality.fit(docs, table(spark, sf_dir, "labels"))
    return _quality.resample(docs, model, drawn=True)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = cut(_near_dups.near_dups(docs, shingle=5).filter("kept").select("doc_id", "row_key", "root_id"))
    rows = found.groupBy("root_id", "doc_id", "row_key").agg(F.count("*").alias("n"))
    first = rows.filter("root_id is not null").groupBy("root_id").agg(F.min(F.struct("doc_id", "row_key", "n")).alias("x")).select("x.*")
    # rows without an id and without words may be equal and yet of different texts
    bare = rows.filter("root_id is null").select("doc_id", "row_key", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("n")).alias("n"))
    once = cut(first.unionByName(bare))
    if once.filter("n > 1").isEmpty():
        return _only(docs, once)
    return _only(docs, once.filter("n = 1")).unionByName(_only(docs, once.filter("n > 1")).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hit = _decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    # written first: a few rows, which Spark can then send to where the texts are
    return _only(docs, cut(hit.filter("n_hit > 0").select("doc_id", "row_key").distinct()), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, carry={"ids_crc32": F.crc32("ids")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dups", near_dups), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
