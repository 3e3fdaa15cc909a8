"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from keytide.llm import chat, decontaminate, licenses, near_dups, packing, quality, sharding, token_counts, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.query,
        "op2_decontaminate": decontaminate.query,
        "op3_toxicity": toxicity.query,
        "op4_near_dups": near_dups.query,
        "op5_sharding": sharding.query,
        "op6_licenses": licenses.query,
        "op7_quality": quality.query,
        "op8_near_vectors": vectors.query,
        "op9_packing": packing.query,
        "op10_chat": chat.query,
    } | side_queries()


#: The columns of three queries that SQL can express: shard sizes, places of phrases, turns read back.
SIDES = {
    "side_op5_sizes": sharding.SIZES_SQL,
    "side_op5_shards": sharding.SHARDS_SQL,
    "side_op6_base": licenses.BASE_SQL,
    "side_op10_turns": chat.TURNS_SQL,
}


def side_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(query, *columns):
        return lambda spark, sf: query(spark, sf).select(*columns)

    def shards(spark, sf):
        return sharding.query(spark, sf).groupBy("shard", "law").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"))

    return {
        "side_op5_sizes": of(sharding.query, "doc_id", "size", "source"),
        "side_op5_shards": shards,
        "side_op6_base": of(licenses.query, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
        "side_op10_turns": of(chat.query, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"),
    }


def oracle_sql() -> dict[str, str]:
    """The others hold learned models, tokenizers, checksums or rules that SQL can't express: tests hold them against brute force."""
    return {"op2_decontaminate": decontaminate.SQL, "op4_near_dups": near_dups.SQL, "op8_near_vectors": vectors.SQL} | SIDES
