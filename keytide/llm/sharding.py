"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in the order of a seeded hash; rank r of n rows has the fraction
(r + 1/2) / n. All rows are put in the order of their fractions and cut into shards of equal row counts (one
apart at most), so each shard, and each stretch of it, has the mixture of the whole.

Both rankings are made without a sort over all rows or over a source: hashes and fractions are uniform, so
equal-width buckets, as many for each source as its rows need, hold about ``per_bucket`` rows whatever the sizes of the sources. A
rank is the prefix sum of the counts of the buckets before (a table of at most N / per_bucket rows and one for each source), plus
the rank inside the bucket. Only ids, sizes and checksums are shuffled; texts stay where they are until shards are written.

A null source is a stratum of its own; null texts count as empty. Rows that repeat id and text are spread
by their place in the input; the order of all others depends on nothing but the rows and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keytide.llm.common import cut, forget, join_counted, row_key, table


def _rank_in_buckets(rows: DataFrame, by: list[str], bucket: str, order: list, into: str) -> DataFrame:
    """The rank from 0 of each row within ``by``, in the order of its bucket and then of ``order``."""
    counts = rows.groupBy(*by, bucket).agg(F.count("*").alias("_n"))
    # blocks of buckets first, so that no window holds all buckets of a large table
    blocks = counts.withColumn("_block", F.floor(F.col(bucket) / 4096))
    sums = blocks.groupBy(*by, "_block").agg(F.sum("_n").alias("_all"))
    to_block = F.coalesce(F.sum("_all").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_block = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select(*by, "_block", to_block.alias("_b"))
    starts = blocks.withColumn("_i", in_block).join(before, [*by, "_block"]).select(*by, bucket, (F.col("_b") + F.col("_i")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)) - 1
    return rows.withColumn("_r", inside).join(starts, [*by, bucket]).withColumn(into, F.col("_start") + F.col("_r")).drop("_r", "_start", bucket)


def _both() -> Column:
    return F.struct(F.coalesce("id", F.lit(0)).alias("id"), "key")


def interleave(docs: DataFrame, shards: int, *, seed: int = 0, source: str = "source", doc_id: str = "doc_id", text: str = "text", per_bucket: int = 512, key: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size (UTF-8 bytes and 1), text_crc32, source, rank (in the
    whole order, from 0), shard, slot (place in the shard, from 0), row_key (``key``,
    by default a hash of the text: with the id, what tells rows apart)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    light = docs.select(
        F.col(doc_id).alias("id"), F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")).alias("s"),
        (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), (row_key(F.col(text)) if key is None else key).alias("key"),
    )
    light = cut(light.withColumn("tie", F.monotonically_increasing_id()))
    # rows alike in id and text would share a hash, and many of them a bucket: their place in the input spreads them
    alike = cut(light.groupBy(_both().alias("both")).agg(F.count("*").alias("c")).filter("c > 1").withColumn("many", F.lit(True)))
    hash_ = F.xxhash64(F.coalesce("id", F.lit(0)), "key", F.lit(seed))
    if alike.isEmpty():
        light_h = light.withColumn("hash", hash_)
    else:
        marked = join_counted(light.withColumn("both", _both()), alike, "both", "c", "left")
        light_h = marked.withColumn("hash", F.when(F.col("many").isNull(), hash_).otherwise(F.xxhash64("id", "key", F.lit(seed), "tie"))).drop("both", "many")
    sources = cut(light.groupBy("s").agg(F.count("*").alias("of")).withColumn("rows", F.col("of")))
    n = sources.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]
    if n == 0:
        return light.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), "s.name", F.lit(0).cast("long").alias("rank"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.col("key").alias("row_key")).withColumnRenamed("name", source)
    buckets = -(-n // per_bucket)
    # the hash's own order: bucket and rank inside it agree
    own = join_counted(light_h, sources, "s", "rows")
    bucketed = own.withColumn("_hb", F.floor((F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))) * F.ceil(F.col("of") / per_bucket)))
    ranked = _rank_in_buckets(bucketed, ["s"], "_hb", [F.shiftrightunsigned("hash", 11), "hash", "tie"], "r")
    fraction = ranked.withColumn("fraction", (F.col("r") + 0.5) / F.col("of")).withColumn("one", F.lit(1))
    placed = fraction.withColumn("_fb", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    order = cut(_rank_in_buckets(placed, ["one"], "_fb", ["fraction", "s", "r"], "rank"))
    forget(light, alike, sources)
    # the first rank of shard k is ceil(k n / shards)
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    out = order.withColumn("shard", F.expr(f"cast((rank * {shards}L) div {n}L as int)")).withColumn("slot", F.col("rank") - first)
    return out.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.when(~F.col("s.none"), F.col("s.name")).alias(source), "rank", "shard", "slot", F.col("key").alias("row_key"))


def write_shards(docs: DataFrame, path: str, shards: int, *, doc_id: str = "doc_id", text: str = "text", files: int = 16, **options) -> DataFrame:
    """Write ``docs`` as folders shard=0, 1, ..., each in slot order over ``files`` files of consecutive slots, and
    return the placement. Rows alike in all columns are interchangeable: one of them is joined with all their places,
    so however many they are, they meet in no task. Columns shard and slot of ``docs`` give way to the new ones."""
    docs = docs.drop("shard", "slot")
    key = F.xxhash64(*docs.columns)
    at = interleave(docs, shards, doc_id=doc_id, text=text, key=key, **options)
    per = at.groupBy("shard").agg(F.count("*").alias("per"))
    place = at.join(F.broadcast(per), "shard").select(F.col(doc_id).alias("_id"), F.col("row_key").alias("_key"), "shard", "slot", F.floor(F.col("slot") * files / F.col("per")).alias("_file"))
    one = docs.withColumn("_key2", key).dropDuplicates([doc_id, "_key2"])
    rows = place.join(one, F.col("_id").eqNullSafe(F.col(doc_id)) & (F.col("_key") == F.col("_key2"))).select(*docs.columns, "shard", "slot", "_file")
    rows.repartition(shards * files, "shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
    return at


def query(spark, sf: str) -> DataFrame:
    at = interleave(table(spark, sf, "documents"), 8)
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


SIZES_SQL = "SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, source FROM documents"
SHARDS_SQL = """WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT shard, (shard * n + 7) // 8 AS a, ((shard + 1) * n + 7) // 8 AS b FROM n, (SELECT unnest(range(8)) AS shard))
 SELECT CAST(shard AS INTEGER) AS shard, 'rows' AS law, b - a AS n_rows, CAST(0 AS BIGINT) AS first_slot, b - a - 1 AS last_slot, b - a AS n_slots FROM k WHERE b > a"""
