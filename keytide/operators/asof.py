"""As-of join: each probe with the version of its key that a snapshot at its sequence number sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from keytide.functions.schema import PUT


def as_of_join(probes: DataFrame, log: DataFrame, block: int = 4096) -> DataFrame:
    """``probes`` (key, seq and any other columns) with as_of_seq and as_of_value, null where the key is absent or deleted
    at that number. Every probe stays, repeated ones too; a null key or number meets no version.

    One pass over the union of both sides. Sequence numbers are cut into blocks and blocks into stretches of ``block``;
    the newest version before a block is carried into it, so no window holds more of a key than one block of numbers, one
    stretch of blocks, or its stretches, however many versions and probes the key has."""
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    version = F.struct("seq", "op", "value")
    kind = log.select(version.alias("v")).schema["v"].dataType.simpleString()
    both = probes.select("key", "seq", row.alias("row"), F.lit(None).cast(kind).alias("v")).unionByName(
        log.select("key", "seq", F.lit(None).cast(probes.select(row.alias("r")).schema["r"].dataType).alias("row"), version.alias("v"))
    )
    placed = both.withColumn("block", F.floor(F.col("seq") / block)).withColumn("stretch", F.floor(F.col("block") / block))
    newest = F.max_by("v", F.struct("seq", (-F.col("v.op")).alias("p"))).alias("newest")
    per_block = placed.filter("v is not null").groupBy("key", "stretch", "block").agg(newest)
    per_stretch = per_block.groupBy("key", "stretch").agg(F.max_by("newest", "block").alias("newest"))
    # blocks with probes but no versions take part, so that something is carried into them, too
    blocks = placed.select("key", "stretch", "block").distinct().join(per_block, ["key", "stretch", "block"], "left")
    stretches = blocks.select("key", "stretch").distinct().join(per_stretch, ["key", "stretch"], "left")
    before = lambda w: F.last("newest", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    from_stretch = stretches.select("key", "stretch", before(Window.partitionBy("key").orderBy("stretch")).alias("s"))
    from_block = blocks.select("key", "stretch", "block", before(Window.partitionBy("key", "stretch").orderBy("block")).alias("b"))
    carry = from_block.join(from_stretch, ["key", "stretch"]).select("key", "block", F.coalesce("b", "s").alias("carry"))
    inside = Window.partitionBy("key", "block").orderBy("seq", F.col("row").isNotNull(), F.desc("v.op")).rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.join(carry, ["key", "block"], "left").withColumn("at", F.coalesce(F.last("v", True).over(inside), F.col("carry")))
    live = F.col("at.op") == PUT
    return seen.filter("row is not null").select("row.*", F.when(live, F.col("at.seq")).alias("as_of_seq"), F.when(live, F.col("at.value")).alias("as_of_value"))
