"""MVCC reads: the newest version of each key at a sequence number, without tombstones.

Key and sequence predicates belong below the per-key arg-max and the tombstone test above it:
dropping tombstones first would bring deleted keys back. Spark picks the newest version of each key on
the map side already, so each key crosses the network at most once per task, however many versions it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from keytide.functions.keys import has_prefix, in_range, literal
from keytide.functions.schema import DELETE, PUT, KeyNotFound


def at(log: DataFrame, as_of: int | None = None, where: Column | None = None) -> DataFrame:
    """The versions a snapshot sees, before any choice among them."""
    log = log if as_of is None else log.filter(F.col("seq") <= F.lit(as_of))
    return log if where is None else log.filter(where)


def newest(log: DataFrame) -> DataFrame:
    """One row per key: its newest version, a put before a delete of the same sequence number.

    In batch a top-1 window, which Spark limits to one row per key in each task before the shuffle; on a
    stream, where windows of this kind don't exist, the same arg-max as an aggregate."""
    if log.isStreaming:
        rank = F.struct(F.col("seq"), (-F.col("op")).alias("p"))
        return log.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), rank).alias("v")).select("key", "v.seq", "v.op", "v.value")
    w = Window.partitionBy("key").orderBy(F.desc("seq"), "op")
    return log.select("key", "seq", "op", "value", F.row_number().over(w).alias("_nth")).filter(F.col("_nth") == 1).drop("_nth")


def visible(log: DataFrame, as_of: int | None = None, where: Column | None = None) -> DataFrame:
    return newest(at(log, as_of, where)).filter(F.col("op") == PUT).select("key", "seq", "value")


def scan_all(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return visible(log, as_of)


def scan_range(log: DataFrame, start=None, end=None, as_of: int | None = None) -> DataFrame:
    """Live keys in [start, end); None leaves a side open."""
    return visible(log, as_of, in_range(start, end))


def scan_prefix(log: DataFrame, prefix, as_of: int | None = None) -> DataFrame:
    return visible(log, as_of, has_prefix(prefix))


def ordered(view: DataFrame) -> DataFrame:
    """Iteration order; a range-partitioned global sort."""
    return view.orderBy("key")


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """0 or 1 row. A top-1 over the key's versions: each task sends one row, no shuffle."""
    found = at(log, as_of, F.col("key") == literal(key)).orderBy(F.desc("seq"), "op").limit(1)
    return found.filter(F.col("op") == PUT).select("key", "seq", "value")


def get_value(log: DataFrame, key, as_of: int | None = None):
    row = get(log, key, as_of).first()
    if row is None:
        raise KeyNotFound(key)
    return row["value"]


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """Live rows of a table of keys; duplicates in ``keys`` don't multiply rows."""
    return visible(at(log, as_of).join(keys.select("key"), "key", "left_semi"))


def history(log: DataFrame, where: Column | None = None, as_of: int | None = None) -> DataFrame:
    """Every version, newest first within a key; exact duplicates collapse."""
    return collapse_exact(at(log, as_of, where)).select("key", "seq", "op", "value").orderBy("key", F.desc("seq"), "op")


def collapse_exact(log: DataFrame) -> DataFrame:
    """One row for each (key, seq, op)."""
    return log.dropDuplicates(["key", "seq", "op"])


def merge_runs(*runs: DataFrame, dedup: bool = True) -> DataFrame:
    """The union of sorted runs; with ``dedup`` only the newest version of a key stays."""
    log = reduce(lambda a, b: a.unionByName(b), runs)
    return newest(log) if dedup else collapse_exact(log)


def tombstones(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return newest(at(log, as_of)).filter(F.col("op") == DELETE).select("key", "seq")


def head_seq(log: DataFrame) -> DataFrame:
    """What a snapshot taken now reads up to: 0 on an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("read_seq"))


def changes(log: DataFrame, old: int, new: int) -> DataFrame:
    """Keys whose visible value differs between two snapshots: added, removed or changed."""
    a = visible(log, old).select("key", F.col("seq").alias("old_seq"), F.col("value").alias("old_value"))
    b = visible(log, new).select("key", F.col("seq").alias("new_seq"), F.col("value").alias("new_value"))
    kind = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").otherwise("changed")
    return a.join(b, "key", "full_outer").filter(~F.col("old_seq").eqNullSafe(F.col("new_seq"))).select("key", "old_seq", "new_seq", kind.alias("change"))


def top_versioned(log: DataFrame, k: int) -> DataFrame:
    """The ``k`` keys with the most versions, by key on a tie."""
    return log.groupBy("key").agg(F.count("*").alias("n_versions")).orderBy(F.desc("n_versions"), "key").limit(k)


def prefix_counts(log: DataFrame, length: int, as_of: int | None = None) -> DataFrame:
    """For each prefix of ``length`` of the live keys: how many there are, and the newest number among them."""
    return visible(log, as_of).groupBy(F.substring("key", 1, length).alias("prefix")).agg(F.count("*").alias("n_keys"), F.max("seq").alias("newest_seq"))
