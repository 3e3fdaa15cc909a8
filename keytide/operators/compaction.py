"""Compaction as relational algebra, and the choice of what to compact."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from keytide.functions.schema import DELETE, N_LEVELS, PUT
from keytide.operators.readview import collapse_exact, newest

UNKNOWN_SIZE = 2 << 20


def survivors(log: DataFrame, oldest: int, bottom: bool = True) -> DataFrame:
    """The rows a compaction keeps. With ``bottom`` (nothing older lies outside the input), a
    tombstone that no snapshot below ``oldest`` needs goes with all that it hides.

    The newest collectable tombstone of a key is one small aggregate, joined back: rows of keys
    without one are not sorted or gathered by key as a window would."""
    log = collapse_exact(log)
    if not bottom:
        return log
    gc = log.filter((F.col("op") == DELETE) & (F.col("seq") <= oldest)).groupBy("key").agg(F.max("seq").alias("gc"))
    keep = F.col("gc").isNull() | (F.col("seq") > F.col("gc")) | ((F.col("seq") == F.col("gc")) & (F.col("op") == PUT))
    return log.join(gc, "key", "left").filter(keep).select(*log.columns)


def latest_only(log: DataFrame) -> DataFrame:
    """The opt-in compaction that gives up history: the newest live version of each key."""
    return newest(log).filter(F.col("op") == PUT)


def file_stats(log: DataFrame, file_col: str = "file_num", *more: Column) -> DataFrame:
    return log.groupBy(file_col).agg(
        F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"), F.count("*").alias("n_entries"), *more
    )


# what the log says about files is metadata on the driver: some hundred bytes for each data file


def level_scores(files: Iterable, l0_trigger: int = 4, l1_max_bytes: int = 64 << 20) -> list[tuple[int, int, int, float]]:
    """(level, files, bytes, score) by level: file count over the trigger at level 0, bytes over a
    limit that doubles with each level below; the last level is never compacted."""
    per: dict[int, tuple[int, int]] = {}
    for f in files:
        n, size = per.get(f.level, (0, 0))
        per[f.level] = n + 1, size + (f.file_size or UNKNOWN_SIZE)
    return [(k, n, size, n / l0_trigger if k == 0 else size / (l1_max_bytes * 2.0 ** (k - 1))) for k, (n, size) in sorted(per.items()) if k < N_LEVELS - 1]


def pick_compaction(files: Iterable, **limits) -> tuple[int, float] | None:
    """The level with the highest score of at least 1, the lower one on a tie, and its score."""
    due = [(-score, level) for level, _, _, score in level_scores(files, **limits) if score >= 1]
    return (min(due)[1], -min(due)[0]) if due else None


def overlapping(files: Iterable, level: int, smallest, largest) -> list:
    """Files of a level whose closed key interval meets [smallest, largest], by user key."""
    return [f for f in files if f.level == level and f.smallest_key <= largest and f.largest_key >= smallest]


def live_files(actions: Iterable[dict]) -> tuple[dict, set]:
    """(the last add of each live file, files removed and not forgotten) of actions in the order of their versions."""
    live: dict = {}
    gone: set = set()
    for a in actions:
        if a["action"] == "add":
            live[a["file"]] = a
            gone.discard(a["file"])
        elif a["action"] == "remove":
            live.pop(a["file"], None)
            gone.add(a["file"])
        elif a["action"] == "forget":
            gone -= set(a["files"])
    return live, gone


def replay(log: DataFrame, cutoff: int, batch_col: str = "batch") -> DataFrame:
    """Rows of the batches that reach past the cutoff, as recovery applies them."""
    after = log.groupBy(batch_col).agg(F.max("seq").alias("last")).filter(F.col("last") > cutoff)
    return log.join(after.select(batch_col), batch_col, "left_semi")


def dense_seqs(rows: DataFrame, base: int) -> DataFrame:
    """Sequence numbers base, base+1, ... in the order of (``_p``, ``_i``), where ``_i`` numbers the
    rows of part ``_p`` from 0. The parts' offsets are a prefix sum over one row per part."""
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_off", F.coalesce(F.sum("n").over(w), F.lit(0))).select("_p", "_off")
    return rows.join(parts, "_p").withColumn("seq", F.lit(base) + F.col("_off") + F.col("_i")).drop("_p", "_i", "_off")
