"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces the edges of a vertex by edges to the smallest vertex around it, which keeps the
components and brings every vertex next to its smallest one in O(log n) rounds. A vertex of any degree is
one aggregate and one join with it, which Spark can split; nothing is gathered per vertex.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from keytide.llm.common import cut, forget


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = e.join(least, F.col("a") == F.col("u")).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge (a, b) but the roots."""
    e = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = _mark(e)
    while was[0]:
        new = cut(_small(_large(e)))
        forget(e)
        e, now = new, _mark(new)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def spanning_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given ones connect, fewer than there are nodes."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = root(x), root(y)
        if r != s:
            up[max(r, s)] = min(r, s)
            out.append((x, y))
    return out


def deal(members: DataFrame, node: str, *more: str) -> DataFrame:
    """Members of groups (key), each with its group's number of ``blocks``, dealt to all pairs of blocks of the group that
    theirs is in: key, i, j, side (0: in block i, 1: in block j), node and the columns in ``more``."""
    mine = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), node, *more)
