"""Near-duplicate embeddings by collision-counting projections.

A vector is scaled to length 1 and projected on ``M`` random directions. Two vectors collide in a
projection if one's value lies in the window of half-width ``WINDOW`` around the other's. At cosine 0.98 the
difference is normal with deviation 0.2, so a pair at the threshold collides in a projection with a known
probability, and the number of its collisions is binomial: pairs with fewer than ``calibrated(...)``
collisions are dropped, first by the windows of ``FIRST`` projections, then by those of all (together at most a 1e-4 share of
true pairs), the others are verified by cosine in double precision.

Windows are scanned in cells instead of over a whole label: in each of L tables, the signs of ``bits`` further
projections make a cell. L follows from ``bits`` so that a pair at the threshold shares a cell with
probability 0.998; ``bits`` follows from the number of vectors of the largest label, so the work grows a
little faster than the input. In a cell, the vectors are sorted by each projection in turn and each vector's
window is cut out by binary search. A pair that shares cells in several tables is counted in the first one,
which both vectors' keys tell. Cells of more than ``TILE`` vectors are dealt out as pairs of
blocks of that size, so no task holds a cell, and no row stands for a pair: a task returns for each
vector its number of links and for each block a spanning forest of them.

Equal vectors of a label are one class with a count. Vectors that are null, zero, or hold null or
non-finite components, and vectors without a label, are linked with nothing. Lengths that differ never match.
Rows that repeat an id count as different vectors; their links are added up under the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keytide.llm.common import cut, forget, join_counted, small_batches, table
from keytide.llm.graph import components, deal, spanning_forest
from keytide.llm.near_dups import mix

M, FIRST, WINDOW, TILE = 32, 12, 0.45, 1024
_OUT = "kind int, a long, b long, n long"


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def calibrated(cosine: float, miss: float = 5e-5, m: int = M) -> int:
    """The largest count of collisions in ``m`` projections that a pair at the threshold reaches with probability 1 - miss."""
    p = 2 * _phi(WINDOW / math.sqrt(2 - 2 * cosine)) - 1
    below = 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if below > miss:
            return k
    return m


def plan(n: int, cosine: float) -> tuple[int, int]:
    """(bits, tables) for n vectors in the largest label."""
    bits = max(4, min(30, round(math.log2(max(n, 2) / 128))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(0.002) / math.log1p(-same)))


@lru_cache(maxsize=64)
def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """Random normal directions, the same on every executor."""
    return np.random.Generator(np.random.Philox(key=seed + 1000 * dim)).standard_normal((count, dim)).T.copy()


def _vectors(lists: pa.ListArray) -> list[np.ndarray]:
    """Without copying through Python numbers."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def unit(vecs: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length in double precision, scaled to length 1; by the largest component first, so that no square overflows."""
    x = np.stack(vecs).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The signs of each row in each table as a number."""
    signs = (x @ directions(x.shape[1], bits * tables, seed) > 0).reshape(len(x), tables, bits)
    return signs @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))


def _keys(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """node, keys: a hash of table, label, length and signs, for each table."""
    for b in batches:
        vecs = _vectors(b.column("v"))
        label = b.column("label_key").to_numpy().view(np.uint64)
        keys = np.zeros((len(vecs), tables), np.uint64)
        lens = np.array([len(v) for v in vecs])
        for dim in np.unique(lens):
            at = np.flatnonzero(lens == dim)
            salt = mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
            keys[at] = mix(mix(cells(unit([vecs[i] for i in at]), bits, tables, seed).astype(np.uint64) ^ salt) + label[at][:, None])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * tables), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("node"), lists], names=["node", "keys"])


def collisions(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each row of p and of q, in how many projections q's value lies in the window around p's."""
    count = np.zeros((len(p), len(q)), np.int16)
    steps = np.zeros((len(p), len(q) + 1), np.int16)
    rows = np.arange(len(p))
    for m in range(p.shape[1]):
        order = np.argsort(q[:, m], kind="stable")
        s = q[order, m]
        steps[:] = 0
        lo, hi = np.searchsorted(s, p[:, m] - WINDOW, "left"), np.searchsorted(s, p[:, m] + WINDOW, "right")
        np.add.at(steps, (rows, lo), 1)
        np.subtract.at(steps, (rows, hi), 1)
        count[:, order] += np.cumsum(steps[:, :-1], axis=1, dtype=np.int16)
    return count


def counted(p: np.ndarray, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of p, row of q) that collide as often as it takes: in the windows of the first projections, then in all."""
    a, b = np.nonzero(collisions(p[:, :FIRST], q[:, :FIRST]) >= calibrated(cosine, m=FIRST))
    least, ok = calibrated(cosine), np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 16):
        part = slice(s, s + (1 << 16))
        ok[part] = (np.abs(p[a[part]] - q[b[part]]) <= WINDOW).sum(1) >= least
    return a[ok], b[ok]


class _Tile:
    """The rows of one pair of blocks of a cell."""

    def __init__(self, t: int, whole: bool):
        self.t, self.whole = t, whole
        self.node: list[int] = []
        self.n: list[int] = []
        self.v: list[np.ndarray] = []
        self.side: list[int] = []

    def compare(self, cosine: float, bits: int, tables: int, seed: int, links: dict, edges: list) -> None:
        node, mass, side = np.array(self.node), np.array(self.n), np.array(self.side)
        left = np.arange(len(node)) if self.whole else np.flatnonzero(side == 0)
        right = left if self.whole else np.flatnonzero(side == 1)
        if len(node) < 2 or not len(left) or not len(right):
            return
        x = unit(self.v)
        proj = x @ directions(x.shape[1], M, seed + 1)
        first, second = counted(proj[left], proj[right], cosine)
        if self.whole:
            once = first < second
            first, second = first[once], second[once]
        first, second = left[first], right[second]
        seen = cells(x, bits, tables, seed)[:, : self.t] if len(first) else None
        for s in range(0, len(first), 1 << 16):
            a, b = first[s : s + (1 << 16)], second[s : s + (1 << 16)]
            ok = (np.einsum("ij,ij->i", x[a], x[b]) >= cosine) & ~(seen[a] == seen[b]).any(1)
            a, b = a[ok], b[ok]
            if len(a):
                got = np.bincount(a, weights=mass[b], minlength=len(node)) + np.bincount(b, weights=mass[a], minlength=len(node))
                for i in np.flatnonzero(got):
                    links[int(node[i])] = links.get(int(node[i]), 0) + int(got[i])
                edges += spanning_forest(node[a], node[b])


def _tiles(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile. kind 0: a has n more links; kind 1: a and b are linked."""
    now, tile = None, None
    links: dict[int, int] = {}
    edges: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        rows = [(0, a, a, n) for a, n in links.items()] + [(1, a, b, 0) for a, b in edges]
        links.clear(), edges.clear()
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["kind", "a", "b", "n"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", "t", "side", "node", "n")]
        for key, i, j, t, side, node, n, v in zip(*cols, _vectors(batch.column("v")), strict=True):
            if (key, i, j) != now:
                if tile:
                    tile.compare(links=links, edges=edges, **how)
                now, tile = (key, i, j), _Tile(t, i == j)
            tile.node.append(node), tile.n.append(n), tile.v.append(v), tile.side.append(side)
        if len(links) + len(edges) > 50_000:
            yield flush()
    if tile:
        tile.compare(links=links, edges=edges, **how)
    yield flush()


def near_vectors(vectors: DataFrame, *, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 0) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    size = F.array_max(F.transform("v", F.abs))
    bad = F.col("label").isNull() | F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (size == 0)
    rows = rows.withColumn("class", F.when(~F.coalesce(bad, F.lit(True)), F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))))
    rows = cut(rows)
    classes = rows.filter("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("rep_id"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("label_key", F.xxhash64("label")))

    most = classes.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    bits, tables = plan(most, cosine)
    keyed = cut(classes.select("node", "v", "label_key").mapInArrow(partial(_keys, bits=bits, tables=tables, seed=seed), "node long, keys array<long>"))
    placed = keyed.select("node", F.posexplode("keys").alias("t", "key"))
    blocks = placed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key", F.ceil(F.col("c") / TILE).cast("int").alias("blocks"))
    dealt = deal(placed.join(blocks, "key"), "node", "t")
    tiles = dealt.join(classes.select("node", "n", "v"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = cut(tiles.mapInArrow(partial(_tiles, cosine=cosine, bits=bits, tables=tables, seed=seed), _OUT))

    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("kind = 1").select("a", "b"))
    named = classes.select("class", "node", "n", "rep_id").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("rep_id").alias("component_id"))
    by_class = cut(named.join(firsts, "root").select("class", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    good = join_counted(rows.filter("class is not null").select("id", "class"), by_class, "class", "n").select("id", "n_links", "component_id")
    alone = rows.filter("class is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    forget(keyed)
    return good.unionByName(alone).select(F.col("id").alias(vec_id), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


#: All pairs, which the operator doesn't compare; on the test tables it finds every link.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 r(vec_id, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.x, r.m FROM l JOIN r ON r.vec_id = l.y),
 c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
 n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
 SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
