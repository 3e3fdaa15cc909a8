"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch. Each distinct shingle is placed into one of ``T`` coordinates by a hash of the round, with a
value that is smaller the earlier the round, until every coordinate of the document is filled; after T
rounds each further round fills one coordinate from all shingles, so all are filled at the latest then.
Two sketches agree in a coordinate with the probability of the sets' Jaccard similarity, with minwise
concentration. ``BANDS`` bands of ``ROWS`` coordinates are hashed to keys; a pair at similarity 0.8 shares
none with probability (1 - 0.8^5)^32 = 3e-6.

Classes. Documents with equal sets are one class from the start, so copies cost one aggregate row.

Verification without pair rows. In each bucket, every class is compared with the bucket's smallest class, and what is
linked makes components. A bucket that still holds several components is compared as a whole, in two steps that deal its members
to tiles of two blocks, so no task holds a bucket. First by sketches: a block has about ``SKETCH_TILE`` members of a byte for
each coordinate, and a member goes on if it agrees with one of another component in ``AGREE`` coordinates, unless the two met in an
earlier band. Then those left, by full sets: a block has at most about ``TILE`` members and ``TILE_SHINGLES`` shingles; the sizes
of all intersections are one product of incidence matrices, and only a spanning forest of the links between
different components leaves the tile. No bucket has a cap. Sketches only ever rule pairs out: at similarity 0.8 fewer than
``AGREE`` of T coordinates agree with probability 1e-6 (see ``agreement``); every link is decided on full sets.

A document without words has an empty set, is linked with nothing and stays. Null texts are empty.
Rows that repeat an id with equal texts get equal results. A null id
counts as the id of a component only if there is no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from keytide.llm.common import chunks, cut, forget, join_counted, row_key, small_batches, table
from keytide.llm.graph import components, deal, spanning_forest

T, BANDS, ROWS = 160, 32, 5
TILE, TILE_SHINGLES, SKETCH_TILE = 1024, 1_500_000, 4096
_U = np.uint64
_EMPTY = ~_U(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def agreement(percent: int, miss: float = 1e-6) -> int:
    """The largest number of coordinates in which a pair at the threshold agrees with probability 1 - miss."""
    p, below = percent / 100, 0.0
    for k in range(T + 1):
        below += math.comb(T, k) * p**k * (1 - p) ** (T - k)
        if below > miss:
            return k
    return T


_SEEDS = mix(np.arange(1, 2 * T + 64, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = WordHashes()


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of the whole sequence if it is
    shorter. Words are split at ASCII white space and lower-cased in A-Z."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    out = []
    for w in words:
        h = np.fromiter(map(_hash_of.__getitem__, w), np.uint64, len(w))
        if len(h) == 0:
            out.append(h)
            continue
        n = max(1, len(h) - k + 1)
        s = np.full(n, _SEEDS[min(k, len(h))], np.uint64)
        for j in range(min(k, len(h))):
            s = mix(s * _U(0x9E3779B97F4A7C15) + h[j : j + n])
        out.append(np.unique(s))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T values for each set; an empty set has none that are filled."""
    n = len(sets)
    out = np.full(n * T, _EMPTY, np.uint64)
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * T):
        if not len(x):
            break
        h = mix(x ^ _SEEDS[i])
        place = ((h >> _U(40)) % _U(T)).astype(np.int64) if i < T else i - T
        np.minimum.at(out, doc * T + place, (_U(i) << _U(40)) | (h & _U((1 << 40) - 1)))
        open_ = (out.reshape(n, T) == _EMPTY).any(1)[doc]
        x, doc = x[open_], doc[open_]
    return out.reshape(n, T)


def band_keys(sk: np.ndarray) -> np.ndarray:
    bands = sk.reshape(len(sk), BANDS, ROWS)
    key = np.broadcast_to(_SEEDS[:BANDS], (len(sk), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + bands[:, :, j])
    return key.view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _fingerprint(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for at in chunks(texts):
            sets = shingle_sets(texts[at], k)
            sk = sketches(sets)
            keys = band_keys(sk)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id")[at],
                    b.column("h")[at],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    lists([k_ if len(s) else k_[:0] for k_, s in zip(keys, sets, strict=True)]),
                    pa.array([x.tobytes() for x in sk.astype(np.uint8)], pa.binary()),
                ],
                names=["id", "h", "n", "digest", "keys", "bytes"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for at in chunks(texts):
            yield pa.RecordBatch.from_arrays([b.column("node")[at], lists(shingle_sets(texts[at], k))], names=["node", "shingles"])


def _sketch(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, T)


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches x and y agree in ``least`` coordinates."""
    for batch in batches:
        same = (_sketch(batch.column("x")) == _sketch(batch.column("y"))).sum(1) >= least
        yield batch.select(["a", "b"]).filter(pa.array(same))


def _verify(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, of distinct pairs."""
    of = classes.select("node", "bytes")
    drawn = pairs.join(of.select(F.col("node").alias("a"), F.col("bytes").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("bytes").alias("y")), "b")
    near = drawn.select("a", "b", "x", "y").mapInArrow(partial(_alike, least=agreement(percent)), "a long, b long")
    one = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = two.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.filter(100 * F.col("i").cast("long") >= percent * (F.col("total") - F.col("i"))).select("a", "b")


def _split(inside: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component."""
    c = inside.join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    several = c.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).filter("lo != hi").select("key", "rows")
    return join_counted(c, cut(several), "key", "rows")


def _blocks(members: DataFrame, most: Column) -> DataFrame:
    """``members`` with the number of blocks of their bucket, ``most`` of it."""
    return join_counted(members, cut(members.groupBy("key").agg(F.ceil(most).cast("int").alias("blocks"), F.count("*").alias("rows"))), "key", "rows")


def _tiles_of(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], big: str) -> Iterator[list[tuple]]:
    """Tiles, one after the other, of rows that come sorted by key, i, j: (i, j, *columns, item of ``big``)."""
    now, tile = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", *columns)]
        items = batch.column(big)
        if pa.types.is_list(items.type):
            flat, ends = items.values.to_numpy(zero_copy_only=False).view(np.uint64), items.offsets.to_numpy()
            items = [flat[a:b].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        else:
            items = items.to_pylist()
        for key, i, j, *rest, item in zip(*cols, items, strict=True):
            if (key, i, j) != now:
                if tile:
                    yield tile
                now, tile = (key, i, j), []
            tile.append((i, j, *rest, item))
    if tile:
        yield tile


def met_by(sk: np.ndarray, comp: np.ndarray, keys: np.ndarray, band: int, side: np.ndarray, whole: bool, least: int) -> np.ndarray:
    """Which members of a tile agree in ``least`` coordinates with one of another component and (unless ``whole``) of the other
    side, where no earlier band has brought the two together."""
    met, n = np.zeros(len(sk), bool), len(sk)
    left = np.arange(n) if whole else np.flatnonzero(side == 0)
    right = np.arange(n) if whole else np.flatnonzero(side == 1)
    columns = np.ascontiguousarray(sk[right].T)
    for at in range(0, len(left), 256):
        x = left[at : at + 256]
        same = np.zeros((len(x), len(right)), np.uint8)
        for c in range(T):
            same += sk[x, c][:, None] == columns[c]
        may = (same >= least) & (comp[x][:, None] != comp[right]) & ~(met[x][:, None] & met[right])
        a, b = np.nonzero(may)
        for s in range(0, len(a), 1 << 15):
            p, q = x[a[s : s + (1 << 15)]], right[b[s : s + (1 << 15)]]
            first = ~(keys[p, :band] == keys[q, :band]).any(1)
            met[p[first]] = met[q[first]] = True
    return met


def _near_tiles(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """key, node: members of a bucket that may be linked with one of another component."""
    for tile in _tiles_of(batches, ("key", "t", "side", "comp", "node", "bytes"), "keys"):
        i, j, key, band, side, comp, node, sk, keys = (list(c) for c in zip(*tile, strict=True))
        met = met_by(np.frombuffer(b"".join(sk), np.uint8).reshape(-1, T), np.array(comp), np.stack(keys), band[0], np.array(side), i[0] == j[0], least)
        got = np.array(node, np.int64)[met]
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(got), pa.int64()), pa.array(got)], names=["key", "node"])


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of the intersections of all pairs of sorted distinct arrays, by products of 0/1 matrices over a
    few thousand shared shingles at a time."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    which = np.cumsum(first) - 1
    times = np.bincount(which)
    shared = times[which] > 1
    row, which = row[shared], which[shared]
    col = np.cumsum(np.concatenate([[0], (which[1:] != which[:-1])])) if len(which) else which
    out = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [c, c + width])
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        out += np.rint(m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out


def _link_tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b: a spanning forest of the links between different components in each tile; rows come sorted by tile."""

    def links(tile: list[tuple]) -> list[tuple[int, int]]:
        whole = tile[0][0] == tile[0][1]
        left = tile if whole else [r for r in tile if r[2] == 0]
        right = tile if whole else [r for r in tile if r[2] == 1]
        if not left or not right:
            return []
        both = intersections([r[4] for r in left], [r[4] for r in right])
        size = np.add.outer([len(r[4]) for r in left], [len(r[4]) for r in right])
        ca, cb = np.array([r[3] for r in left]), np.array([r[3] for r in right])
        x, y = np.nonzero((100 * both >= percent * (size - both)) & (ca[:, None] != cb))
        pairs = np.unique(np.stack([np.minimum(ca[x], cb[y]), np.maximum(ca[x], cb[y])], 1), axis=0)
        return spanning_forest(pairs[:, 0], pairs[:, 1])

    for tile in _tiles_of(batches, ("side", "comp"), "shingles"):
        out = links(tile)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_dups(docs: DataFrame, *, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links of
    similarity >= percent / 100, itself included), kept (it is that id), class_id (of equal sets) and root_id (of the component's classes; both null
    without words), row_key."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(text)).alias("h"), F.col(text).alias("text"))
    prints = cut(src.mapInArrow(partial(_fingerprint, k=shingle), "id long, h long, n long, digest binary, keys array<long>, bytes binary"))
    first = F.min(F.struct("id", "h")).alias("rep")
    classes = prints.filter("n > 0").groupBy("digest").agg(first, F.min("id").alias("least"), F.first("n").alias("n"), F.first(F.struct("keys", "bytes")).alias("s"), F.count("*").alias("rows"))
    classes = cut(classes.select("digest", F.col("rep.id").alias("rep_id"), F.col("rep.h").alias("rep_h"), "least", "n", "rows", "s.keys", "s.bytes", F.monotonically_increasing_id().alias("node")))

    rows = classes.select(F.posexplode("keys").alias("t", "key"), "node", "n")
    heads = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("l1")).filter("c > 1").drop("c")
    inside = cut(rows.join(heads, "key"))
    wanted = inside.select("node").distinct().join(classes.select("node", F.col("rep_id").alias("id_"), F.col("rep_h").alias("h_")), "node")
    sets = cut(src.join(wanted, src["id"].eqNullSafe(F.col("id_")) & (src["h"] == F.col("h_"))).select("node", "text").mapInArrow(partial(_full_sets, k=shingle), "node long, shingles array<long>").dropDuplicates(["node"]))

    links = _verify(inside.filter("node != l1").select(F.col("l1").alias("a"), F.col("node").alias("b")).distinct(), classes, sets, percent)
    roots = components(links)
    rest = cut(_split(inside.select("key", "t", "node", "n"), roots))
    dealt = deal(_blocks(rest, F.count("*") / SKETCH_TILE), "node", "comp", "t").join(classes.select("node", "bytes", "keys"), "node")
    tiles = dealt.select("key", "i", "j", "t", "side", "comp", "node", "bytes", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = tiles.mapInArrow(partial(_near_tiles, least=agreement(percent)), "key long, node long").distinct()
    close = cut(rest.join(near, ["key", "node"]))
    dealt = deal(_blocks(close, F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)), "node", "comp").join(sets, "node")
    tiles = dealt.select("key", "i", "j", "side", "comp", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = cut(tiles.mapInArrow(partial(_link_tiles, percent=percent), "a long, b long"))
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)) if not more.isEmpty() else roots
    forget(sets, inside, rest, close)

    named = classes.select("digest", "least", "rows", "node").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = cut(named.join(least, "root").select("digest", "rows", F.col("node").alias("class_id"), F.col("root").alias("root_id"), "component_id"))
    empty = prints.filter("n = 0").select("id", "h", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("root_id"))
    out = join_counted(prints.filter("n > 0").select("id", "h", "n", "digest"), label, "digest", "rows").select("id", "h", "n", "component_id", "class_id", "root_id").unionByName(empty)
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id", "root_id", F.col("h").alias("row_key"))


def query(spark, sf: str) -> DataFrame:
    return near_dups(table(spark, sf, "documents"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS sh FROM d WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
 r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.x, r.m FROM l JOIN r ON r.doc_id = l.y),
 c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
