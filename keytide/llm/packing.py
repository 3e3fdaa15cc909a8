"""Best-fit packing of token sequences by bin completion.

A text's ids, closed by an end id, are cut into pieces of at most ``capacity`` (the first of a longer
text may be shorter). How well pieces can be packed depends on nothing but how many there are of each
length, a table of at most ``capacity`` rows however large the corpus; the driver solves that problem.

Bin completion: the longest piece left opens a sequence, which is completed by the filling of least waste, of those by
one with one or two added pieces if it is exact, else by that of the longest pieces, found in a table of the sums that the
remaining counts reach; so an exact fit of any number of pieces is found if there is one. A filling is used as often as the
counts allow. Depth-first search from there takes the other undominated fillings, which are enumerated one by one, by waste:
the choice of rank r costs r discrepancies, of which each pass allows one more than the last; each filling also once instead
of as often as the counts allow. The incumbent at the start is the best-fit-decreasing packing, and a branch is dropped when
its waste so far already implies as many sequences as the incumbent has. The search ends when the lower bound is met, which
proves an optimum, or after ``nodes`` fillings looked at, when the packing need not be optimal; or when no undominated
filling is left to try.

Placement is a lookup: pieces of one length are interchangeable, so the r-th piece of a length gets the
r-th place that the solution has for that length. A piece's number within its length is a count inside its task
plus a prefix sum over the tasks.

Null and empty texts are one piece, the end id. Repeated rows are packed like any others.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from keytide.llm.common import chunks, cut, row_key, small_batches, table


#: White space that an encoder with a backtracking pattern can't get through.
_LONG_GAP = re.compile(r"\s{2000}")


class Encoder:
    """Ids of a text by a ``tokenizers`` file. If the same vocabulary is also there as ranks, tiktoken's encoder
    proposes the ids, several times faster, and every text's proposal is verified: a sequence of pieces is the
    byte-pair encoding of what it spells if each two neighbours are that of what they spell, so each distinct pair of
    neighbours is encoded once by the file's own tokenizer and remembered in a table of fixed size. (Neighbours are units of whole
    characters: pieces that share a character are one unit.) A text with a pair that isn't confirmed, or with very long
    white space, is encoded by the file's tokenizer."""

    BITS = 22
    START = (1 << 32) - 1  # stands before the first unit
    JOINED = 1 << 31  # units of several pieces have numbers from here on

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            added = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=table_of, special_tokens=added)
            self.inside = np.zeros(max([*table_of.values(), *added.values()]) + 1, bool)  # pieces that begin inside a character
            self.inside[[i for p, i in table_of.items() if 0x80 <= p[0] < 0xC0]] = True
            self._forget()

    def _forget(self) -> None:
        self.confirmed, self.refused = np.zeros(1 << self.BITS, np.uint64), set()
        self.joined: dict[bytes, int] = {}
        self.pieces_of: list[list[int]] = []

    def _slowly(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids(self, pair: int) -> list[int]:
        return [i for u in (pair >> 32, pair & 0xFFFFFFFF) if u != self.START for i in (self.pieces_of[u - self.JOINED] if u >= self.JOINED else [u])]

    def _confirm(self, pairs: np.ndarray) -> None:
        """Encode what each pair spells, and remember which come out as they are."""
        if len(pairs) > 4096:
            for i in range(0, len(pairs), 4096):
                self._confirm(pairs[i : i + 4096])
            return
        ids = [self._ids(p) for p in pairs.tolist()]
        spelled = [b"".join(map(self.fast.decode_single_token_bytes, x)).decode("utf-8", "replace") for x in ids]
        coded = self.slow.encode_batch_fast(spelled, add_special_tokens=False)
        good = np.array([c.ids == x for c, x in zip(coded, ids, strict=True)], bool)
        self.confirmed[self._slot(pairs[good])] = pairs[good]
        self.refused.update(pairs[~good].tolist())

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def _pairs(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of neighbouring units of the texts that begin at ``at``, and where each pair ends."""
        place = np.flatnonzero(~self.inside[ids])
        unit = ids[place].astype(np.uint64)
        size = np.diff(place, append=len(ids))
        for m in np.flatnonzero(size > 1).tolist():
            key = ids[place[m] : place[m] + size[m]]
            n = self.joined.get(key.tobytes())
            if n is None:
                n = self.joined[key.tobytes()] = self.JOINED + len(self.pieces_of)
                self.pieces_of.append(key.tolist())
            unit[m] = n
        before = np.concatenate([[self.START], unit[:-1]]).astype(np.uint64)
        before[np.searchsorted(place, at)] = self.START
        return before << np.uint64(32) | unit, place

    def many(self, texts: list[str]) -> list[np.ndarray]:
        out, ask = [None] * len(texts), []
        for i, t in enumerate(texts):
            if self.fast is None or _LONG_GAP.search(t):
                out[i] = self._slowly(t)
            elif t:
                out[i] = self.fast.encode_to_numpy(t, allowed_special="all")
                ask.append(i)
            else:
                out[i] = np.zeros(0, np.uint32)
        if not ask:
            return out
        if len(self.refused) + len(self.joined) > 500_000:
            self._forget()
        at = np.cumsum([0] + [len(out[i]) for i in ask])[:-1]
        pairs, place = self._pairs(np.concatenate([out[i] for i in ask]), at)
        new = self.confirmed[self._slot(pairs)] != pairs
        if new.any():
            which, where = np.unique(pairs[new], return_inverse=True)
            known = np.array([p in self.refused for p in which.tolist()], bool)
            self._confirm(which[~known])
            bad = np.array([p in self.refused for p in which.tolist()], bool)[where]
            for k in np.unique(np.searchsorted(at, place[new][bad], "right") - 1).tolist():
                out[ask[k]] = self._slowly(texts[ask[k]])
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks, pattern)


def public_encoder() -> dict:
    """Where the installed public vocabulary lies, in its two forms."""
    import public_tokenizers as P

    return {"path": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, end: int, tokens: dict) -> Iterator[pa.RecordBatch]:
    encode, part, seen = encoder(**tokens), TaskContext.get().partitionId(), Counter()
    for b in batches:
        texts = b.column("text").to_pylist()
        for at in chunks(texts, 1 << 20):
            rows: list[tuple] = []
            for i, ids in enumerate(encode.many([t or "" for t in texts[at]]), at.start):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for p, (s, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append((i, p, s, n, seen[n], ids[s : s + n].tobytes()))
                    seen[n] += 1
            i, p, s, n, k, ids = zip(*rows, strict=True)
            own = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(own), b.column("h").take(own), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array([part] * len(i), pa.int32()), pa.array(k, pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "h", "piece", "start", "length", "part", "k", "ids"],
            )


# the packing of a histogram


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for each limit, pieces above half are alone with what can't join them."""
    total, best = sum(n * c for n, c in counts.items()), 0
    lens = sorted(counts)
    for k in [0] + [n for n in lens if n <= capacity // 2]:
        large = sum(counts[n] for n in lens if n > capacity - k)
        middle = [n for n in lens if capacity / 2 < n <= capacity - k]
        n2 = sum(counts[n] for n in middle)
        spare = sum((capacity - n) * counts[n] for n in middle)
        small = sum(n * counts[n] for n in lens if k <= n <= capacity / 2)
        best = max(best, large + n2 + max(0, -(-(small - spare) // capacity)))
    return max(best, -(-total // capacity))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pieces, how often) by filling each opened sequence with the longest piece that fits, over and over."""
    left, out = Counter({n: c for n, c in counts.items() if c}), []
    lens = sorted(left)
    while lens:
        fill, room, used = [lens[-1]], capacity - lens[-1], Counter([lens[-1]])
        while (i := bisect.bisect_right(lens, room) - 1) >= 0:
            while i >= 0 and used[lens[i]] >= left[lens[i]]:
                i -= 1
            if i < 0:
                break
            fill.append(lens[i])
            used[lens[i]] += 1
            room -= lens[i]
        times = min(left[n] // u for n, u in used.items())
        out.append((tuple(fill), times))
        for n, u in used.items():
            left[n] -= u * times
            if not left[n]:
                lens.pop(bisect.bisect_left(lens, n))
    return out


class _Shelf:
    """Counts by length, with the fillings that they allow."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n, self.capacity = np.zeros(capacity + 1, np.int64), capacity
        for k, c in counts.items():
            self.n[k] = c

    def take(self, fill: tuple[int, ...], times: int) -> None:
        for k in fill:
            self.n[k] -= times

    def times(self, fill: tuple[int, ...]) -> int:
        return int(min(self.n[k] // u for k, u in Counter(fill).items()))

    def pair(self, room: int) -> tuple[int, int] | None:
        """The pair with the longest first piece that adds up to ``room``."""
        a = np.arange((room + 1) // 2, room)
        ok = np.flatnonzero((self.n[a] > 0) & (self.n[room - a] > (a == room - a)))
        return (int(a[ok[-1]]), int(room - a[ok[-1]])) if len(ok) else None

    def sums(self, room: int) -> tuple[list[int], list[int], list[int]]:
        """The lengths up to ``room``; how often each may be used; for the shortest j of them (j = 0, 1, ...) the sums that they
        reach, as bits."""
        lens = np.flatnonzero(self.n[1 : room + 1]) + 1
        most = np.minimum(self.n[lens], room // lens).tolist()
        lens, mask, reach = lens.tolist(), (1 << (room + 1)) - 1, [1]
        for k, left in zip(lens, most, strict=True):
            used, left, w = (reach[-1] << k) & mask, left - 1, 1
            while left:
                w = min(w, left)
                used |= (used << (w * k)) & mask
                left, w = left - w, 2 * w
            reach.append(reach[-1] | used)
        return lens, most, reach

    @staticmethod
    def pieces(lens: list[int], most: list[int], reach: list[int], total: int, j: int) -> list[int]:
        """Pieces of the shortest ``j`` lengths that add up to ``total``: as many as possible of the longest length, then of the next."""
        out: list[int] = []
        while total:
            j = bisect.bisect_right(lens, total, 0, j) - 1
            k = lens[j]
            u = next(u for u in range(min(most[j], total // k), -1, -1) if reach[j] >> (total - u * k) & 1)
            out += [k] * u
            total -= u * k
        return out

    def best(self, first: int) -> tuple[int, ...]:
        """The filling around ``first`` that wastes least: an exact one with one or two added pieces if there is one, else that
        of the longest pieces."""
        room = self.capacity - first
        self.n[first] -= 1
        try:
            if room == 0:
                return (first,)
            if self.n[room]:
                return (first, room)
            if got := self.pair(room):
                return (first, *got)
            lens, most, reach = self.sums(room)
            return (first, *self.pieces(lens, most, reach, reach[-1].bit_length() - 1, len(lens)))
        finally:
            self.n[first] += 1

    def undominated(self, first: int, spend: Callable[[], bool]) -> Iterator[tuple[int, ...]]:
        """All undominated fillings around ``first`` at the present counts, by waste, then the longest pieces first; each one looked
        at costs one of ``spend``, which is false when none is left.

        A filling is dominated if some of its added pieces, or none, can be exchanged for one piece left over that is longer
        than they are together and still fits, or for one that is as long as several of them together: whatever
        packing has the one, another that is no larger has the other. What exactly fills the room alone dominates all else."""
        room = self.capacity - first
        if room == 0 or self.n[room] - (room == first):
            yield (first, room) if room else (first,)
            return
        self.n[first] -= 1
        lens, most, reach = self.sums(room)
        self.n[first] += 1
        left, times = sum(1 << k for k in lens), dict(zip(lens, most, strict=True))
        for waste in range(room + 1):
            if not reach[-1] >> (room - waste) & 1:
                continue
            for added in _multisets(lens, most, reach, room - waste, len(lens)):
                if not spend():
                    return
                if not _dominated(added, waste, left, times):
                    yield (first, *added)


def _multisets(lens: list[int], most: list[int], reach: list[int], total: int, j: int) -> Iterator[tuple[int, ...]]:
    """All multisets of the shortest ``j`` lengths that add up to ``total``, which they reach: those with the longest pieces first."""
    if not total:
        yield ()
        return
    for i in range(bisect.bisect_right(lens, total, 0, j), 0, -1):
        k = lens[i - 1]
        for u in range(min(most[i - 1], total // k), 0, -1):
            if reach[i - 1] >> (total - u * k) & 1:
                for rest in _multisets(lens, most, reach, total - u * k, i - 1):
                    yield (k,) * u + rest


def _dominated(added: tuple[int, ...], waste: int, left: int, most: dict[int, int]) -> bool:
    """``left``: all lengths as bits; ``most``: how often each may be used."""
    for k, u in Counter(added).items():
        if u >= most[k]:
            left &= ~(1 << k)
    any_, one, several = 1, 0, 0  # the sums of any, of one, of two or more of the added pieces, as bits
    for k in added:
        several |= (one | several) << k
        one |= 1 << k
        any_ |= any_ << k
    width = 1  # sums and what is up to ``width`` above them; waste is 0 where the room is filled exactly
    above = any_ << 1
    while 2 * width <= waste:
        above, width = above | above << width, 2 * width
    above = (above | above << (waste - width)) if waste else 0
    return bool(left & (above | several))


def _choices(shelf: _Shelf, best: tuple[int, ...], spend: Callable[[], bool]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fillings to take instead of ``best``, and how often."""
    if len(best) == 1 or len(best) == 2 and sum(best) == shelf.capacity:
        return  # it dominates all others
    if shelf.times(best) > 1:
        yield best, 1
    for fill in shelf.undominated(best[0], spend):
        if fill != best:
            times = shelf.times(fill)
            yield fill, times
            if times > 1:
                yield fill, 1


def complete(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """(pieces, how often) of a packing of the counted lengths into as few sequences as found."""
    counts = {n: c for n, c in counts.items() if c > 0}
    best = best_fit_decreasing(counts, capacity)
    size, bound = sum(t for _, t in best), lower_bound(counts, capacity)
    total, depth, more = sum(n * c for n, c in counts.items()), 0, True

    def spend() -> bool:
        nonlocal nodes
        nodes -= 1
        return nodes > 0

    while more and size > bound and nodes > 0:
        shelf, used, rest, more = _Shelf(counts, capacity), 0, total, False
        steps: list[list] = []  # filling, how often, discrepancies left, choices other than it (None until asked for)
        down = True
        while size > bound and nodes > 0:
            if down and not rest:
                size, best, down = used, [(f, t) for f, t, *_ in steps], False
            elif down and used + -(-rest // capacity) >= size:
                down = False
            elif down:
                fill = shelf.best(int(np.flatnonzero(shelf.n)[-1]))
                step = [fill, shelf.times(fill), depth if not steps else steps[-1][4], None, 0]
                step[4] = step[2]
            elif not steps:
                break
            else:
                step = steps.pop()
                fill, t, spare, choices, _ = step
                shelf.take(fill, -t)
                used, rest = used - t, rest + t * sum(fill)
                if not spare:
                    more = True
                    continue
                if choices is None:
                    choices = enumerate(_choices(shelf, fill, spend), 1)
                rank, (fill, t) = next(choices, (0, (None, 0)))
                if fill is None:
                    continue
                if rank > spare:
                    more = True
                    continue
                step, down = [fill, t, spare, choices, spare - rank], True
            if down:
                nodes -= 1
                steps.append(step)
                shelf.take(step[0], step[1])
                used, rest = used + step[1], rest - step[1] * sum(step[0])
        depth += 1
    return best


def places(solution: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of places: first rank, first sequence, places per sequence, where their offsets begin; and the offsets."""
    runs: dict[int, list] = {}
    base = 0
    for fill, times in solution:
        at, offsets = 0, {}
        for n in fill:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, off in offsets.items():
            r = runs.setdefault(n, [0, [], [], [], [], []])
            r[1].append(r[0]), r[2].append(base), r[3].append(len(off)), r[4].append(len(r[5]))
            r[5] += off
            r[0] += times * len(off)
        base += times
    return {n: tuple(np.array(x, np.int64) for x in r[1:]) for n, r in runs.items()}


def placer(where: dict[int, tuple[np.ndarray, ...]]) -> Column:
    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k in np.unique(n):
            first, base, per, at, offsets = where[int(k)]
            i = np.flatnonzero(n == k)
            run = np.searchsorted(first, r[i], "right") - 1
            inside = r[i] - first[run]
            seq[i] = base[run] + inside // per[run]
            off[i] = offsets[at[run] + inside % per[run]]
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], names=["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, *, capacity: int = 2048, end: int = 0, tokens: dict | None = None, carry: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, sequence_id, offset, row_key, and what ``carry`` makes of
    the piece's ``ids`` (little-endian 32-bit; by default the ids themselves)."""
    small_batches(docs.sparkSession)
    carry = {"ids": F.col("ids")} if carry is None else carry
    src = docs.select(F.col(doc_id).alias("id"), row_key(F.col(text)).alias("h"), F.col(text).alias("text"))
    kind = f"id {docs.schema[doc_id].dataType.simpleString()}, h long, piece int, start long, length int, part int, k long, ids binary"
    cut_up = src.mapInArrow(partial(_pieces, capacity=capacity, end=end, tokens=tokens or public_encoder()), kind)
    pieces = cut(cut_up.select("id", "h", "piece", "start", "length", "part", "k", *[c.alias(n) for n, c in carry.items()]))
    per = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(F.col("part").alias("p_"), F.col("length").alias("l_"), before.alias("before"))
    # by shuffle: the table has a row for each task and length, and grows with the corpus
    ranked = pieces.join(starts.hint("shuffle_hash"), (F.col("part") == F.col("p_")) & (F.col("length") == F.col("l_"))).withColumn("rank", F.col("before") + F.col("k"))
    at = placer(places(complete(counts, capacity)))(F.col("length"), F.col("rank"))
    return ranked.withColumn("at", at).select(F.col("id").alias(doc_id), "piece", "start", F.col("length").cast("long").alias("length"), *carry, "at.sequence_id", "at.offset", F.col("h").alias("row_key"))


def write_sequences(packed: DataFrame, path: str) -> None:
    """The packed sequences themselves: sequence_id, ids (binary, the pieces one after the other)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("x")).select("sequence_id", F.aggregate("x", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    whole.write.parquet(path)


def query(spark, sf: str) -> DataFrame:
    out = pack(table(spark, sf, "documents"), carry={"ids_crc32": F.crc32("ids")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
