"""Token counts by dynamic programming over a trie of pre-tokens.

A text is split into pre-tokens by the vocabulary's pattern; the tokens of a pre-token are its best
segmentation under a unigram model, each piece of the vocabulary having a log-probability by its rank
(Zipf's law: p proportional to 1 / (rank + OFFSET); nothing is trained). Distinct pre-tokens of a task go into a trie of bytes. The
forward score at a node, the best score of the bytes down to it, depends on the path alone, so it is computed once
for all pre-tokens with that beginning; a node keeps the score and the number of tokens of its best
segmentation, and a pre-token's count is read at its end. Of equal scores, fewer tokens win.

Every byte is a piece, so every text has a segmentation. Tries are dropped and started anew beyond ``MOST_NODES``
nodes, which changes no result. A pre-token's bytes beyond ``DEEP`` get no nodes: a score needs none but those of the
last few bytes, as many as the longest piece has, which are kept in a ring; so a pre-token of any length takes no more
memory than itself. Null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import gc
import math
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from keytide.llm.common import small_batches, table

OFFSET, MOST_NODES, MOST_WORDS, DEEP = 10.0, 800_000, 500_000, 256
#: White space as the vocabulary's pattern knows it: not the four information separators.
_CHUNKS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|\s+")


def load_pieces(path: str) -> dict[bytes, float]:
    """Log-probabilities of the pieces of a file of (base64 piece, rank) lines."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(sum(1 / (r + OFFSET) for r in ranks.values()))
    return {p: -math.log(r + OFFSET) - norm for p, r in ranks.items()}


class Trie:
    """Forward scores of byte strings, shared by what they have in common at their beginning.

    Nodes are numbers (the root is 0): ``next`` leads from a node and a byte to the node below, ``best`` and
    ``tokens`` hold each node's score and the tokens of that segmentation. No node is an object that the garbage collector follows."""

    def __init__(self, pieces: dict[bytes, float]):
        self.longest = max(map(len, pieces))
        # pieces by their reversed bytes, (children, score or None): from a node, they are read backwards along the path
        self.ends: dict = {}
        for p, s in pieces.items():
            at = self.ends
            for b in p[:0:-1]:
                at = at.setdefault(b, ({}, None))[0]
            at[p[0]] = (at.get(p[0], ({},))[0], s)
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    @property
    def nodes(self) -> int:
        return len(self.next)

    def count(self, word: bytes) -> int:
        """The number of tokens; adds nodes for what of the word's beginning is new."""
        if len(self.next) > MOST_NODES:
            self.clear()
        down, best, tokens = self.next, self.best, self.tokens
        node, path = 0, [0]
        for i, b in enumerate(word[:DEEP]):
            below = down.get(node << 8 | b)
            if below is None:
                top, least, ends = -math.inf, 0, self.ends
                for j in range(i, -1, -1):
                    piece = ends.get(word[j])
                    if piece is None:
                        break
                    ends, s = piece
                    if s is not None:
                        at = path[j]
                        s += best[at]
                        if s > top or (s == top and tokens[at] < least):
                            top, least = s, tokens[at]
                below = down[node << 8 | b] = len(best)
                best.append(top)
                tokens.append(least + 1)
            node = below
            path.append(node)
        return tokens[node] if len(word) <= DEEP else self._roll(word, [best[n] for n in path], [tokens[n] for n in path])

    def _roll(self, word: bytes, best: list[float], tokens: list[int]) -> int:
        """The number of tokens of a long word, given the scores of its first ``DEEP`` bytes and before."""
        size = max(self.longest, DEEP) + 1
        best, tokens = best + [0.0] * (size - len(best)), tokens + [0] * (size - len(tokens))
        for i in range(DEEP, len(word)):
            top, least, ends = -math.inf, 0, self.ends
            for j in range(i, -1, -1):
                piece = ends.get(word[j])
                if piece is None:
                    break
                ends, s = piece
                if s is not None:
                    s += best[j % size]
                    if s > top or (s == top and tokens[j % size] < least):
                        top, least = s, tokens[j % size]
            best[(i + 1) % size], tokens[(i + 1) % size] = top, least + 1
        return tokens[len(word) % size]


class Counter(dict):
    """Counts of chunks met so far, up to a bound, over one trie.

    A chunk is white space and what follows it up to the next white space. No pre-token goes on from anything else
    into white space, so chunks can be split into pre-tokens one by one. A value holds pre-tokens and tokens."""

    def __init__(self, ranks: str, pattern: str):
        self.trie, self.split = Trie(load_pieces(ranks)), regex.compile(pattern)

    def __missing__(self, chunk: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        if len(chunk) > 200:  # one by one, as there may be very many
            words, n = 0, 0
            for m in self.split.finditer(chunk):
                words, n = words + 1, n + self.trie.count(m[0].encode("utf-8", "surrogatepass"))
            return (n << 32) + words
        words = self.split.findall(chunk)
        v = self[chunk] = (sum([self.trie.count(w.encode("utf-8", "surrogatepass")) for w in words]) << 32) + len(words)
        return v

    def __call__(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens)"""
        if not text:
            return 0, 0
        chunks = _CHUNKS.findall(text) if len(text) < 1 << 20 else (m[0] for m in _CHUNKS.finditer(text))
        both = sum(map(self.__getitem__, chunks))
        return both & 0xFFFFFFFF, both >> 32


@lru_cache(maxsize=2)
def counter(ranks: str, pattern: str) -> Counter:
    made = Counter(ranks, pattern)
    gc.freeze()  # the table of pieces stays for the worker's life
    return made


def token_counter(ranks: str | None = None, pattern: str | None = None) -> Column:
    """A function of a text column: struct of n_pretokens and n_tokens."""
    if ranks is None or pattern is None:
        import public_tokenizers as P

        ranks, pattern = ranks or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN

    @F.arrow_udf("n_pretokens long, n_tokens long")
    def count(texts: pa.Array) -> pa.Array:
        of = counter(ranks, pattern)
        got = [of(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["n_pretokens", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, *, text: str = "text", into: str = "tokens", **vocabulary) -> DataFrame:
    """``docs`` with a struct column of n_pretokens and n_tokens."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, token_counter(**vocabulary)(F.col(text)))


def query(spark, sf: str) -> DataFrame:
    got = count_tokens(table(spark, sf, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "tokens.n_pretokens", "tokens.n_tokens")
