"""Toxic passages by maximum-scoring segments.

Model. Features are a word and its initial 3 to 6 letters, so that inflected and coined forms share
evidence. A feature's weight is the log-odds of its document frequencies in toxic and other labelled
texts under an informative Dirichlet prior (the background frequencies, ``PRIOR`` of their mass), less one
deviation and a quarter. A word has evidence if its log-odds are ``MIN_Z`` deviations above zero, its weight is ``LEAST`` at
least and ``TEXTS`` toxic texts have it; else it counts as any other token. A token (what
stands between white space) counts by its best word, a word by its most specific feature in the model. Every other token costs the
log-odds of "no feature".

Search. One linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa). Their scores
follow extreme-value statistics in clean text: the expected number of segments of score s in n words is
K n exp(-lambda s), with lambda the positive root of the clean texts' score distribution and K = 1, an upper
bound. A segment with an expectation of at most ``MAX_E`` is a passage. The evidence of a text is the
largest -log10 p of its best 1, 2, 3, ... segments together (Karlin and Altschul's sum statistics); a
logistic curve fitted on the training rows makes it, up to ``MOST``, a score from 0 to 1.

Fitting uses at most about ``max_rows`` labelled texts, chosen by a hash of their ids; equal texts, and near copies (about 0.8 of
five-word shingles) of one label, count once, since else the rare words of a toxic text with many copies would look toxic. Texts of
different labels are never taken for copies. Scoring reads nothing but the text. Null and empty texts have
no evidence and get the curve's lowest value. Without toxic training rows the model is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keytide.llm.common import chunks, cut, forget, small_batches, table
from keytide.llm.near_dups import T, band_keys, lists, shingle_sets, sketches

PRIOR, MIN_Z, LOWER, LEAST, TEXTS, CAP, MAX_E, MOST = 0.03, 2.3, 1.25, 1.0, 3, 8.0, 1e-3, 10.0
_WORDS = re.compile(r"[^\W\d_]+")
_TYPE = "score double, evidence double, starts array<int>, stops array<int>, scores array<double>"


def words(token: str) -> list[str]:
    return _WORDS.findall(token.lower())


def features(word: str) -> list[str]:
    """From the most general to the word itself."""
    return [word[:k] + "~" for k in range(3, 7) if len(word) > k] + [word]


def segments(at: np.ndarray, weight: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) of a sequence whose positive entries are given by
    place and weight and whose others each score ``drift`` < 0. Linear: each candidate is linked to the
    last one before it with a smaller sum on its left."""
    found: list[list] = []  # start, stop, sum left of it, sum with it, link
    total, last = 0.0, -1
    for i, w in zip(at.tolist(), weight.tolist(), strict=True):
        left = total + drift * (i - last - 1)
        total, last = left + w, i
        now = [i, i + 1, left, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= now[3]:
                now[4] = j
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], -1]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r, _ in found]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = -0.01
    rate: float = 1.0
    slope: float = 1.0
    offset: float = -3.0

    def weight_of(self, token: str) -> float:
        """The largest weight of a word in a token, each word's being that of its most specific feature; 0 without any."""
        found = (next((w for f in reversed(features(word)) if (w := self.weights.get(f)) is not None), 0.0) for word in words(token))
        return max(found, default=0.0)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """The largest -log10 p over the best r segments together."""
        best = total = 0.0
        for r, (_, _, s) in enumerate(sorted(found, key=lambda x: -x[2]), 1):
            x = self.rate * s - math.log(n)
            if x <= 0:
                break
            total += x
            if total > r - 1:  # the tail formula holds above its mode
                log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
                best = max(best, -log_p / math.log(10))
        return best

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(min(evidence, MOST)) + self.offset))))


class _Weights(dict):
    """Weights of tokens met so far, up to a bound."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > 300_000:
            self.clear()
        w = self[token] = self.model.weight_of(token)
        return w


def scorer(model: Model) -> Column:
    """A function of a text column: struct of score, evidence and the passages' starts, stops and scores."""
    seen = _Weights(model)

    @F.arrow_udf(_TYPE)
    def score(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            w = (t.as_py() or "").split()
            values = np.fromiter(map(seen.__getitem__, w), np.float64, len(w))
            at = np.flatnonzero(values)
            found = segments(at, values[at], model.drift) if len(at) else []
            e = model.evidence(len(w), found)
            real = [x for x in found if len(w) * math.exp(-model.rate * x[2]) <= MAX_E]
            rows.append({"score": model.probability(e), "evidence": e, "starts": [x[0] for x in real], "stops": [x[1] for x in real], "scores": [x[2] for x in real]})
        kind = pa.struct([("score", pa.float64()), ("evidence", pa.float64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64()))])
        return pa.array(rows, kind)

    return score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic, clean: in how many texts of each kind. The empty feature counts all pairs of text and feature-bearing word."""
    for b in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            distinct = {w for token in set(text.split()) for w in words(token)}
            counts[y].update({f for w in distinct for f in features(w)})
            counts[y][""] += len(distinct)
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], names=["feature", "toxic", "clean"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, keep: Column, doc_id: str = "doc_id") -> DataFrame:
    """id, y of at most about ``max_rows`` labelled rows: those with the smallest hashes of their ids."""
    y = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & keep).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    n = max(1, y.count())
    return y.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)) < max_rows)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for at in chunks(texts):
            sets = shingle_sets(texts[at], 5)
            sk = sketches(sets)
            keys = [k if len(s) else k[:0] for k, s in zip(band_keys(sk), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row")[at], lists(keys), lists(list(sk))], names=["row", "keys", "sketch"])


def _apart(rows: DataFrame) -> DataFrame:
    """``rows`` (text, y) without those that nearly repeat another one of their label: in each band of their sketches, a text is held
    against the first one of its label, and goes if 0.8 of their coordinates agree. The first of all copies stays."""
    rows = cut(rows.dropDuplicates(["text", "y"]).withColumn("row", F.monotonically_increasing_id()))
    prints = cut(rows.select("row", "text").mapInArrow(_signatures, "row long, keys array<long>, sketch array<long>"))
    bands = prints.select("row", F.explode("keys").alias("key")).join(rows.select("row", "y"), "row")
    firsts = bands.groupBy("key", "y").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = bands.join(firsts, ["key", "y"]).filter("row != first").select("row", "first").distinct()
    of = prints.select("row", "sketch")
    both = pairs.join(of, "row").join(of.select(F.col("row").alias("first"), F.col("sketch").alias("other")), "first")
    same = F.aggregate(F.zip_with("sketch", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    again = both.filter(same >= 0.8 * T).select("row").distinct()
    return rows.join(again, "row", "left_anti").select("text", "y")


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000) -> Model:
    small_batches(docs.sparkSession)
    y = labelled(docs, labels, label, max_rows, ~is_held_out(doc_id), doc_id)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(y.withColumn("y", F.col("y").cast("int"))), "id").filter("text is not null")
    rows = cut(_apart(rows.select("text", "y")))
    counts = rows.repartition(F.xxhash64("text")).mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = cut(counts.filter(F.col("t") >= TEXTS))
    total = counts.filter("feature = ''").first()
    model = Model()
    if total is None or not total.c:
        return model
    toxic, clean = float(total.t), float(total.c)
    prior = PRIOR * (F.col("t") + F.col("c"))
    at, ac = prior * toxic / (toxic + clean) + F.col("t"), prior * clean / (toxic + clean) + F.col("c")
    delta = F.log(at / (toxic * (1 + PRIOR) - at)) - F.log(ac / (clean * (1 + PRIOR) - ac))
    sd = F.sqrt(1 / at + 1 / ac)
    good = counts.filter("feature != ''").select("feature", "t", "c", delta.alias("delta"), sd.alias("sd")).filter((F.col("delta") > 1) & (F.col("delta") >= MIN_Z * F.col("sd")))
    best = sorted(good.filter(F.col("delta") - LOWER * F.col("sd") >= LEAST).collect())
    model.weights = {r.feature: min(CAP, r.delta - LOWER * r.sd) for r in best}
    # words that carry a feature, by their most general one, for the share of the others
    roots = [r for r in best if not any(f in model.weights for f in features(r.feature.rstrip("~"))[:-1] if f != r.feature)]
    share_t, share_c = (min(0.9, sum(getattr(r, k) for r in roots) / n) for k, n in (("t", toxic), ("c", clean)))
    model.drift = min(-1e-3, math.log((1 - share_t) / (1 - share_c)))
    model.rate = _rate([(model.weights[r.feature], (r.c + PRIOR * (r.t + r.c) * clean / (toxic + clean)) / clean) for r in roots], model.drift)
    pairs = rows.select("y", scorer(model)("text")["evidence"].alias("e")).collect()
    model.slope, model.offset = _logistic(np.log1p([min(p.e, MOST) for p in pairs]), np.array([p.y for p in pairs], float))
    forget(rows, counts)
    return model


def _rate(found: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum p exp(x s) = 1 over the scores of words in clean text."""
    rest = max(0.0, 1 - sum(p for _, p in found))
    f = lambda x: sum(p * math.exp(x * s) for s, p in found) + rest * math.exp(x * drift) - 1
    lo, hi = 0.0, 4.0
    if f(hi) <= 0:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return max(0.05, lo)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset by Newton steps with a light ridge, so that separable classes give a finite curve."""
    a = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (y - p) - ridge * b
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        b += step
        if abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column of score, evidence and passages (in tokens between white space)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, scorer(model)(F.col(text)))


def query(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = fit(docs, table(spark, sf, "labels"))
    s = score(docs.select("doc_id", "text"), model)
    return s.select("doc_id", is_held_out().alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"), F.size("toxicity.starts").cast("long").alias("n_passages"))
