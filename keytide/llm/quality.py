"""Quality by importance resampling.

Two generative models over hashed word n-grams (unigrams and bigrams in ``BUCKETS`` buckets): one of the
target, texts labelled good, one of the raw corpus, all texts. A text's importance weight is the ratio of
its probabilities, log w = sum of log(p_target / p_raw) over its n-grams. Rows are drawn without replacement
in proportion to w^(1/temperature) by Gumbel top-k: the k largest log w / temperature + Gumbel noise, the
noise being a hash of the row. By default k is the number of rows at least as heavy as the threshold that best
separates labelled good and bad rows.

Tokens are lower-case words and runs of signs; marks for capitals and for a repeat of the token
before make shouting and loops visible to bags of n-grams. Counts of n-grams cover the whole corpus: a
histogram of fixed size from each task, summed by bucket. The target is fitted on about ``max_rows`` labelled
rows at most. The k-th largest key is found by counting in ever finer bins, exactly; rows equal to it all stay.

Null and empty texts have no n-grams and weight 0 (log), that of the raw text itself; so have all texts if
nothing is labelled good, and then all stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keytide.llm.common import chunks, cut, forget, row_key, small_batches, table
from keytide.llm.toxicity import labelled

BUCKETS, MARKS = 10_000, 16
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_CAPS, _REPEAT = 1, 2
_SCALE = np.int64(0x9E3779B1)


class _Ids(dict):
    """Hashes of tokens as written, with a bit for capitals; remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) << 1
        v = self[token] = h | (len(token) > 1 and token.isupper())
        return v


_ids = _Ids()


def ngrams(text: str | None) -> np.ndarray:
    """The buckets of a text's n-grams: marks first have buckets of their own, then unigrams and bigrams."""
    found = _TOKENS.findall(text) if text else []
    if not found:
        return np.zeros(0, np.int64)
    v = np.fromiter(map(_ids.__getitem__, found), np.int64, len(found))
    h, caps = v >> 1, v & 1
    again = np.flatnonzero(h[1:] == h[:-1])
    room = BUCKETS - MARKS
    uni = MARKS + (h * _SCALE >> 7) % room
    bi = MARKS + ((h[:-1] * np.int64(31) + h[1:]) * _SCALE >> 7) % room
    return np.concatenate([uni, bi, np.full(int(caps.sum()), _CAPS), np.full(len(again), _REPEAT)])


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        texts, good = b.column("text").to_pylist(), [y == 1 for y in b.column("y").to_pylist()]
        for at in chunks(texts):
            got = [ngrams(t) for t in texts[at]]
            raw += np.bincount(np.concatenate(got), minlength=BUCKETS)
            if some := [g for g, y in zip(got, good[at], strict=True) if y]:
                target += np.bincount(np.concatenate(some), minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float


def weigher(ratio: np.ndarray) -> Column:
    @F.arrow_udf("n_grams long, log_weight double")
    def weigh(texts: pa.Array) -> pa.Array:
        n, w = [], []
        for t in texts:
            g = ngrams(t.as_py())
            n.append(len(g))
            w.append(float(ratio[g].sum()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["n_grams", "log_weight"])

    return weigh


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Model:
    small_batches(docs.sparkSession)
    y = cut(labelled(docs, labels, label, max_rows, F.lit(True), doc_id))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(y), "id", "left").select("text", "y")
    hist = rows.mapInArrow(_histograms, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in hist:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    # the raw model tempers the target's, so that a bucket without target text is unlikely but not impossible
    p_raw = (raw + 1e-3) / (raw + 1e-3).sum()
    p_target = (target + 1.0 * p_raw * BUCKETS / 100) / (target + 1.0 * p_raw * BUCKETS / 100).sum()
    ratio = np.log(p_target / p_raw)
    some = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(y), "id").select("y", weigher(ratio)("text")["log_weight"].alias("w")).collect()
    forget(y)
    return Model(ratio, _threshold(np.array([r.w for r in some]), np.array([r.y for r in some])))


def _threshold(w: np.ndarray, y: np.ndarray, cost: float = 5.0) -> float:
    """Where rejecting what is lighter is cheapest, a good row lost counting ``cost`` bad rows kept; in the middle of the gap."""
    if not (y == 0).any():
        return -np.inf
    order = np.argsort(w, kind="stable")
    w, y = w[order], y[order]
    loss = np.concatenate([[0.0], np.cumsum(np.where(y == 1, cost, -1.0))])
    i = int(np.argmin(loss))
    return -np.inf if i == 0 else float((w[i - 1] + w[min(i, len(w) - 1)]) / 2)


def gumbel(*of: Column) -> Column:
    """Standard Gumbel noise from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(*of, F.lit(11)), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column, by counts in bins that narrow until one holds a single value."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return None
    above, part = 0, df.select(F.col(column).alias("v"))
    while lo < hi:
        width = (hi - lo) / bins
        b = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        got = part.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(got, key=lambda r: -r.b):
            if above + r.n >= k:
                break
            above += r.n
        if (r.lo, r.hi) == (lo, hi):  # as narrow as doubles allow
            break
        lo, hi = r.lo, r.hi
        part = part.filter((F.col("v") >= lo) & (F.col("v") <= hi))
    return lo


def resample(docs: DataFrame, model: Model, *, k: int | None = None, temperature: float = 1.0, seed: int = 0, doc_id: str = "doc_id", text: str = "text", drawn: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_grams, log_weight, gumbel_key, selected, row_key; with ``drawn``, the selected
    rows of ``docs`` themselves, which are written beside their keys and so needn't be joined with them."""
    small_batches(docs.sparkSession)
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if drawn else []
    w = docs.select(F.col(doc_id).alias("id"), row_key(F.col(text)).alias("h"), weigher(model.ratio)(F.col(text)).alias("x"), *whole)
    keyed = cut(w.select("id", "h", "x.n_grams", "x.log_weight", *(["row"] if drawn else []), (F.col("x.log_weight") / temperature + gumbel(F.coalesce("id", F.lit(0)), F.col("h"), F.lit(seed))).alias("gumbel_key")))
    if k is None:
        k = keyed.filter(F.col("log_weight") >= F.lit(float(model.threshold))).count()
    last = kth_largest(keyed, "gumbel_key", k)
    stays = F.lit(False) if last is None else F.col("gumbel_key") >= F.lit(last)
    if drawn:
        return keyed.filter(stays).select("row.*")
    return keyed.select(F.col("id").alias(doc_id), "n_grams", "log_weight", "gumbel_key", stays.alias("selected"), F.col("h").alias("row_key"))


def query(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return resample(docs, fit(docs, table(spark, sf, "labels"))).drop("row_key")
