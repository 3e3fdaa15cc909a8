"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only.

A benchmark item is the set of its windows: ``width`` consecutive words, or all of them if it has
fewer. A window is contained in a document where its words stand one after the other. Containment is
total, so one token of a window is a sufficient prefix: the rarest of its words, by the word counts of
the whole corpus. The index maps that word to the window and to the word's place in it.

One scan counts the words of the benchmark's vocabulary; a second one explodes each text into words and
probes the index. A match at word p for place o proposes the window at p - o: it has to begin and end
inside the document (positional and length bound), then its words are compared. All that happens inside
the scanning task; only hits and one row per document are shuffled. The index is broadcast in blocks of
at most ``block_bytes``, measured before and dealt by windows, so that a word with many windows is split, too: a larger benchmark makes more passes over the corpus, which at
a corpus of this kind moves far less than shuffling every word of it would.

Null and empty texts have no words and no hits; items without words are never hit. Rows that repeat an
id are told apart by their text, and rows alike in both each get their own (equal) result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keytide.llm.common import alnum_words, cut, forget, row_key

#: Stands for the end of a text; no word holds a space.
END = " end"


def windows(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, win: each distinct window of each item, its words joined by spaces."""
    w = items.select(F.col(item_id).alias("item_id"), alnum_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.concat_ws(" ", F.slice("w", s, n)))).alias("win")).distinct()


def _words_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), row_key(F.col(text)).alias("h"), alnum_words(F.col(text)).alias("w"))


def _bounded(df: DataFrame, bytes_of: Column, limit: int) -> tuple[int, int]:
    """(rows, blocks needed) of a table to be broadcast."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    return n, max(1, -(-int(size) // limit))


def _block(df: DataFrame, token: str, k: int, blocks: int) -> DataFrame:
    return F.broadcast(df if blocks == 1 else df.filter(F.pmod(F.xxhash64(token), F.lit(blocks)) == k))


def build_index(docs: DataFrame, wins: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """tok, place, len, win: each distinct window under its word that is rarest in ``docs``."""
    spread = wins.select("win").distinct().select("win", F.posexplode(F.split("win", " ")).alias("place", "tok"))
    vocab = cut(spread.select("tok").distinct())
    _, blocks = _bounded(vocab, F.length("tok") + 40, block_bytes)
    said = docs.select(F.explode(alnum_words(F.col(text))).alias("tok"))
    counts = None
    for k in range(blocks):
        c = said.join(_block(vocab, "tok", k, blocks), "tok").groupBy("tok").agg(F.count("*").alias("n"))
        counts = c if counts is None else counts.unionByName(c)
    ranked = spread.join(counts, "tok", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok", "place")).alias("r"), F.count("*").alias("len"))
    index = cut(ranked.select(F.col("r.tok").alias("tok"), F.col("r.place").alias("place"), F.col("len").cast("int").alias("len"), "win"))
    forget(vocab)
    return index


def find_hits(docs: DataFrame, index: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """id, h, start, len, win: every place of every window, and for each row of ``docs`` one row with
    len 0 whose start is its number of words."""
    _, blocks = _bounded(index, F.length("win") + F.length("tok") + 80, block_bytes)
    mark = index.sparkSession.createDataFrame([(END, 0, 0, "")], index.schema)
    out = None
    for k in range(blocks):
        part = index if blocks == 1 else index.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k)
        part = part.unionByName(mark) if k == 0 else part
        at = _words_of(docs, doc_id, text).select("id", "h", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("p", "tok"))
        start = F.col("p") - F.col("place")
        fits = (start >= 0) & (start + F.col("len") <= F.size("w"))
        same = (F.col("len") == 0) | (F.concat_ws(" ", F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len"))) == F.col("win"))
        hits = at.join(F.broadcast(part.withColumnRenamed("tok", "t")), (F.col("tok") == F.col("t")) & fits & same)
        hits = hits.select("id", "h", start.alias("start"), "len", "win")
        out = hits if out is None else out.unionByName(hits)
    return out


def items_of(hits: DataFrame, wins: DataFrame, block_bytes: int) -> DataFrame:
    """``hits`` (with a column win) with the items of their windows. By broadcast, as a window may be hit by very many documents."""
    _, blocks = _bounded(wins, F.length("win") + 60, block_bytes)
    parts = [wins if blocks == 1 else wins.filter(F.pmod(F.xxhash64("win", "item_id"), F.lit(blocks)) == k) for k in range(blocks)]
    return reduce(DataFrame.unionByName, [hits.join(F.broadcast(p), "win") for p in parts])


def repeated(rows: DataFrame, copies: str, block: int = 4096) -> DataFrame:
    """Each row as often as ``copies`` says; beyond ``block`` times, by blocks that are dealt to all tasks."""
    n = F.col(copies)
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))))
    if not rows.filter(n > block).isEmpty():
        blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), n - F.col("_block") * block)))).drop("_block", "_copy", copies)


def covered(spans: Column) -> Column:
    """How many words lie in the union of spans of (start, len)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, x):
        end = x["start"] + x["len"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"].cast("long")), F.lit(0))).alias("n"), F.greatest(acc["end"], end.cast("long")).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, add)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit (words inside any window), items (ids of the
    items with a window there, as sorted strings), spans (start and len in words, sorted), row_key."""
    wins = cut(windows(items, width, item_id, item_text))
    index = build_index(docs, wins, text, block_bytes)
    hits = find_hits(docs, index, doc_id, text, block_bytes)
    real = F.col("len") > 0
    per = cut(
        hits.groupBy("id", "h").agg(
            F.max(F.when(~real, F.col("start"))).alias("n_words"),
            F.count(F.when(~real, F.lit(1))).alias("copies"),
            F.collect_set(F.when(real, F.struct("start", "len"))).alias("spans"),
            F.collect_set(F.when(real, F.col("win"))).alias("wins"),
        )
    )
    named = items_of(per.filter(F.size("wins") > 0).select("id", "h", F.explode("wins").alias("win")), wins, block_bytes)
    with_items = named.groupBy(F.col("id").alias("id2"), F.col("h").alias("h2")).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    full = per.join(with_items, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left").select(
        F.col("id").alias(doc_id),
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.array_sort("spans").alias("spans"),
        F.col("h").alias("row_key"),
        "copies",
    )
    return repeated(cut(full), "copies")


def query(spark, sf: str) -> DataFrame:
    from keytide.llm.common import table

    out = decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"
SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
 dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw))),
 hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, win)),
 hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
 hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
