"""Licence scanning with ordered signature rules, in DataFrame operations only.

A text becomes its lower-case words, one space apart, in one scan that also counts the base phrases and tries the rules:
a few gate words, found by one intersection with the text's words, and gate strings lead to groups of rules, in a group each rule whose keyword occurs runs its pattern, a literal that is
compiled once, over the whole text, marking its matches; what leaves the scan is, for each matching rule, the numbers of words
between and inside its matches. A match is an interval of words. A match inside another one of a higher rank, or of the same
rank and before it in the order (start, longest, rule), is suppressed; the others give the labels. The score is
the confidence of the best rank left, 0 without a match.

Base phrases are counted apart, at every place where their words stand; their labels always stay. Null
and empty texts have no words, no places, no labels and score 0. Matches of a text are at most as many as
its words, and are placed by windows over their counts of words, not by growing arrays. Each row has its own result,
whatever ids and texts repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from keytide.llm.common import NOT_WORD, ascii_lower, cut, row_key, table
from keytide.llm.license_rules import BASE, CONFIDENCE, Rule, gates, rules

#: Stand before and after a match; no word holds them.
OPEN, SHUT = "\x01", "\x02"


def _spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def _once(x: Column) -> Column:
    """The same value as the output of a generator, below which the optimizer doesn't copy its expression into each use."""
    return F.explode(F.array(x))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, where it is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marked(norm: Column, pattern: str) -> Column:
    return F.regexp_replace(norm, f"({pattern})", f"{OPEN}$1{SHUT}")


def _gaps(marked: Column) -> Column:
    """array of (gap, inner): the words between a match and the one before it, and inside it less one."""
    gap = lambda before: _spaces(F.substring_index(before, SHUT, -1)).alias("gap")
    inner = lambda part: _spaces(F.substring_index(part, SHUT, 1)).alias("inner")
    return _let(F.split(marked, OPEN), lambda p: F.filter(F.transform(p, lambda x, i: F.struct(gap(F.get(p, i - 1)), inner(x))), lambda x, i: i > 0))


def _matches(norm: str, words: str, signatures: list[Rule]) -> str:
    """SQL of an array of (rule, gaps) of the rules that match. ``words``: those of the text's words that are gates. As text, since
    some thousand column objects take longer to make than to parse. A few rules are tried at a time, so that few marked texts
    are there at once."""
    whole, strings = gates([r.keyword for r in signatures])
    groups: dict[str, list[str]] = {}
    for i, r in enumerate(signatures):
        word = next((w for w in whole if f" {w} " in r.keyword), None)
        door = f"array_contains({words}, '{word}')" if word else f"contains({norm}, '{next(g for g in strings if g in r.keyword)}')"
        marked = f"regexp_replace({norm}, r'({r.pattern})', '{OPEN}$1{SHUT}')"
        groups.setdefault(door, []).append(f"CASE WHEN contains({norm}, '{r.keyword}') THEN struct({i} AS rule, {marked} AS m) END")
    spaces = "octet_length({0}) - octet_length(replace({0}, ' ', ''))".format
    gap, inner = spaces(f"substring_index(get(p, i - 1), '{SHUT}', -1)"), spaces(f"substring_index(y, '{SHUT}', 1)")
    gaps = f"transform(array(split(x.m, '{OPEN}')), p -> filter(transform(p, (y, i) -> struct({gap} AS gap, {inner} AS inner)), (y, i) -> i > 0))[0]"
    of = f"transform(filter(array({{0}}), x -> contains(x.m, '{OPEN}')), x -> struct(x.rule AS rule, {gaps} AS gaps))".format
    some = [f"CASE WHEN {door} THEN {of(', '.join(each[k : k + 6]))} END" for door, each in groups.items() for k in range(0, len(each), 6)]
    return f"flatten(filter(array({', '.join(some)}), x -> x IS NOT NULL))"


def base_places(norm: Column, words: Column, n_words: Column, phrases: dict[str, str]) -> Column:
    """struct(n, first, last, labels) over all places of all base phrases. ``words`` holds each phrase's first word, if the text does."""

    def places(phrase: str, label: str) -> Column:
        last = n_words - _spaces(F.substring_index(norm, f" {phrase} ", -1)) - len(phrase.split())
        found = _let(_gaps(_marked(norm, f"(?<= ){phrase}(?= )")), lambda g: F.struct(F.size(g).alias("n"), (F.get(g, F.lit(0))["gap"] - 1).alias("first"), last.alias("last"), F.lit(label).alias("label")))
        return F.when(F.array_contains(words, phrase.split()[0]), F.when(F.contains(norm, F.lit(f" {phrase} ")), found))

    each = [places(*x) for x in phrases.items()]
    got = F.filter(F.array(*each), lambda x: x.isNotNull())
    return F.struct(
        F.aggregate(got, F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n"),
        F.array_min(F.transform(got, lambda x: x["first"])).cast("long").alias("first"),
        F.array_max(F.transform(got, lambda x: x["last"])).cast("long").alias("last"),
        F.array_sort(F.array_distinct(F.transform(got, lambda x: x["label"]))).alias("labels"),
    )


def _detections(matched: DataFrame, signatures: list[Rule]) -> DataFrame:
    """row, start, stop (in words), label, rank, rule: what is left after suppression, of rows (row, rule, gaps)."""
    one = matched.select("row", "rule", F.posexplode("gaps").alias("i", "x")).select("row", "rule", "i", "x.gap", "x.inner")
    in_rule = Window.partitionBy("row", "rule").orderBy("i")
    start = F.sum("gap").over(in_rule) + F.coalesce(F.sum("inner").over(in_rule.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    named = F.broadcast(matched.sparkSession.createDataFrame([(i, r.number, r.label, r.rank) for i, r in enumerate(signatures)], "rule int, number int, label string, rank int"))
    at = one.repartition("row").withColumn("start", start).withColumn("stop", F.col("start") + F.col("inner") + 1).join(named, "rule")
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("rank"), "number").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")
    for rank in sorted({r.rank for r in signatures}):
        reach = F.when(F.col("rank") == rank, F.max(F.when(F.col("rank") >= rank, F.col("stop"))).over(before)).otherwise(reach)
    return at.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("reach") < F.col("stop"))).select("row", "start", "stop", "label", "rank", F.col("number").alias("rule"))


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", signatures: list[Rule] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels and labels
    (sorted arrays), score, detections (start, stop, label, rank, rule; by start), row_key."""
    signatures = rules() if signatures is None else signatures
    base = BASE if base is None else base
    gate_words = F.array(*map(F.lit, sorted({*gates([r.keyword for r in signatures])[0], *(p.split()[0] for p in base)})))
    split = docs.select(F.col(doc_id).alias("id"), row_key(F.col(text)).alias("h"), _once(F.split(ascii_lower(F.col(text)), NOT_WORD)).alias("w"))
    # an empty string at either end stands for signs before or after all words
    spaced = F.concat(F.lit(" "), F.trim(F.array_join("w", " ")), F.lit(" "))
    norm = split.select("id", "h", F.array_intersect("w", gate_words).alias("gates"), _once(spaced).alias("norm"))
    counted = norm.select("id", "h", "gates", "norm", _once(F.when(F.col("norm") == "  ", 0).otherwise(_spaces(F.col("norm")) - 1)).alias("n"))
    # inside a lambda, so that the many expressions are evaluated where their conditions ask for them, not compiled into one method
    places = _let(F.struct("norm", "gates", "n"), lambda t: base_places(t["norm"], t["gates"], t["n"], base))
    found = F.expr(f"transform(array(struct(norm, gates)), t -> {_matches('t.norm', 't.gates', signatures)})[0]")
    scanned = cut(counted.select("id", "h", "n", places.alias("b"), found.alias("m"), F.monotonically_increasing_id().alias("row")))
    score = F.max(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("rank")])
    matched = scanned.filter(F.size("m") > 0)
    found = _detections(matched.select("row", F.explode("m").alias("x")).select("row", "x.rule", "x.gaps"), signatures).groupBy(F.col("row").alias("row_")).agg(
        F.collect_set("label").alias("found"), score.alias("score"), F.sort_array(F.collect_list(F.struct("start", "stop", "label", "rank", "rule"))).alias("detections")
    )
    facts = ["id", "h", "n", "b"]
    none = [F.array().cast("array<string>").alias("found"), F.lit(0.0).alias("score"), F.array().cast("array<struct<start:bigint,stop:bigint,label:string,rank:int,rule:int>>").alias("detections")]
    with_any = matched.select("row", *facts).join(found, F.col("row") == F.col("row_")).select(*facts, "found", "score", "detections")
    return with_any.unionByName(scanned.filter(F.size("m") == 0).select(*facts, *none)).select(
        F.col("id").alias(doc_id),
        F.col("n").cast("long").alias("n_words"),
        F.col("b.n").alias("n_base"),
        F.col("b.first").alias("first_word"),
        F.col("b.last").alias("last_word"),
        F.col("b.labels").alias("base_labels"),
        F.array_sort(F.array_union("b.labels", "found")).alias("labels"),
        "score",
        "detections",
        F.col("h").alias("row_key"),
    )


def query(spark, sf: str) -> DataFrame:
    out = scan_licenses(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("detections").cast("long").alias("n_detections"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"
BASE_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
 p AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{b}', {len(p.split())})" for p, b in BASE.items())}) t(phrase, label, n)),
 s AS (SELECT row, w, unnest(range(len(w))) AS i FROM d),
 f AS (SELECT row, i, label FROM s JOIN p ON array_to_string(w[i + 1:i + n], ' ') = phrase),
 g AS (SELECT row, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY row)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (row)"""
