import random
import re

from pyspark.sql import functions as F

from keytide.llm.common import table
from keytide.llm.license_rules import BASE, CONFIDENCE, gates, rules
from keytide.llm.licenses import query, scan_licenses

SCHEMA = "doc_id long, text string, rule string, start int"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, signatures):
    w = words(text)
    norm = " " + " ".join(w) + " "
    places = [(i, b) for p, b in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = [(norm[: m.start()].count(" ") - 1, norm[: m.start()].count(" ") + m[0].count(" "), r) for r in signatures for m in re.finditer(r.pattern, norm)]
    kept = []
    for a, b, r in found:
        inside = any((c, -d, -q.rank, q.number) < (a, -b, -r.rank, r.number) and q.rank >= r.rank and d >= b for c, d, q in found)
        if not inside:
            kept.append(r)
    labels = {b for _, b in places}
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), sorted(labels), sorted(labels | {r.label for r in kept}), max((CONFIDENCE[r.rank] for r in kept), default=0.0), len(kept)


def test_rules_and_keywords():
    rs = rules()
    assert len(rs) > 300
    for r in rs:
        assert r.keyword.strip() and r.keyword.strip() in r.pattern
    words, strings = gates([r.keyword for r in rs])
    assert all(any(f" {w} " in r.keyword for w in words) or any(g in r.keyword for g in strings) for r in rs)


def test_keywords_and_gates_are_in_every_match():
    """Of each rule some texts that match, made from its pattern by taking or leaving what is optional."""
    rng, rs = random.Random(1), rules()
    words, strings = gates([r.keyword for r in rs])
    for r in rs:
        body = r.pattern.removeprefix("(?<= )(?:").removesuffix(")(?= )")
        for _ in range(20):
            text = body
            while m := re.search(r"\(([^()]*)\)(\?)?", text):
                text = text[: m.start()] + ("" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|"))) + text[m.end() :]
            text = re.sub(r"\.\{1,80\}\?", "any name", text)
            text = re.sub(r"\[a-z\]\+", "somebody", text)
            text = re.sub(r"\[([^\]]*)\](\?)?", lambda m: "" if m[2] and rng.random() < 0.5 else rng.choice(m[1].replace("0-9", "0123456789")), text)
            text = re.sub(r"([a-z0-9 ])\?", lambda m: rng.choice(["", m[1]]), text)
            norm = f" x {text} y "
            assert re.search(r.pattern, norm), (r, text)
            assert r.keyword in norm and (set(words) & set(norm.split()) or any(g in norm for g in strings)), (r, text)


def test_query(spark):
    """The query's own columns over a table of the driver, against the definition."""
    sf, rs = "/root/testdata/sf0.001", rules()
    want = []
    for r in table(spark, sf, "documents").collect():
        n, n_base, first, last, base, labels, score, found = brute(r.text, rs)
        want.append((r.doc_id, n, n_base, first, last, ",".join(base), ",".join(labels), score, found))
    assert sorted(map(tuple, query(spark, sf).collect())) == sorted(want)


def test_against_brute_force(spark):
    rng, rs = random.Random(5), rules()
    bits = ["Licensed under the Apache License, Version 2.0", "the MIT License", "CC BY-NC-SA 4.0", "cc by cc by", "GNU General Public License v3 or any later version", "SPDX-License-Identifier: MIT",
            "gnu lesser general public license version 2.1", "the", "und", "ñandú", "a", "all rights reserved", "\n\n", "copyright 2019", "BSD 3-Clause", "public domain", "mit licensed", "gplv3", "İK"]
    texts = [None, "", "  .,", "cc by", "CC BY cc by", "mit license" * 2] + [rng.choice([" ", ", ", "\n"]).join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(60)] + ["Apache License " * 3000]
    texts += texts[10:14]
    df = spark.createDataFrame([(i % 60, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = [tuple(r) for r in scan_licenses(df).withColumn("detections", F.size("detections")).collect()]
    big = [r for r in got if r[1] == 6000]
    assert len(big) == 1 and big[0][2:5] == (3000, 0, 5998) and big[0][8] == 3000
    fix = lambda rows: sorted([(r[0], r[1], r[2], r[3], r[4], list(r[5]), list(r[6]), r[7], r[8]) for r in rows if r[1] != 6000], key=repr)
    ids = [i % 60 for i, t in enumerate(texts) if len(words(t)) != 6000]
    want = [(k, *brute(t, rs)) for k, t in zip(ids, [t for t in texts if len(words(t)) != 6000])]
    assert fix(got) == fix(want)


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
