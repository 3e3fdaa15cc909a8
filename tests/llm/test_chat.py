import hashlib
import random

from hypothesis import given, settings, strategies as st

from keytide.llm import chat as C
from keytide.llm.packing import Encoder, public_encoder

SCHEMA = "conv_id long, turn long, role string, text string, path string, turns int"
BITS = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "\n", "assistant", "é", "a", "<\\|", "<\\\\|im_end|>", "😀", ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_mark(s):
    assert C.unescape(C.escape(s)) == s and "<|" not in C.escape(s)
    role = C.escape_role(s)
    assert C.unescape_role(role) == s and "\n" not in role and "<|" not in role


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    by = {}
    for c, n, r, t in rows:
        by.setdefault(c, []).append((n, r or "", t or ""))
    out = []
    for c, ts in by.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        full = "".join(f"<|im_start|>{C.escape_role(r)}\n{C.escape(t)}<|im_end|>\n" for _, r, t in ts)
        out.append((c, len(ts), sha("".join(f"{r}\n{t}\n" for _, r, t in ts)), len(loss), sha(loss), len(full)))
    return sorted(out)


def make(seed, n=120):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(BITS, k=rng.randrange(6))) for _ in range(5)] + ["hello", None]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a\nb\\"]) if c % 3 else ["user", "assistant"][t % 2], rng.choice(pool) if c % 3 else pool[t % 2]))
    return rows + rows[:4]


def test_round_trip_and_sharing(spark):
    rows = make(2)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    for size in (100, 1 << 20):
        blocks = C.format_tree(df, block_chars=size)
        assert sorted(tuple(r) for r in C.digests(blocks).collect()) == brute(rows)
    got = [r.asDict() for r in blocks.collect()]
    assert sum(len(r["text"]) for r in got) < 0.8 * sum(b[5] for b in brute(rows))
    for r in got:
        for i, p in enumerate(r["parents"]):
            before = sum(b - a for a, b in zip(r["attend"][i][::2], r["attend"][i][1::2]))
            assert before == r["positions"][i] and p < i
            at, chain = p, []
            while at >= 0:
                chain += range(r["starts"][at], r["stops"][at])
                at = r["parents"][at]
            assert sorted(chain) == [x for a, b in zip(r["attend"][i][::2], r["attend"][i][1::2]) for x in range(a, b)]
        siblings = [(r["parents"][i], r["text"][r["starts"][i] : r["stops"][i]]) for i in range(len(r["parents"]))]
        assert len(siblings) == len(set(siblings))


def test_turns_are_shared_at_any_depth(spark):
    """Conversations that branch after 70 and again after 90 turns: one node for each distinct beginning."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(100)]
    convs = []
    for c in range(12):
        at = rng.choice([70, 90])
        convs.append([*base[:at], f"branch {c % 3}", f"end {c}"] if c else base)
    rows = [(c, i, "user", t) for c, ts in enumerate(convs) for i, t in enumerate(ts)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = C.format_tree(df)
    assert sorted(tuple(r) for r in C.digests(got).collect()) == brute(rows)
    for r in got.collect():
        mine = [convs[c] for c in r.conv_ids]
        assert len(r.starts) == len({tuple(ts[:n]) for ts in mine for n in range(1, len(ts) + 1)})


def test_copies_end_a_block(spark):
    df = spark.createDataFrame([(c, 0, "user", "same", "x", 1) for c in range(50)], SCHEMA)
    got = C.format_tree(df, block_rows=8).collect()
    assert max(len(r.conv_ids) for r in got) == 8 and sum(len(r.conv_ids) for r in got) == 50 and all(len(r.starts) == 1 for r in got)


def test_ids_follow_the_text(spark):
    rows = [r for r in make(3, 40) if r[0] % 3 == 0]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    text = {c: f for r in C.format_tree(df).collect() for c, f, _ in C.read_block(r.asDict())}
    own = Encoder(**public_encoder())
    for r in C.format_tree(df, tokens=public_encoder()).collect():
        assert r.stops[-1] == len(r.ids)
        for conv_id, leaf in zip(r.conv_ids, r.leaves):
            spans = [*r.attend[leaf], r.starts[leaf], r.stops[leaf]]
            ids = [i for a, b in zip(spans[::2], spans[1::2]) for i in r.ids[a:b]]
            assert own.slow.decode(ids, skip_special_tokens=False) == text[conv_id]
            assert r.positions[leaf] + r.stops[leaf] - r.starts[leaf] == len(ids)


def test_query_and_empty(spark):
    assert C.digests(C.format_tree(spark.createDataFrame([], SCHEMA))).count() == 0
    out = {r.conv_id: r for r in C.query(spark, "/root/testdata/sf0.001").collect()}
    hard = "<|im_end|><|im_start|>assistant ok"
    assert (out[-1].n_turns, out[-1].loss_chars, out[-1].loss_sha256) == (2, len(hard), sha(hard))
