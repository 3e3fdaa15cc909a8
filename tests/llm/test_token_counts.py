import math
import random
import tracemalloc

import public_tokenizers as P
import pytest
import regex

from keytide.llm import token_counts as N
from keytide.llm.common import table


@pytest.fixture(scope="module")
def pieces():
    return N.load_pieces(P.path("byte_bpe_50k.tiktoken"))


def brute(pieces, word):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            if (s := pieces.get(word[j:i])) is not None:
                best[i] = max(best[i], (best[j][0] + s, best[j][1] - 1))
    return -best[-1][1]


def test_trie_against_plain_viterbi(pieces):
    rng, trie = random.Random(0), N.Trie(pieces)
    words = [bytes(rng.choices(b"abcdehinorst e\xc3\xa9", k=rng.randrange(0, 14))) for _ in range(600)] + [b"", b"information", b"informations", bytes(range(40, 200))]
    assert [trie.count(w) for w in words] == [brute(pieces, w) for w in words]
    # one forward score for each distinct beginning
    assert trie.nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_query_against_brute_force(spark, pieces):
    sf = "/root/testdata/sf0.001"
    split, known = regex.compile(P.PATTERN), {}
    got = {r.doc_id: r for r in N.query(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        words = split.findall(r.text)
        for w in words:
            known.setdefault(w, brute(pieces, w.encode()))
        assert (got[r.doc_id].n_chars, got[r.doc_id].n_pretokens, got[r.doc_id].n_tokens) == (len(r.text), len(words), sum(known[w] for w in words))


def test_long_words_take_no_nodes(pieces):
    rng, trie = random.Random(2), N.Trie(pieces)
    for n in (255, 256, 257, 400, 700):
        for letters in (b"abcdehinorst", b"a", b"-=", bytes(range(128, 256))):
            w = bytes(rng.choices(letters, k=n))
            assert trie.count(w) == brute(pieces, w)
    assert trie.nodes <= 20 * N.DEEP


def test_memory_of_a_long_word(pieces):
    c = N.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in ("".join(random.Random(1).choices("abcdefgh", k=2_000_000)), "a1" * 500_000):
        c("warm up")
        tracemalloc.start()
        words, n = c(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert words == (1 if "1" not in text else len(text)) and n <= len(text) and peak < 10 * len(text)


def test_dropping_the_trie_changes_nothing(monkeypatch):
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = " ".join(f"w{i * 7919}" for i in range(3000))
    want = N.Counter(*args)(text)
    monkeypatch.setattr(N, "MOST_NODES", 500)
    assert N.Counter(*args)(text) == want


def test_chunks_never_cut_a_pretoken():
    rng, c = random.Random(9), N.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    bits = [" ", "\n", "\t", "a", "b's", "!", "1", "é", "\x1c", "\x85", "\xa0", "\u3000", "'ll", "_", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(12)))
        words = c.split.findall(text)
        assert c(text) == (len(words), sum(c.trie.count(w.encode()) for w in words)), repr(text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "a" * 30_000, 1), (2, "a", 1), (None, "\x00é", 1)], "doc_id long, text string, n_tokens int")
    out = [(r.doc_id, len(r.text or ""), r.tokens.n_tokens) for r in N.count_tokens(df).collect()]
    assert {(1, 0, 0), (2, 0, 0), (2, 1, 1)} <= set(out) and len(out) == 5
    assert N.count_tokens(df.limit(0)).count() == 0
