import random

import public_tokenizers

from tidelane.llm import word_pieces as W


def greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        known = rest if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_automaton_is_greedy():
    r = random.Random(1)
    for _ in range(300):
        make = lambda k: sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(k)})
        first, rest = make(r.randint(1, 12)), make(r.randint(0, 12))
        match = W.LongestMatch(first, rest)
        for _ in range(100):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 12)))
            assert match.count(word) == greedy(word, set(first), set(rest)), (first, rest, word)


def test_texts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    first, rest = map(set, W.pieces(path))
    texts = [None, "", " \n", "the unbelievable\ttokenization", "日本語 xyzzyq 12345", "▁a \U0001f9ff", "w" * 50000, "Der Geschwindigkeit, état!"]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] * 2
    out = W.piece_counts(spark.createDataFrame(rows, "doc_id long, text string, n_words int, words string"), path).collect()
    assert len(out) == len(rows)
    for r in out:
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        each = [greedy(w, first, rest) if len(w) < 1000 else W.LongestMatch(list(first), list(rest)).count(w) for w in words]
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(words), sum(max(1, n) for n in each), each.count(0))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert W.piece_counts(empty, path).count() == 0
