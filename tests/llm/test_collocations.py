import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidelane.llm import collocations as C


def sequences(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain_counts(rows, most):
    f = defaultdict(Counter)
    for text, lang in rows:
        for w in sequences(text):
            for d in range(1, most + 1):
                f[lang or "und"].update(" ".join(w[i : i + d]) for i in range(len(w) - d + 1))
    return f


def plain(rows, most=3, least=10, inside=50, top=2000):
    """The contract, phrase by phrase: containment is looked for in every longer candidate."""
    out = []
    for lang, f in plain_counts(rows, most).items():
        n = sum(v for p, v in f.items() if " " not in p)
        found = {p: v for p, v in f.items() if " " in p and v >= least}
        best = []
        for p, a in found.items():
            if any(100 * v >= inside * a and f" {p} " in f" {q} " and len(q.split(" ")) > len(p.split(" ")) for q, v in found.items()):
                continue
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                l, r = f[" ".join(w[:k])], f[" ".join(w[k:])]  # noqa: E741
                cuts.append((1000000 * a * a // (l * r), k, l, r))
            s, _, l, r = min(cuts)  # noqa: E741
            best.append((-s, -a, p.encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(best)[:top]):  # noqa: E741
            out.append((lang, i + 1, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def some_rows(seed, n):
    r = random.Random(seed)
    vocabulary = ["of", "the", "New", "york", "city", "É", "日本", "<b>", "x y", "of"]
    def text():
        return "".join(r.choice(vocabulary) + r.choice([" "] * 6 + ["\t", "  ", ".", ", ", "\n", "\r\n", "; "]) for _ in range(r.randint(0, 60)))
    return [(text(), r.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


def test_states_are_the_classes_of_equal_ends():
    r = random.Random(1)
    for _ in range(150):
        depth = r.randint(1, 5)
        seqs = [[r.randint(0, 2) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 5))]
        roots = [r.randint(0, 1) for _ in seqs]
        words = np.array([w for s in seqs for w in s], np.int32)
        room = np.array([min(i + 1, depth) for s in seqs for i in range(len(s))], np.int64)
        root = np.array([t for s, t in zip(seqs, roots) for _ in s], np.int64)
        if not len(words):
            continue
        ends = defaultdict(set)
        for i in range(len(words)):
            for d in range(1, room[i] + 1):
                ends[root[i], tuple(words[i - d + 1 : i + 1].tolist())].add(i)
        classes = defaultdict(list)
        for (t, phrase), places in ends.items():
            classes[t, frozenset(places)].append(phrase)
        a = C.SuffixAutomaton(words, room, root, np.ones(len(words), bool), depth)
        assert len(a.length) == len(classes)
        for s in range(len(a.length)):
            longest = tuple(words[a.end[s] - a.length[s] + 1 : a.end[s] + 1].tolist())
            t = root[a.end[s]]
            own = classes[t, frozenset(ends[t, longest])]
            assert (max(map(len, own)), min(map(len, own)), len(ends[t, longest])) == (a.length[s], a.shortest[s], a.count[s])
            shorter = longest[len(longest) - a.shortest[s] + 1 :]
            if not shorter:
                assert a.link[s] == -1
            else:
                k = a.link[s]
                assert root[a.end[k]] == t and a.end[k] in ends[t, shorter] and a.shortest[k] <= len(shorter) == a.length[k]
        end, length, count = a.phrases()
        got = {(root[e], tuple(words[e - n + 1 : e + 1].tolist())): c for e, n, c in zip(end, length, count)}
        assert len(end) == len(got) and got == {p: len(v) for p, v in ends.items()}


def test_counts_in_shards_of_any_size(spark):
    """Large texts are cut into shards, small ones share one; counts don't depend on it."""
    rows = [*some_rows(2, 60), (None, "en"), ("", "en"), ("a b c " * 500 + "x" * 3000 + " a b c" * 10, "en"), ("w" * 5000, "de"), ("...;", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for shard in (1 << 24, 64, 1):
        for most, least in ((3, 1), (4, 3)) if shard > 1 else ((2, 1),):
            found = C.phrase_counts(docs.repartition(3), most, least, shard).collect()
            got = {(r.lang, r.phrase): r.f for r in found if r.n_words}
            assert all(len(r.phrase.split(" ")) == r.n_words for r in found if r.n_words)
            want = {(lang, p): v for lang, f in plain_counts(rows, most).items() for p, v in f.items() if v >= least}
            assert got == want
            n = Counter()
            for r in found:
                n[r.lang] += 0 if r.n_words else r.f
            assert +n == {lang: s for lang, f in plain_counts(rows, 1).items() if (s := sum(f.values()))}


def test_collocations_against_plain_code(spark):
    rows = some_rows(3, 300)
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows * 2], "text string, lang string, n int, phrase string")
    for settings in ({}, {"max_words": 4, "least": 4, "inside_percent": 30, "top": 7}):
        want = plain(rows * 2, settings.get("max_words", 3), settings.get("least", 10), settings.get("inside_percent", 50), settings.get("top", 2000))
        out = C.collocations(docs, **settings)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == want and want


def test_score_is_exact(spark):
    r = random.Random(6)
    big = [(a, l, r_) for a, l, r_ in ((r.randint(10**14, 10**15), r.randint(10**14, 10**15), r.randint(10**14, 10**15)) for _ in range(200)) if a <= min(l, r_)]
    big += [(10**15 - 1, 10**15 - 1, 10**15 - 1), (10, 10, 10), (10, 3333, 30001), (999999999999999, 10**15, 999999999999999)]
    rows = spark.createDataFrame(big, "a long, l long, r long")
    for x in rows.withColumn("s", C.score(F.col("a"), F.col("l"), F.col("r"))).collect():
        assert x.s == 1000000 * x.a * x.a // (x.l * x.r)


def test_empty_tables_and_texts_without_words(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en"), (" .\n", "en")], "text string, lang string")).collect() == []
