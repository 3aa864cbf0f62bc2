import random

from tidelane.llm import near_dedup as N


def brute(rows, size, percent):
    """Components by comparing all pairs of rows."""
    sets = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        n = len(words)
        sets.append({tuple(words[i : i + size]) for i in range(max(n - size + 1, 1))} if n else set())
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            x, y = sets[i], sets[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {(d, len(s), d if d is None else top(d)) for (d, _), s in zip(rows, sets)}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    shared = [r.choice(words) for _ in range(40)]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 30, 120, 200]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((doc, " ".join(copy)))
            doc += 1
        rows.append((doc, " ".join([r.choice(words) for _ in range(60)] + shared)))
        doc += 1
    # a chain: each link near the next, the ends far apart
    text = [f"c{i}" for i in range(120)]
    for i in range(12):
        rows.append((doc, " ".join(text)))
        doc += 1
        for k in range(5):
            text[(i * 10 + k) % 120] = f"d{i}-{k}"
    return rows


def test_matches_all_pairs(spark):
    rows = corpus(1) + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "one"), (None, "one"), (0, "one")]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    found = out.collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == brute(rows, 4, 80)
    assert len(found) == len(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def test_blocks_across_components(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 150)
    rows = corpus(2)
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()} == brute(rows, 4, 80)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, band long, rep string, a int")
    assert N.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 1, "x", 2)] * 3, "doc_id long, text string, band long, rep string, a int")
    assert [(r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect()] == [(1, 1, True)] * 3


def test_sketch_agreement_follows_similarity():
    import numpy as np

    rng = np.random.default_rng(5)
    agree = []
    for _ in range(50):
        pool = rng.integers(0, 2**63, 500, dtype=np.uint64)
        sets = [np.sort(pool[:450]), np.sort(pool[50:])]
        s = N.sketches(np.concatenate(sets), np.array([450, 450]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02 and np.std(agree) < 0.06


def test_planted_pairs_at_the_limit(spark):
    """Sets of 80 shared of 100 shingles in all are linked, of 79 they are not; with and without the cut by sketches."""
    rows, want = [], {}
    for k in range(150):
        shared = 80 if k % 2 else 79
        # One-word shingles: a set is what its words are.
        words = [f"k{k}w{i}" for i in range(100)]
        cut = shared + (100 - shared) // 2
        rows += [(2 * k, " ".join(words[:cut])), (2 * k + 1, " ".join(words[:shared] + words[cut:]))]
        want[2 * k + 1] = 2 * k if k % 2 else 2 * k + 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (N.LEAST_ESTIMATE, None):
        found = {r.doc_id: r.component_id for r in N.near_duplicates(df, shingle=1, least_estimate=least).collect()}
        assert {d: found[d] for d in want} == want


def test_very_long_texts(spark):
    words = [f"w{i % 5003}x{i}" for i in range(120000)]
    other = list(words)
    other[::40] = ["changed"] * len(other[::40])
    rows = [(1, " ".join(words)), (2, " ".join(words) + " end"), (3, " ".join(other)), (4, " ".join(reversed(words)))]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert found[1] == (119997, 1) and found[2] == (119998, 1) and found[3][1] == 1 and found[4] == (119997, 4)
