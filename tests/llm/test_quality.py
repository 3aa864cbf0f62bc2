import random
import re
from collections import Counter

import numpy as np

from tidelane.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts(seed):
    r = random.Random(seed)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\x85y \x1c z", "é#é\n é#é\né#é\n\n\n", "a\r\nb\r\na\r\n"]
    for _ in range(150):
        vocab = ["w%d" % i for i in range(r.choice([3, 40, 2000]))] + ["é$", "|", "A"]
        out.append("".join(r.choice(vocab) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(r.randrange(300))))
    out.append("word " * 60000)
    return out


def test_measures_match_plain_code(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(2))] + [(None, "a b", 1, "x"), (3, "a", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, votes string")
    out = Q.scored(df).collect()
    assert len(out) == len(rows)
    by_id = {i: t for i, t, *_ in rows}
    for r in out:
        want = plain("a b" if r.doc_id is None else by_id[r.doc_id])
        assert tuple(r[m] for m in Q.MEASURES[:5]) == want, r
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed) and 0 <= r.posterior <= 1


def test_empty(spark):
    assert Q.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_recover_accuracies():
    rng = np.random.default_rng(3)
    n, alarm = 60000, np.array([0.01, 0.02, 0.05, 0.03])
    kind = rng.choice(5, n, p=[0.85, 0.08, 0.04, 0.02, 0.01])
    rates = np.vstack([alarm, [[0.95, 0.3, 0.05, 0.03], [0.01, 0.9, 0.6, 0.03], [0.01, 0.02, 0.97, 0.5], [0.2, 0.02, 0.05, 0.9]]])
    votes = np.where(rng.random((n, 4)) < rates[kind], -1, 1) * (rng.random((n, 4)) < 0.9)
    found = Counter(map(tuple, votes.tolist()))
    table = np.array(list(found))
    shares, got = Q.estimate(table, np.array(list(found.values()), float), alarm)
    assert abs(shares[0] - 0.85) < 0.04 and np.abs(got[0] - alarm).max() < 0.02 and got[1, 0] > 0.8
    kept = Q.posterior(votes, shares, got)[:, 0] >= 0.5
    assert kept[kind == 0].mean() > 0.97 and kept[kind == 1].mean() < 0.2


def test_data_outweigh_a_wrong_guess_of_false_alarms():
    rng = np.random.default_rng(4)
    n, truth = 300000, np.array([0.3, 0.02, 0.05, 0.03])
    kind = rng.choice(5, n, p=[0.85, 0.06, 0.04, 0.03, 0.02])
    rates = np.vstack([truth, np.full((4, 4), 0.05) + np.eye(4) * 0.9])
    votes = np.where(rng.random((n, 4)) < rates[kind], -1, 1)
    found = Counter(map(tuple, votes.tolist()))
    shares, got = Q.estimate(np.array(list(found)), np.array(list(found.values()), float), np.array([0.05, 0.02, 0.05, 0.03]))
    assert abs(got[0, 0] - 0.3) < 0.08
    # A document that only the noisy rule calls bad stays.
    assert Q.posterior(np.array([[-1, 1, 1, 1]]), shares, got)[0, 0] > 0.5


def test_verdicts_match_plain_code(spark):
    """Expectation maximisation document by document, in plain loops."""
    r = random.Random(6)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(10**6))[:1] + "abcdefghijklmnop"[r.randrange(9) :][:4] for _ in range(80)) + "." for _ in range(120)]
    bad = ["buy now " * 60, "#$% *** &&& " * 30, "A B C D " * 30, "12 34 567 " * 40, "LOUD WORDS EVERYWHERE TODAY " * 20, "", None]
    rows = [(i, t) for i, t in enumerate(good + bad * 6)]
    found = Q.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    votes, alarm = [list(x.votes) for x in found], [a for *_, a in Q._rules()]
    k = len(alarm)
    shares = [Q.START[0]] + [(1 - Q.START[0]) / k] * k
    start = [list(alarm)] + [[Q.START[1] if i == j else Q.START[2] for j in range(k)] for i in range(k)]
    rates = [list(x) for x in start]
    weight = [Q.ALARM_PRIOR] + [Q.PRIOR] * k

    def chances(v):
        out = []
        for share, rate in zip(shares, rates):
            p = share
            for x, q in zip(v, rate):
                p *= q if x < 0 else 1 - q if x > 0 else 1
            out.append(p)
        return [p / sum(out) for p in out]

    for _ in range(Q.ROUNDS):
        who = [chances(v) for v in votes]
        shares = [max(sum(w[c] for w in who) / len(votes), 1e-9) for c in range(k + 1)]
        shares = [s / sum(shares) for s in shares]
        rates = [
            [
                min(max((sum(w[c] for w, v in zip(who, votes) if v[j] < 0) + weight[c] * start[c][j]) / (sum(w[c] for w, v in zip(who, votes) if v[j]) + weight[c]), 1e-4), 0.999)
                for j in range(k)
            ]
            for c in range(k + 1)
        ]
    for x, v in zip(found, votes):
        p = chances(v)[0]
        assert abs(x.posterior - p) < 1e-6
        assert x.kept == (p >= Q.KEEP and not x.base_failed)
    assert {x.doc_id for x in found if x.kept} == set(range(120))


def test_no_rule_depends_on_the_length(spark):
    r = random.Random(7)
    long = " ".join("w%d." % int(30000 * r.random() ** 3) for _ in range(60000))
    rows = [(0, long), (1, "spam words again and again. " * 20000)]
    found = {x.doc_id: list(x.votes) for x in Q.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    variety = [name for name, *_ in Q._rules()].index("variety")
    assert found[0][variety] >= 0 and found[1][variety] == -1
