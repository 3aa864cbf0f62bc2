import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidelane.llm import fill_in_middle as M


def plain(doc_id, text, percent=90, spm=20):
    """The contract, by a regular expression."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def walked(text, state):
    """The automaton, byte by byte."""
    units, marked = 0, False
    for c in text:
        letter = bytes([c]).isalpha()
        units += c & 0xC0 != 0x80 and not (letter and state in (M.INSIDE, M.NAMED))
        marked |= state == M.NAMED and c == ord(">")
        state = int(M.STEP[state, c])
    return state, units, marked


def pieces(r, alphabet, most):
    return "".join(r.choice(alphabet) for _ in range(r.randint(0, most)))


def test_functions_are_those_of_the_automaton():
    r = random.Random(3)
    for _ in range(300):
        parts = [pieces(r, "aP<>S<M>é日\U0001f600 .", 6).encode() for _ in range(r.randint(0, 9))]
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        after, units, marked = M.functions(np.frombuffer(b"".join(parts), np.uint8), edges)
        for i, p in enumerate(parts):
            for s in range(4):
                # A state that a cut can't leave: a letter's state before a continuation byte.
                assert (after[i, s], units[i, s], marked[i, s]) == walked(p, s), (p, s)


def test_composition_is_associative_and_resolves_entries():
    r = random.Random(4)
    for _ in range(200):
        text = pieces(r, "abP<>S<M>é日 .", 60)
        raw = text.encode()
        edges = M.stretches(raw, r.randint(1, 9))
        assert edges[-1] == len(raw) and b"".join(raw[a:b] for a, b in zip(edges, edges[1:])) == raw
        if len(edges) < 2:
            continue
        f = M.functions(np.frombuffer(raw, np.uint8), np.array(edges))
        state, before, n, mark = M.entries(*f)
        assert n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and mark == bool(re.search("<[PSM]>", text))
        for k, (s, u) in enumerate(zip(state, before)):
            assert (s, u) == walked(raw[: edges[k]], 0)[:2]
        for k, m in enumerate(re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)):
            assert M.place(raw, edges, state, before, k) == len(text[: m.start()].encode())
        at = [tuple(a[i : i + 1] for a in f) for i in range(3)] if len(edges) > 3 else []
        if at:
            left, right = M.compose(M.compose(at[0], at[1]), at[2]), M.compose(at[0], M.compose(at[1], at[2]))
            assert all((x == y).all() for x, y in zip(left, right))


def rows_of_all_kinds():
    r = random.Random(5)
    texts = [None, "", "word", "a<P>b", "x<", "P>y", "<S", ">", "é", "日本語 text", "\U0001f600\U0001f600ab", "\n\t \r", "<<P>>", "a" * 5000, "<p> <s>"]
    texts += [pieces(r, "abcXYZ<>PSMé日. \n", 80) for _ in range(300)]
    texts += ["one two, three. " * 20_000, "é日" * 40_000 + "<M>", "q" * 70_000 + "." + "z" * 70_000, "<P" + "P" * 70_000]
    return [(i, t, "kept", 7) for i, t in enumerate(texts)] + [(None, "some text here", "kept", 7), (3, "a<P>b", "kept", 7)] * 2


def test_against_plain_code(spark):
    """In place and with texts dealt out in stretches; repeated rows, nulls, names that clash."""
    rows = rows_of_all_kinds()
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, output int")
    want = sorted((str(d), *map(str, plain(d, t))) for d, t, _, _ in rows)
    for stretch, giant in ((M.STRETCH, M.GIANT), (7, 20), (1, 0)):
        some = docs if stretch > 1 else docs.where(F.length("text") < 1000)
        out = M.transformed(some.repartition(3), stretch=stretch, giant=giant)
        assert set(out.columns) == {"doc_id", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"}
        found = out.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
        assert {r["a.b"] for r in found} == {"kept"}
        if stretch > 1:
            assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in found) == want
        texts = {(d, t or "") for d, t, _, _ in rows}
        assert all((r.doc_id, r.back) in texts for r in found)


def test_percentages(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words, and more").alias("text"))
    forms = {r.form: r["count"] for r in M.transformed(docs).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 400) < 80 and abs(forms["spm"] - 720) < 100
    forms = {r.form for r in M.transformed(docs, percent=100, spm_percent=0).select("form").distinct().collect()}
    assert forms == {"psm"}


def test_empty_table(spark):
    assert M.transformed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
