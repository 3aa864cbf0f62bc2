import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import language as L

SMALL = "/root/testdata/sf0.01"


def plain_counts(text):
    """N-grams one by one."""
    out = np.zeros(L.DIMS)
    shown = "".join(c if c.isalpha() else "\0" for c in "\0" + text.lower() + "\0")
    while "\0\0" in shown:
        shown = shown.replace("\0\0", "\0")
    cp = [ord(c) for c in shown]
    m = 1 << 32
    for i in range(1, len(cp)):
        b, c = (0 if i == 0 else cp[i - 1]), cp[i]
        out[(b * 0x9E3779B1 + c * 0x85EBCA6B) % m >> 19] += 1
        if i >= 2 and b:
            out[(b * 0x9E3779B1 + c * 0xC2B2AE35 + cp[i - 2] * 0x27D4EB2F) % m >> 19] += 1
    return out if any(c.isalpha() for c in text) else np.zeros(L.DIMS)


def test_counts_match_one_by_one():
    texts = ["Ab c", "", "1 2", "x", "Éa—b ", " \U00010400 z", "a" * 1000, "tail."]
    for batch in (texts, texts[1:], texts[::-1]):
        x, n = L.counts(batch)
        for row, k, t in zip(x, n, batch):
            assert k == sum(c.isalpha() for c in t.lower())
            assert (row == plain_counts(t)).all(), t


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the documents table")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    out = L.op4_language(spark, SMALL).join(docs, "doc_id")
    right, rejected, n = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97 and rejected < 0.02 * n


def test_odd_rows(spark):
    rows = [(i, t, lang, 1.5, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en", 1.0, ""), (101, "", None, 1.0, ""), (102, "123 !", "de", 1.0, ""), (None, "the cat " * 20000, None, 1.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected string")
    out = {(r.doc_id): r for r in L.predicted(df, L.fit(df)).collect()}
    assert len(out) == len(rows)
    assert all(out[i].lang_pred == L.UND and out[i].score == 0 and out[i].rejected for i in (100, 101, 102))
    assert out[None].lang_pred == "en" and out[0].lang_pred == "en" and out[1].lang_pred == "de"
    none = L.predicted(df, L.fit(df.where("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {L.UND}
    assert L.predicted(df.limit(0), L.fit(df.limit(0))).count() == 0


def test_far_text_is_rejected(spark):
    rows = [(i, ("the cat and the dog sat on this mat with that hat " * 4)[i % 7 :], "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    odd = spark.createDataFrame([(1, "zzqx kwvj xxyq jjkz qqwx vvkz zzxy wqkj " * 5, None)], df.schema)
    assert L.predicted(odd, model).first().rejected
    assert not any(r.rejected for r in L.predicted(df, model).collect())


def test_far_texts_of_rare_lengths_are_rejected(spark):
    r = random.Random(5)
    words = "the cat and dog sat on this mat with that hat near our old house while rain fell over every green field".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    far = lambda n: " ".join("".join(r.choice("zqxjkvw") for _ in range(4)) for _ in range(n))
    odd = [(text(5000), False), (text(3), False), (far(5000), True), (far(20), True), (far(3), True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(odd)], "doc_id long, text string")
    for rows in (60, 6):  # with 6 no octave has enough texts
        labelled = spark.createDataFrame([(text(30), "en") for _ in range(rows)], "text string, lang string")
        out = {x.doc_id: x.rejected for x in L.predicted(df, L.fit(labelled)).collect()}
        assert [out[i] for i in range(len(odd))] == [far for _, far in odd]


def test_copies_leave_room_for_other_texts(spark):
    r = random.Random(6)
    make = lambda words: " ".join(r.choice(words.split()) for _ in range(30))
    en, de = "the cat and dog sat on this mat with that hat", "der hund und die katze auf dem alten dach mit hut"
    for k in range(2):
        rows = [(make(de), "de")] * 2990 + [(make(de), "de") for _ in range(10)] + [(make(en), "en") for _ in range(500)]
        model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
        assert (model.owner == model.languages.index("de")).sum() == L.CLUSTERS
        odd = spark.createDataFrame([(make(de),), (make(en),)], "text string")
        assert [(x.lang_pred, x.rejected) for x in L.predicted(odd, model).collect()] == [("de", False), ("en", False)]


def test_predictions_match_plain_code(spark):
    """Nearest centroid by cosine, score and rejection, text by text, from the model's numbers."""
    r = random.Random(8)
    vocabularies = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60)] for lang, letters in [("aa", "etaoin"), ("bb", "shrdlu"), ("cc", "cmfgyp")]}
    make = lambda lang, n: " ".join(r.choice(vocabularies[lang]) for _ in range(n))
    rows = [(i, make(lang, r.randint(3, 90)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [make(lang, n) for lang in vocabularies for n in (1, 4, 50, 400)] + ["жизнь и мир", "qqq zzz xxx " * 50, "", "12", "е", make("aa", 30000)]
    out = L.predicted(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()
    assert len(model.centroids) == 12
    for x in out:
        counts = plain_counts(tests[x.doc_id])
        weights = [(1 + np.log(c)) * idf if c else 0.0 for c, idf in zip(counts, model.idf)]
        length = sum(w * w for w in weights) ** 0.5
        if not length:
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0, True)
            continue
        cosines = [sum(w * c for w, c in zip(weights, center) if w) / length for center in model.centroids]
        best = max(range(12), key=lambda j: cosines[j])
        assert x.score == pytest.approx(max(cosines[best], 0), abs=1e-5)
        assert cosines[model.owner.tolist().index(model.languages.index(x.lang_pred))] <= cosines[best] + 1e-6
        assert max(c for c, o in zip(cosines, model.owner) if model.languages[o] == x.lang_pred) == pytest.approx(cosines[best], abs=1e-5)
        letters = sum(c.isalpha() for c in tests[x.doc_id])
        least = model.nearest[letters.bit_length() - 1]
        assert x.rejected == (x.score < least) or abs(x.score - least) < 1e-5
    verdict = {x.doc_id: x.rejected for x in out}
    assert verdict[12] and verdict[13] and not any(verdict[i] for i in (3, 7, 11, 17))
