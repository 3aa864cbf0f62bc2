import os
import random

import pytest

import corpus_pipeline as C
from tidelane.llm import secrets
from tests_llm_shared import brute_components

SMALL = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the documents table")
def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in C.STAGES:
        before = docs.collect()
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name != "sentence_pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "language":
            assert len(after) > 0.95 * len(before)
        if name == "near_duplicates":
            assert ids == {c for _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80)}
        if name == "secrets":
            assert ids == {r.doc_id for r in before if not secrets.spans(r.text)}
        if name == "mix":
            assert max(sum(r.doc_id == i for r in after) for i in ids) <= 3
        if name == "sentence_pieces":
            text = {r.doc_id: r.text for r in before}
            assert len(after) == len(before) and all(r.text == text[r.doc_id] and r.n_ids * 2 == len(r.ids) for r in after)


def test_odd_rows_pass_every_stage(spark):
    r = random.Random(1)
    make = lambda: " ".join("".join(r.choice("etaoin") for _ in range(4)) for _ in range(80))
    rows = [(i, make(), "en", "s", 1) for i in range(30)] + [(5, "other " + make(), None, None, None)]
    rows += [rows[3]] * 3 + [(None, make(), None, None, None), (None, None, None, None, None), (40, "", "en", "s", 0)]
    wide = spark.createDataFrame([(*x, 1, "x") for x in rows], KIND + ", size int, rejected string")
    for df in (wide, wide.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, df, "").collect()
            assert len(out) <= 3 * len(rows)
            if name == "near_duplicates" and out:
                ids = [x.doc_id for x in out]
                assert ids.count(None) == 2 and len(ids) == len(set(ids)) + 1 and set(range(30)) <= set(ids)


def test_any_further_columns_pass(spark):
    """A map column, names that operators use themselves, repeated ids, a very long text."""
    r = random.Random(2)
    make = lambda n: " ".join("".join(r.choice("etaoin") for _ in range(4)) for _ in range(n))
    names = ["gone", "twice", "row", "order", "id", "blob", "rejected", "score", "size", "copies", "doc", "key", "_bad", "ids", "spans", "a.b"]
    rows = [(i, make(80), "en", "s", 1) for i in range(20)] + [(99, make(30000), "en", "s", 1)]
    rows += [(3, "second " + make(60), "en", "t", 2), rows[4], (77, make(50) + " token=abcdefgh", "en", "s", 1)]
    kind = KIND + ", m map<string,int>, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*x, {"a": x[0]}, *["v"] * len(names)) for x in rows], kind)
    kept = []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(x[n] == "v" for x in found for n in names) and all(x.m == {"a": x.doc_id} for x in found), name
        kept.append({x.doc_id for x in found})
        if name == "near_duplicates":
            assert len(found) == len(kept[-1]) == 22
    assert kept[2] == kept[1] - {77}
    last = C.STAGES[-1][1](spark, docs, "").collect()
    assert all(x.n_best[0].ids == x.ids and len({y.ids for y in x.n_best}) == 4 for x in last)


def test_the_secrets_stage_goes_on_with_a_ledger(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefgh", "en", "s", 1), (2, "nothing", "en", "s", 1)], KIND)
    path = str(tmp_path / "ledger")
    for _ in range(2):
        assert [x.doc_id for x in C.without_secrets(spark, docs, "", path).collect()] == [2]
        assert secrets.ledger(spark, path).count() == 2
