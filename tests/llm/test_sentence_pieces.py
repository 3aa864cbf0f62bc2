import math
import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from tidelane.llm import sentence_pieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return S.pieces(PATH)


def all_of(model, text):
    """Every segmentation of a whole text, without units: (score, ids)."""
    s = S.MARK + text.replace(S.MARK, S.LITERAL).replace(" ", S.MARK) if text else ""
    out = []

    def walk(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        for j, piece, value in model._edges(s, i):
            walk(j, score + value, ids + ([piece] if piece >= 0 else model._spelled(s[i])))

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


TEXTS = ["the cats", "a  b", " a", "ab\ncd", "é▁x", "ba ab", "日x\n", "\n", "  ", "in on it"]


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_n_best_are_the_best_of_all(model, n):
    got = list(model.encode(pa.array(TEXTS), n))
    for text, (best, score, listed) in zip(TEXTS, got):
        every = all_of(model, text)
        assert [s for s, _ in listed] == pytest.approx([s for s, _ in every[:n]], abs=1e-6), text
        assert listed[0] == (score, best)
        values = {}
        for s, ids in every:
            values.setdefault(tuple(ids), s)
        codes = [tuple(memoryview(ids).cast(model.code)) for _, ids in listed]
        assert len(set(codes)) == len(codes)
        for (s, _), ids in zip(listed, codes):
            assert values[ids] == pytest.approx(s, abs=1e-6)


def test_longer_texts_agree_with_one_lattice(model):
    r = random.Random(2)
    for _ in range(25):
        text = "".join(r.choice(["the", "in", "er", "ou", " ", " ", "\n", "é", ".", "ß"]) for _ in range(r.randint(5, 30)))
        whole = S.MARK + text.replace(" ", S.MARK)
        want = [s for s, _ in model.n_best(whole, 5)]
        (_, _, listed), = model.encode(pa.array([text]), 5)
        assert [s for s, _ in listed] == pytest.approx(want, abs=1e-3), text


def test_round_trip_and_odd_rows(spark):
    texts = [None, "", *TEXTS, "\x00 a", "\U0001f600 ok", "x" * 30000, "tab\there ▁▁ end ", "word " * 20000]
    rows = [(i, t, 1, "x", 2.0) for i, t in enumerate(texts)] * 2 + [(None, "a", 1, "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_best string, score double")
    back = S.decoded(S.encoded(df, PATH, 3), PATH).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.text == ("a" if r.doc_id is None else texts[r.doc_id] or "")
        assert r.n_best[0].ids == r.ids and r.n_ids * 2 == len(r.ids)
    assert all(r.same for r in S.digest(df, PATH).collect())
    assert S.digest(df.limit(0), PATH).count() == 0


def test_ranks_of_merges_become_log_probabilities(model):
    assert sum(math.exp(s) for _, s in model.pieces.values()) == pytest.approx(1, abs=1e-6)
    # Merges 2 and 10 of this model.
    assert math.exp(model.pieces[S.MARK + "t"][1] - model.pieces["en"][1]) == pytest.approx(11 / 3)
    # Words mostly stay whole, nearly as with the library's own merges.
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = "the cats sat on it and the people of the world said that they would come back"
    (ids, _, _), = model.encode(pa.array([text]), 1)
    assert len(ids) // 2 <= 1.2 * len(library.encode(text))


@pytest.mark.parametrize("text", ["aaa aaaa aaaaa", "ababab", "  aaa\n\naaa", "xxxxxxxxxxxx", "ß" * 30])
def test_ties_give_distinct_segmentations(model, text):
    (best, score, listed), = model.encode(pa.array([text]), 6)
    assert listed[0] == (score, best)
    assert len({ids for _, ids in listed}) == len(listed)
    assert [s for s, _ in listed] == sorted((s for s, _ in listed), reverse=True)
    want = [s for s, _ in model.n_best(S.MARK + text.replace(" ", S.MARK), 6)]
    assert [s for s, _ in listed] == pytest.approx(want, abs=1e-6)


def test_a_small_memo_gives_the_same(model):
    small = S.Pieces(PATH)
    small.units.limit = small.lists.limit = 5
    texts = pa.array(TEXTS + ["one two three", "two four  five", "one six"])
    for part in (texts, texts[3:], texts[:9]):
        assert list(small.encode(part, 3)) == list(model.encode(part, 3))


def test_pieces_without_a_score_count_as_the_rarest():
    """The mark alone is such a piece: a word that begins with no joined piece costs no more than rare pieces do."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ranks = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    least = min(s for s in ranks.values() if s > -1e8)
    assert ranks["▁"] < -1e8
    ranks = {p: max(s, least) for p, s in ranks.items()}
    total = math.log(sum(1 / (1 - s) for s in ranks.values()))
    known = {p: -math.log(1 - s) - total for p, s in ranks.items()}

    def best(unit):
        scores = [0.0] + [-math.inf] * len(unit)
        for j in range(1, len(unit) + 1):
            scores[j] = max(scores[i] + known[unit[i:j]] for i in range(j) if unit[i:j] in known)
        return scores[-1]

    words = ["çréoi", "êeau,", "ç", "éèonç", "über", "ß"]
    p = S.Pieces(PATH)
    for word, (_, score, _) in zip(words, p.encode(pa.array(words), 1)):
        assert abs(score - best(f"▁{word}")) < 1e-4
    texts = [w * 3 + " " + w for w in words] + ["a  b", "   ", "çà et là", "日本 한국 ça"]
    assert all(score > -100 * len(t) for t, (_, score, _) in zip(texts, p.encode(pa.array(texts), 1)))
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").combine_chunks().cast(pa.string())
    assert all(score > -100 * len(t.as_py()) for t, (_, score, _) in zip(table, p.encode(table, 1)))
