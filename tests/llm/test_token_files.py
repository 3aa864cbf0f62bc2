import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidelane.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BITS = ["a", "The", " ", "  ", "\n", "é", "ß", "Ž", "日", "'s", "'", "12", ".", ",", "...", "!", "&&&", "_", "́", "\t", "\xa0"]
BITS += ["​", "<|endoftext|>", "<|", "Ж", "\U0001f600", "\x00", "ª", "ɐ", "Ā", "\r", " word", " other,"]


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoding_is_the_librarys_default():
    r = random.Random(5)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(8000)]
    texts += [None, "", "a<|endoftext|>b", "<|endoftext|>", "x" * 5000, "the cat, " * 30000]
    ids, lengths = T.encoder(PATH).encode(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, lengths.tolist()):
        assert ids[at : at + n].tolist() == plain(text), text[:50]
        at += n
    assert 50256 in plain("<|endoftext|>")


def test_a_small_memo_gives_the_same_ids():
    texts = pa.array([f"w{i} word{chr(97 + i % 26)}x again{chr(97 + i % 7)}" for i in range(300)] * 2)
    small = T.Encoder(PATH)
    small.chunks.limit = 20
    for part in (texts[:250], texts[250:], texts[100:400]):
        assert small.encode(part)[0].tolist() == T.encoder(PATH).encode(part)[0].tolist()


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (511, 3), (512, 70000), (513, 9), (5000, 40), (20000, 60000)])
def test_matrix_against_a_scan(n, top):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n).astype(np.uint32 if top > 1 << 16 else np.uint16)
    planes = max(1, (top - 1).bit_length())
    doc_ids, starts = ([7, None], [0, n // 2]) if n else ([], [])
    m, back, at = T.unpack(T.pack(ids, doc_ids, starts, planes))
    assert back == doc_ids and at.tolist() == starts
    assert m.decode().tolist() == ids.tolist()
    for i in [*r.integers(0, n, 40).tolist(), 0, n - 1] if n else []:
        assert m.access(i) == ids[i]
    for token in {*r.integers(0, top, 10).tolist(), *ids[:3].tolist(), top + 1, 1 << 20}:
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where) and m.occurrences(token).tolist() == where.tolist()
        for i in (0, n // 3, n, n + 5):
            assert m.rank(token, i) == int((where < i).sum())
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
            assert m.select(token, k) == where[k]
        with pytest.raises(IndexError):
            m.select(token, len(where))
    with pytest.raises(IndexError):
        m.access(n)


def test_shards_are_read_back(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(BITS) for _ in range(r.randint(0, 30))), 1, 2) for i in range(400)]
    rows += [(7, "again", 1, 2), (7, "again", 1, 2), (7, "b", 1, 2), (None, "no id", 1, 2), (500, None, 1, 2), (-3, "", 1, 2)]
    rows += [(1000, "long text, " * 90000, 1, 2)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, n_tokens int")
    path = str(tmp_path / "shards")
    T.write_shards(df, path, PATH, shard_tokens=3000)
    got = T.read_shards(spark, path).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None] + sorted(x[0] for x in rows if x[0] is not None)
    want = {}
    for doc_id, text, *_ in rows:
        ids = plain(text)
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for x in got:
        assert x.start == start
        want[x.doc_id].remove((x.n_tokens, x.ids_crc32))
        start += x.n_tokens
    assert len({(x.part, x.seq) for x in got}) > 3
    # Counts and places of tokens over all shards, from the bit-planes.
    tokens = [0, 50256, plain("The")[0], 49999]
    counted = {t: sum(x.n for x in T.count_tokens(spark, path, tokens).where(f"token = {t}").collect()) for t in tokens}
    assert counted == {t: sum(plain(text).count(t) for _, text, *_ in rows) for t in tokens}
    places = sorted((x.doc_id or 0, x.place) for x in T.occurrences(spark, path, 50256).collect())
    assert places == sorted((d or 0, i) for d, text, *_ in rows for i, t in enumerate(plain(text)) if t == 50256)


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    T.write_shards(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert T.read_shards(spark, path).count() == 0
    assert T.count_tokens(spark, path, [0]).count() == 0 and T.occurrences(spark, path, 0).count() == 0
