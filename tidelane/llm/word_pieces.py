"""Operator 3: lengths of greedy word-piece encodings by a linear longest-match automaton.

The vocabulary's trie gets, for each node, a failure link and the number of pieces that are
popped on following it; a word then goes through the automaton character by character, each step
adding the popped counts on the way, and no piece is built. A word whose walk fails has no
encoding and counts as one unknown piece. Texts are sums over their words: each distinct word of a
batch walks once, and the counts of recent words are remembered.

The vocabulary comes from a SentencePiece model file: pieces that begin with the space mark are
word beginnings, the others are continuations; control, unknown and byte pieces are left out. The
path is a parameter and names a file on every executor.

Nulls: a null text has no words. Repeated rows are repeated in the result; an empty table gives
an empty result; other columns are kept, but those named like a result column are replaced.
Words of any length are walked whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelane.llm._shared import Memo, ship, slices, table, word_codes

MARK = "▁"


class LongestMatch:
    """Counts the pieces of greedy longest-match segmentations.

    Node 0 is the root of word beginnings, node 1 that of continuations.
    """

    def __init__(self, beginnings: list[str], continuations: list[str]):
        self.step: list[dict[str, int]] = [{}, {}]
        self.piece = [False, False]
        for root, pieces in ((0, beginnings), (1, continuations)):
            for piece in pieces:
                at = root
                for c in piece:
                    at = self.step[at].setdefault(c, len(self.step))
                    if at == len(self.step):
                        self.step.append({})
                        self.piece.append(False)
                self.piece[at] |= at != root
        # Level by level: where the walk goes on when a character has no edge, and the pieces that pops.
        self.link = [-1] * len(self.step)
        self.popped = [0] * len(self.step)
        level = [0, 1]
        while level:
            below = []
            for at in level:
                for c, to in self.step[at].items():
                    below.append(to)
                    if self.piece[to]:
                        self.link[to], self.popped[to] = 1, 1
                        continue
                    z, n = self.link[at], self.popped[at]
                    while z >= 0 and c not in self.step[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[to], self.popped[to] = self.step[z][c], n
            level = below

    def count(self, word: str) -> int:
        """Number of pieces of word; 0 if it has no segmentation."""
        step, link, popped = self.step, self.link, self.popped
        at, n = 0, 0
        for c in word:
            to = step[at].get(c, -1)
            while to < 0:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 0
                to = step[at].get(c, -1)
            at = to
        while at > 1:
            n += popped[at]
            at = link[at]
        return n if at == 1 else 0


def pieces(model: str) -> tuple[list[str], list[str]]:
    """Word beginnings and continuations of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    known = [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]
    first = [p[1:] for p in known if p.startswith(MARK) and p[1:] and MARK not in p[1:]]
    return first, [p for p in known if MARK not in p]


_counters: dict[str, Memo] = {}


def counter(model: str) -> Memo:
    if model not in _counters:
        _counters[model] = Memo(LongestMatch(*pieces(model)).count, 300_000)
    return _counters[model]


def piece_counts(docs: DataFrame, model: str) -> DataFrame:
    """docs (text, other columns) with n_words, n_pieces (unknown words count 1) and n_unknown, without text."""
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_words", "n_pieces", "n_unknown")]
    docs = docs.select(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model)
        rest = [c for c in own if c != "text"]
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 24):
                codes, words, n_words = word_codes(batch.column("text").slice(a, b - a))
                each = np.fromiter(map(of.__getitem__, words.to_pylist()), np.int64, len(words))
                doc = np.repeat(np.arange(b - a), n_words)
                sums = np.bincount(doc, np.maximum(each, 1)[codes], b - a).astype(np.int64)
                unknown = np.bincount(doc[each[codes] == 0], minlength=b - a)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in rest], *map(pa.array, (n_words, sums, unknown))],
                    names=[*rest, "n_words", "n_pieces", "n_unknown"],
                )

    kind = StructType([f for f in docs.schema if f.name != "text"])
    for name in ("n_words", "n_pieces", "n_unknown"):
        kind.add(name, "long")
    return docs.mapInArrow(run, kind)


def op3_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece lengths of all documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
