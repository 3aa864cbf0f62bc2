"""Operator 1: SentencePiece encoding with N-best segmentations, and decoding.

A segmentation's score is the sum of its pieces' scores in the model; the best one is found by a
forward Viterbi pass over the lattice of pieces. The forward scores are exact completions for a
search that runs backwards from the end, so A* takes the N best segmentations off its queue in
order. No piece reaches across the start of a run of spaces, a line feed or a literal U+2581, so
a text's lattice is a chain of small ones (units). Each distinct unit of a batch is passed once,
both ways, which also gives the exact loss of its second best segmentation; the N best of the
text deviate only in the N - 1 units of least loss (any other choice loses no less), so A* runs in
those alone and their lists are merged.

A unigram model's scores are log-probabilities and are taken as they are. A merge model has ranks of
merges for scores, whose sum would favour early merges over whole words; there the piece of rank r
counts as log(1 / (r + 1)) less the logarithm of the sum of these weights (Zipf's law over the ranks;
nothing is trained). A piece without a score of its own (below -1e8) has that of the rarest. Scores are
rounded to steps of 2**-20.

Text is taken as it is (no normalisation), with the model's space mark for spaces and one before
the text. A character without a piece is spelled in byte pieces, at the least piece score less 10,
and so is a literal U+2581. Decoding gives back every text exactly.

The models' path is a parameter and names a file on every executor. Ids are returned as binary,
little-endian, two bytes each where the vocabulary allows, else four.

Nulls: a null text is the empty text: no ids, score 0, that one segmentation. Equal scores keep the
order of the search, which depends on the text only. Repeated rows are repeated in the result; an
empty table gives an empty result; columns named like a result column are replaced. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidelane.llm._shared import Memo, give_back, ship, slices, spread, table, u32

MARK = "▁"
#: A unit that stands for a literal mark in the text (no text of an Arrow string holds it).
LITERAL = "\udc81"
UNKNOWN_PENALTY = 10.0
N_BEST = 4
#: Units of characters below COMMON and of at most WIDE characters are passed many at a time.
COMMON, WIDE = 0x180, 40
_UNITS = re.compile(f"{MARK}+[^{MARK}\n{LITERAL}]*|[^{MARK}\n{LITERAL}]+|\n|{LITERAL}")
#: Texts whose units aren't simply those between single spaces and line feeds.
ODD = rf"\x00|  |^ |{MARK}"


class Spelling:
    """What each id of a model stands for, as bytes: all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = np.dtype("<u2") if sp.get_piece_size() <= 1 << 16 else np.dtype("<u4")
        shown = [self._shown(sp, i) for i in range(sp.get_piece_size())]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_sizes = np.array([len(s) for s in shown])

    @staticmethod
    def _shown(sp, i: int) -> bytes:
        if sp.is_byte(i):
            return bytes([int(sp.id_to_piece(i)[3:5], 16)])
        if sp.is_unknown(i):
            return " ⁇ ".encode()
        return b"" if sp.is_control(i) or sp.is_unused(i) else sp.id_to_piece(i).replace(MARK, " ").encode()

    def decode(self, codes: pa.Array) -> pa.Array:
        """Texts of binary ids."""
        raw = [c.as_buffer() if c.is_valid else b"" for c in codes]
        sizes = np.array([len(r) for r in raw], np.int64) // self.kind.itemsize
        ids = np.frombuffer(b"".join(raw), self.kind).astype(np.int64)
        shown = self.shown[spread(self.shown_sizes, ids)] if len(ids) else np.zeros(0, np.uint8)
        at = np.concatenate([[0], np.cumsum(self.shown_sizes[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        # The mark before the text is not part of it.
        flat = shown.tobytes()
        out = [flat[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.array(out, pa.string())


def _entry(unit: tuple[bytes, float, float]) -> bytes:
    ids, score, gap = unit
    return struct.pack("<dd", score, gap) + ids


def _entries(found: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Ids, scores and losses of entries."""
    numbers = np.frombuffer(b"".join([f[:16] for f in found]), "<f8").reshape(-1, 2)
    return [f[16:] for f in found], numbers[:, 0], numbers[:, 1]


class Pieces:
    """A model's lattice, by units."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.kind, self.code = (np.dtype("<u2"), "H") if size <= 1 << 16 else (np.dtype("<u4"), "I")
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.unknown_id = sp.unk_id()
        for i in range(size):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if "\n" in piece or MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} crosses the bounds of units")
                self.pieces[piece] = (i, score)
        # Pieces that no merge makes have a score of -1e9 (the mark alone, runs of it); they count as the rarest one.
        scores = sorted((s for _, s in self.pieces.values() if s > -1e8), reverse=True)
        self.pieces = {q: (i, max(s, scores[-1])) for q, (i, s) in self.pieces.items()} if scores else self.pieces
        if len(set(scores)) == len(scores) > 1 and all(s.is_integer() for s in scores):
            # Ranks of merges: a sum of them means nothing, so Zipf's law turns them to log-probabilities.
            total = math.log(sum(1 / (1 - s) for _, s in self.pieces.values()))
            self.pieces = {q: (i, -math.log(1 - s) - total) for q, (i, s) in self.pieces.items()}
            scores = [-math.log(1 - scores[-1]) - total]
        # In steps of 2**-20 sums are exact in any order, so ties are ties for the search.
        self.pieces = {q: (i, round(s * 2**20) / 2**20) for q, (i, s) in self.pieces.items()}
        self.unknown = round((min(scores[-1:], default=0.0) - UNKNOWN_PENALTY) * 2**20) / 2**20
        self.longest = max(map(len, self.pieces), default=1)
        self._tables()
        # A unit's entry is one run of bytes: its score, the loss of its second best, its ids.
        self.units = Memo(lambda unit: _entry(self._unit(unit)), 150_000)
        self.lists = Memo(lambda key: self.n_best(*key), 20_000)

    def _edges(self, unit: str, i: int) -> list[tuple[int, int, float]]:
        """(end, id, score) of the pieces that start at i; id -1: the character in bytes."""
        out, alone = [], False
        for j in range(i + 1, min(len(unit), i + self.longest) + 1):
            if found := self.pieces.get(unit[i:j]):
                out.append((j, *found))
                alone |= j == i + 1
        if not alone:
            out.append((i + 1, -1, self.unknown))
        return out

    def _spelled(self, c: str) -> list[int]:
        raw = MARK.encode() if c == LITERAL else c.encode()
        return [self.bytes.get(b, self.unknown_id) for b in raw] if self.bytes else [self.unknown_id]

    def _ids(self, unit: str, path: list[tuple[int, int]]) -> bytes:
        """path: (start, id) of the pieces in order."""
        out: list[int] = []
        for start, piece in path:
            if piece >= 0:
                out.append(piece)
            else:
                out += self._spelled(unit[start])
        return array(self.code, out).tobytes()

    def _unit(self, unit: str) -> tuple[bytes, float, float]:
        """Ids and score of the best segmentation, and what the second best loses (inf: there is none)."""
        n = len(unit)
        edges = [self._edges(unit, i) for i in range(n)]
        ahead: list[float] = [0.0] + [-np.inf] * n
        came: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for i in range(n):
            at = ahead[i]
            for j, piece, score in edges[i]:
                if at + score > ahead[j]:
                    ahead[j] = at + score
                    came[j] = (i, piece)
        path, j = [], n
        while j:
            path.append(came[j])
            j = came[j][0]
        path.reverse()
        best = set(path)
        rest: list[float] = [-np.inf] * n + [0.0]
        second = -np.inf
        for i in range(n - 1, -1, -1):
            top = -np.inf
            for j, piece, score in edges[i]:
                value = score + rest[j]
                if value > top:
                    top = value
                if (i, piece) not in best and ahead[i] + value > second:
                    second = ahead[i] + value
            rest[i] = top
        return self._ids(unit, path), ahead[n], ahead[n] - second

    def _tables(self) -> None:
        """The trie of the pieces of frequent characters as arrays: next node, piece and score by node."""
        own = [p for p in self.pieces if max(p.replace(MARK, "") or " ") < chr(COMMON)]
        chars = sorted({c for p in own for c in p} | {MARK})
        self.place = np.full(ord(MARK) + 1, -1, np.int32)
        self.place[[ord(c) for c in chars]] = np.arange(len(chars))
        node = {"": 0}
        for p in own:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        self.next = np.zeros((len(node), len(chars)), np.uint16 if len(node) <= 1 << 16 else np.int32)
        self.piece, self.score = np.full(len(node), -1, np.int32), np.zeros(len(node))
        for p, n in node.items():
            if p:
                self.next[node[p[:-1]], self.place[ord(p[-1])]] = n
            if p in self.pieces:
                self.piece[n], self.score[n] = self.pieces[p]

    def _all_units(self, units: list[str]) -> list[bytes]:
        """Entries of many units, column by column for those of frequent characters and moderate length."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(units)), sizes)
        code = np.where(points <= ord(MARK), self.place[np.minimum(points, ord(MARK))], -1)
        plain = (sizes > 0) & (sizes <= WIDE)
        plain[row[code < 0]] = False
        mine = np.flatnonzero(plain)
        kept, ends = code[plain[row]], np.concatenate([[0], np.cumsum(sizes[mine])])
        out: list = [None] * len(units)
        for start in range(0, len(mine), 1 << 13):
            own = mine[start : start + (1 << 13)]
            self._columns(units, own, sizes[own], kept[ends[start] : ends[start + len(own)]], out)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = _entry(self._unit(units[i]))
        return out

    def _columns(self, units: list[str], own: np.ndarray, sizes: np.ndarray, code: np.ndarray, out: list) -> None:
        """_unit() of the units own, a position of all of them at a time; tables are (position, unit)."""
        n, width = len(own), int(sizes.max())
        every = np.arange(n)
        c = np.zeros((n, width), np.int32)
        c[np.arange(width) < sizes[:, None]] = code
        c = np.ascontiguousarray(c.T)
        ahead = np.full((width + 1, n), -np.inf)
        ahead[0] = 0
        came = np.zeros((width + 1, n), np.int32)
        by = np.full((width + 1, n), -1, np.int32)
        edges = []
        for i in range(width):
            rows = np.flatnonzero(sizes > i)
            node = np.zeros(len(rows), np.int32)
            for j in range(i + 1, width + 1):
                node = self.next[node, c[j - 1].take(rows)]
                alive = (node > 0) & (sizes.take(rows) >= j)
                piece, score = self.piece.take(node), self.score.take(node)
                piece[~alive] = -1
                if j == i + 1:
                    r, score = rows, np.where(piece >= 0, score, self.unknown)
                else:
                    found = np.flatnonzero(piece >= 0)
                    r, piece, score = rows.take(found), piece.take(found), score.take(found)
                if len(r):
                    edges.append((i, j, r, score))
                    value = ahead[i].take(r) + score
                    better = np.flatnonzero(value > ahead[j].take(r))
                    b = r.take(better)
                    ahead[j][b], came[j][b], by[j][b] = value.take(better), i, piece.take(better)
                kept = np.flatnonzero(alive)
                if not len(kept):
                    break
                rows, node = rows.take(kept), node.take(kept)
        # Back along the best paths.
        ids = np.zeros((n, width), np.int32)
        taken = np.full((width + 1, n), -1, np.int32)
        steps = np.zeros(n, np.int64)
        at, live = sizes.copy(), every
        while len(live):
            end = at[live]
            before = came[end, live]
            steps[live] += 1
            ids[live, width - steps[live]] = by[end, live]
            taken[before, live] = end
            at[live] = before
            live = live[before > 0]
        rest = np.full((width + 1, n), -np.inf)
        rest[sizes, every] = 0
        second = np.full(n, -np.inf)
        for i, j, r, score in reversed(edges):
            value = score + rest[j].take(r)
            rest[i][r] = np.maximum(rest[i].take(r), value)
            other = np.flatnonzero(taken[i].take(r) != j)
            o = r.take(other)
            second[o] = np.maximum(second.take(o), (ahead[i].take(r) + value).take(other))
        used = np.arange(width) >= width - steps[:, None]
        spelled = ((ids < 0) & used).any(1)
        flat = ids[used].astype(self.kind).tobytes()
        best = ahead[sizes, every]
        head = np.stack([best, best - second], 1).astype("<f8").tobytes()
        at = 0
        for k, h, after in zip(own.tolist(), range(0, 16 * n, 16), (np.cumsum(steps) * self.kind.itemsize).tolist()):
            out[k] = head[h : h + 16] + flat[at:after]
            at = after
        for k in own[spelled].tolist():
            out[k] = _entry(self._unit(units[k]))

    def n_best(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """Up to n segmentations by falling score: A* from the end, the forward scores as heuristic."""
        size = len(unit)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        ahead = [0.0] + [-np.inf] * size
        for i in range(size):
            for j, piece, score in self._edges(unit, i):
                into[j].append((i, piece, score))
                ahead[j] = max(ahead[j], ahead[i] + score)
        out: list[tuple[float, bytes]] = []
        # (minus the score of the best whole segmentation, position, order, score so far, pieces after);
        # of equal scores the one nearest the start goes first, else ties would all be opened.
        queue: list[tuple] = [(-ahead[size], size, 0, 0.0, None)]
        order = 1
        while queue and len(out) < n:
            _, at, _, so_far, after = heapq.heappop(queue)
            if not at:
                path = []
                while after:
                    path.append(after[0])
                    after = after[1]
                out.append((so_far, self._ids(unit, path)))
                continue
            for i, piece, score in into[at]:
                value = so_far + score
                heapq.heappush(queue, (-(value + ahead[i]), i, order, value, ((i, piece), after)))
                order += 1
        return out

    def split(self, text: str) -> list[str]:
        """Units of one text."""
        return _UNITS.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) if text else []

    def encode_all(self, texts: pa.Array, n_best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[float, bytes]]]]:
        """Best ids of all texts end to end, where each text's begin and end, their scores, and the
        n_best segmentations (score, ids) of each text."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        simple = pc.if_else(pc.or_(odd, pc.equal(texts, "")), "", pc.binary_join_element_wise(MARK, texts, ""))
        cut = pc.replace_substring(pc.replace_substring(simple, " ", "\0" + MARK), "\n", "\0\n\0")
        parts = pc.split_pattern(cut, "\0")
        edges = parts.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(strange := np.flatnonzero(odd.to_numpy(zero_copy_only=False))):
            # Such a text is one empty unit so far; its own units take that one's place.
            place = {u: i for i, u in enumerate(names)}
            runs, before, sizes = [], 0, np.diff(edges)
            for t in strange.tolist():
                own = [place.setdefault(u, len(place)) for u in self.split(texts[t].as_py())]
                runs += [codes[before : edges[t]], np.array(own, codes.dtype)]
                before, sizes[t] = edges[t + 1], len(own)
            codes = np.concatenate([*runs, codes[before:]])
            names, edges = list(place), np.concatenate([[0], np.cumsum(sizes)])
        table, scores, gaps = _entries(self.units.many(names, self._all_units))
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(table), self.kind)[spread(lengths, codes)]
        starts = np.concatenate([[0], np.cumsum(lengths[codes])])
        # Sums of each text's own run of units.
        totals = np.zeros(len(texts))
        full = np.flatnonzero(np.diff(edges))
        totals[full] = np.add.reduceat(scores[codes], edges[full]) if len(full) else 0
        ends = starts[edges]
        raw, width = memoryview(ids).cast("B") if len(ids) else b"", self.kind.itemsize
        listed, gap = [], gaps[codes]
        bounds, spans = edges.tolist(), (ends * width).tolist()
        for t, total in enumerate(totals.tolist()):
            a, b = bounds[t], bounds[t + 1]
            best = bytes(raw[spans[t] : spans[t + 1]])
            if n_best < 2:
                listed.append([(total, best)])
                continue
            own = gap[a:b]
            k = min(n_best - 1, b - a)
            spots = np.argpartition(own, k - 1)[:k] if 0 < k < b - a else range(k)
            # The text's segmentations, as choices at the spots: the n best sums over the spots so far.
            sums: list[tuple[float, tuple]] = [(0.0, ())]
            for spot in sorted(a + int(s) for s in spots if own[s] < np.inf):
                mine, choices = table[codes[spot]], self.lists[names[codes[spot]], n_best]
                # Of equally good ones the one in the best ids comes first.
                top = choices[0][0]
                choices = [(top, mine), *[c for c in choices if c[1] != mine][: n_best - 1]]
                joined = [(loss + top - s, (*picked, (spot, code))) for loss, picked in sums for s, code in choices]
                sums = heapq.nsmallest(n_best, joined, key=lambda x: x[0])
            out = [(total, best)]
            for loss, picked in sums[1:]:
                changed, at = [], spans[t]
                for spot, code in picked:
                    changed += [raw[at : int(starts[spot]) * width], code]
                    at = int(starts[spot + 1]) * width
                out.append((total - loss, b"".join([*changed, raw[at : spans[t + 1]]])))
            listed.append(out)
        return ids, ends, totals, listed

    def encode(self, texts: pa.Array, n_best: int) -> Iterator[tuple[bytes, float, list[tuple[float, bytes]]]]:
        """For each text the best ids, their score, and the n_best segmentations (score, ids)."""
        _, _, totals, listed = self.encode_all(texts, n_best)
        for total, found in zip(totals.tolist(), listed):
            yield found[0][1], total, found


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


_spellings: dict[str, Spelling] = {}


def spelling(path: str) -> Spelling:
    if path not in _spellings:
        _spellings[path] = Spelling(path)
    return _spellings[path]


_NEW = ("ids", "n_ids", "score", "n_best")
_N_BEST = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))


def encoded(docs: DataFrame, model: str, n_best: int = 1, decode: bool = False) -> DataFrame:
    """docs (text, other columns) with ids, n_ids, score and n_best (score, ids), best first.

    Without text, or, with decode, with the text that the ids decode to, made in the same pass.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in _NEW]
    docs = docs.select(*own)
    rest = [c for c in own if c != "text"]

    names = [*rest, *_NEW, *["text"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            # The model stays for the worker's next task; units and their lists go.
            pieces(model).units.forget()
            pieces(model).lists.forget()
            give_back()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, spelled = pieces(model), spelling(model)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                ids, ends, totals, listed = p.encode_all(part.column("text"), n_best)
                flat = [x for found in listed for x in found]
                each = pa.StructArray.from_arrays(
                    [pa.array([s for s, _ in flat], pa.float64()), pa.array([x for _, x in flat], pa.binary())],
                    fields=list(_N_BEST.value_type),
                )
                offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, listed), np.int64, len(listed)))])
                codes = pa.array([found[0][1] for found in listed], pa.binary())
                columns = [
                    *[part.column(c) for c in rest],
                    codes,
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array(totals),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each, type=_N_BEST),
                ]
                if decode:
                    columns.append(spelled.decode(codes))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = StructType([f for f in docs.schema if f.name != "text"])
    kind.add("ids", "binary").add("n_ids", "long").add("score", "double")
    kind.add("n_best", ArrayType(StructType().add("score", "double").add("ids", "binary")))
    return docs.mapInArrow(run, kind.add("text", "string") if decode else kind)


def decoded(rows: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """rows (ids, other columns) with the text of the ids (null: empty); a column named text is replaced."""
    ship(rows.sparkSession)
    own = [c for c in rows.columns if c != "text"]
    rows = rows.select(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = spelling(model)
        for batch in batches:
            # Some hundred rows at a time: decoding holds several numbers for each byte of text.
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, p.decode(part.column(column))], names=[*own, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema]).add("text", "string"))


def digest(docs: DataFrame, model: str, n_best: int = N_BEST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids and score in short, scores and checksums of the n best, whether decoding gave the text."""
    rows = docs.select("doc_id", "text", u32(F.col("text")).alias("text_crc32"))
    short = lambda f: F.concat_ws(",", F.transform("n_best", f))
    return encoded(rows, model, n_best, decode=True).select(
        "doc_id",
        "n_ids",
        F.crc32("ids").alias("ids_crc32"),
        "score",
        F.size("n_best").alias("n_best"),
        short(lambda x: F.format_string("%.4f", x["score"])).alias("n_best_scores"),
        short(lambda x: F.crc32(x["ids"]).cast("string")).alias("n_best_crc32"),
        (u32(F.col("text")) == F.col("text_crc32")).alias("same"),
    )


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 best segmentations of all documents, and the texts decoded from the best."""
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
