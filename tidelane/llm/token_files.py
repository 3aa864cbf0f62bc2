"""Operator 2: token ids in binary shards, each a wavelet matrix with rank and select.

The documents are dealt by range of doc_id, so every task holds a run of consecutive
documents. A task encodes its run, ends each document with id 0, and closes a shard whenever
about SHARD_TOKENS ids have gathered. A shard is one binary value, written with Spark's own
Parquet writer (one row a shard): its commit protocol publishes files of finished tasks only, on
any file system that Spark reaches. Global starts come from the shards' token counts alone.

Image of a shard (little-endian): magic "TLWM", u32 version, u64 n_tokens, u64 n_docs,
u32 planes, then per plane u64 zeros; i64 doc_id per document (with a null mask), u64 start
per document; per plane the packed bits, padded to whole 512-bit blocks, and u32 ranks of the
ones before each block.

Nulls: a null text is the empty text (one id, the end id); a null doc_id sorts first. Repeated
doc_ids are separate documents, next to one another in order of their texts. An empty table
gives an empty result. Other columns are ignored. Texts of any length are encoded whole; a text that
holds an added token of the vocabulary gets that token's id, as the library gives by default.
count_tokens() and occurrences() answer from the bit-planes, without decoding a shard.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm._shared import Memo, Scratch, ship, slices, spread, table

SHARD_TOKENS = 1 << 21
BLOCK = 512
MAGIC = b"TLWM"


class WaveletMatrix:
    """Bit-planes of a sequence of ids: access, rank (count) and select (occurrences)."""

    def __init__(self, n: int, zeros: np.ndarray, words: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.words, self.ranks = n, zeros, words, ranks
        self.planes = len(zeros)
        self._before: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, planes: int) -> WaveletMatrix:
        zeros, words, ranks = np.zeros(planes, np.uint64), [], []
        size = -(-max(len(ids), 1) // BLOCK) * BLOCK // 8
        for k in range(planes):
            ones = (ids & ids.dtype.type(1 << (planes - 1 - k))) != 0
            packed = np.zeros(size, np.uint8)
            packed[: -(-len(ids) // 8)] = np.packbits(ones, bitorder="little")
            per_block = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(per_block[:-1], dtype=np.uint32)]).astype("<u4"))
            words.append(packed)
            # Places first, then take: several times faster than a mask that follows no pattern.
            low = ids.take(np.flatnonzero(~ones))
            zeros[k] = len(low)
            ids = np.concatenate([low, ids.take(np.flatnonzero(ones))])
        return cls(int(len(ids)), zeros, words, ranks)

    def _bit(self, k: int, i: int) -> int:
        return int(self.words[k][i >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block = min(i // BLOCK, len(self.ranks[k]) - 1)
        part = self.words[k][block * BLOCK // 8 : -(-i // 8)]
        extra = int(np.bitwise_count(part).sum())
        if i & 7 and len(part):
            extra -= bin(int(part[-1]) >> (i & 7)).count("1")
        return int(self.ranks[k][block]) + extra

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.planes):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """How often token stands among the first i ids."""
        if token >> self.planes:
            return 0
        low, high = 0, min(i, self.n)
        for k in range(self.planes):
            a, b = self._ones(k, low), self._ones(k, high)
            if token >> (self.planes - 1 - k) & 1:
                low, high = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence of token, from 0."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        return int(self._places(token, np.array([nth]))[0])

    def occurrences(self, token: int) -> np.ndarray:
        """Places of all occurrences of token, ascending."""
        return self._places(token, np.arange(self.count(token)))

    def _places(self, token: int, nth: np.ndarray) -> np.ndarray:
        """Places of the given occurrences: down to where token's run begins, then up by select."""
        if not len(nth):
            return nth
        low, bits = 0, [token >> (self.planes - 1 - k) & 1 for k in range(self.planes)]
        for k, bit in enumerate(bits):
            ones = self._ones(k, low)
            low = int(self.zeros[k]) + ones if bit else low - ones
        places = low + nth
        for k in reversed(range(self.planes)):
            places = self._select(k, bits[k], places - int(self.zeros[k]) * bits[k])
        return places

    def _samples(self, k: int, bit: int) -> np.ndarray:
        """Bits of this kind before each block of plane k, made at the first call."""
        if (k, bit) not in self._before:
            before = self.ranks[k].astype(np.int64)
            self._before[k, bit] = before if bit else np.arange(len(before)) * BLOCK - before
        return self._before[k, bit]

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places in plane k of the bits of this kind with these numbers."""
        if len(nth) * BLOCK > self.n:
            return np.flatnonzero(np.unpackbits(self.words[k], count=self.n, bitorder="little") == bit)[nth]
        before = self._samples(k, bit)
        blocks = np.searchsorted(before, nth, side="right") - 1
        own = self.words[k].reshape(-1, BLOCK // 8)[blocks]
        bits = np.unpackbits(own, axis=1, bitorder="little") == bit
        inside = (np.cumsum(bits, 1, dtype=np.int16) <= (nth - before[blocks])[:, None]).sum(1)
        return blocks * BLOCK + inside

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the planes' stable partitions from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for k in reversed(range(self.planes)):
            ones = np.unpackbits(self.words[k], count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[k])
            out = np.empty_like(values)
            out[np.flatnonzero(~ones)] = values[:z]
            out[np.flatnonzero(ones)] = values[z:] | values.dtype.type(1 << (self.planes - 1 - k))
            values = out
        return values


def pack(ids: np.ndarray, doc_ids: list[int | None], starts, planes: int) -> bytes:
    """The image of a shard."""
    m = WaveletMatrix.build(ids, planes)
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = [
        struct.pack("<4sIQQI", MAGIC, 1, m.n, len(doc_ids), planes),
        m.zeros.astype("<u8").tobytes(),
        null.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(starts, "<u8").tobytes(),
    ]
    for words, ranks in zip(m.words, m.ranks):
        parts += [words.tobytes(), ranks.tobytes()]
    return b"".join(parts)


def unpack(image: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The wavelet matrix of an image, its doc_ids and their starts within the shard."""
    magic, version, n, docs, planes = struct.unpack_from("<4sIQQI", image)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token shard")
    at = struct.calcsize("<4sIQQI")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    zeros, null, ids, starts = take("<u8", planes), take("u1", docs), take("<i8", docs), take("<u8", docs)
    blocks = -(-max(n, 1) // BLOCK)
    words, ranks = [], []
    for _ in range(planes):
        words.append(take("u1", blocks * BLOCK // 8))
        ranks.append(take("<u4", blocks))
    return WaveletMatrix(n, zeros, words, ranks), [None if x else int(d) for x, d in zip(null, ids)], starts


#: Byte-level vocabularies show bytes 0 to 32, 127 to 160 and 173 as the characters from U+0100 on.
_HIDDEN = [*range(33), *range(127, 161), 173]
SHOWN = np.arange(256, dtype="<u4")
SHOWN[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
SPACE, CUT = chr(SHOWN[32]), chr(SHOWN[0])
#: Marks that the splitting pattern always parts from the letters before them.
MARKS = {".", ",", ";", ":", "!", "?"}
#: A run of letters, with or without a space before it; up to U+024F all Unicode versions agree on them.
_RUN = " ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
LETTERS = rf"^{_RUN}\z"
#: A run, and what follows it from an ASCII mark or digit on.
PARTED = re.compile(rf"({_RUN})([!-@\[-`{{-~].*)", re.DOTALL)
#: White space that is not a single space or line feed between visible characters.
ODD_SPACE = r"\x00|[ \n][ \n]|^[ \n]|[ \n]\z|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Marks that do not end a word or number.
ODD_MARK = r"(^|[^\p{L}\p{N}])[.,;:!?]|[.,;:!?][^ \n]"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's splitting pattern never joins characters across a single space before a
    visible character or a single line feed, so texts without other white space fall into chunks
    that are encoded once and remembered; other texts go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.planes = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.code = "H" if self.kind is np.uint16 else "I"
        self.model = self.library.model
        self.chunks = Memo(lambda chunk: self._all_chunks([chunk])[0], 400_000)
        self.rests = Memo(self.whole, 50_000)
        # The library cuts a text at its added tokens before anything else.
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD_SPACE, *added])

    def whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _all_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks not seen lately.

        The pattern ends a letter run at a mark or digit and keeps it whole, so runs go straight to
        the model; what follows a run is few and remembered, and other chunks go to the library.
        """
        pure = pc.match_substring_regex(pa.array(chunks, pa.string()), LETTERS).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(pure).tolist()
        heads = [chunks[i] for i in places]
        out = [b""] * len(chunks)
        for i in np.flatnonzero(~pure).tolist():
            if parted := PARTED.match(chunks[i]):
                heads.append(parted[1])
                places.append(i)
                out[i] = self.rests[parted[2]]
            else:
                out[i] = self.whole(chunks[i])
        words = SHOWN[np.frombuffer("\0".join(heads).encode(), np.uint8)].tobytes().decode("utf-32-le").split(CUT)
        tokenize, width = self.model.tokenize, np.dtype(self.kind).itemsize
        # Some thousand at a time: as many small lists at once slow the collector down.
        for start in range(0, len(heads), 2000):
            found = [[t.id for t in tokenize(w)] for w in words[start : start + 2000]]
            flat, at = array(self.code, chain.from_iterable(found)).tobytes(), 0
            for i, n in zip(places[start:], map(len, found)):
                out[i] = flat[at : at + width * n] + out[i]
                at += width * n
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's with the end id 0 after them; their lengths."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd)
        cut = pc.replace_substring(pc.if_else(odd, "", texts), " ", "\0 ")
        marked = cut = pc.replace_substring(cut, "\n", "\0\n\0")
        for mark in MARKS:
            marked = pc.replace_substring(marked, mark, "\0" + mark)
        parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, ODD_MARK), cut, marked), "\0")
        edges = parts.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        table = self.chunks.many(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._all_chunks)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            codes[edges[i]] = len(table)
            table.append(self.whole(texts[int(i)].as_py()))
        codes = np.insert(codes, edges[1:], len(table))
        table.append(array(self.code, [0]).tobytes())
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // np.dtype(self.kind).itemsize
        ids = np.frombuffer(b"".join(table), self.kind)[spread(lengths, codes)]
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])[edges + np.arange(len(edges))]
        return ids, np.diff(ends)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_SHARDS = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())]
)


def write_shards(docs: DataFrame, path: str, vocabulary: str, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Encode docs (doc_id, text) and write their shards to path, in ascending doc_id order."""
    spark = docs.sparkSession
    ship(spark)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        n = 0

        def close() -> pa.RecordBatch:
            starts = np.cumsum([0, *lengths[:-1]])
            row = {"part": part, "seq": seq, "n_docs": len(doc_ids), "n_tokens": n}
            return pa.RecordBatch.from_pylist(
                [row | {"image": pack(np.concatenate(ids), doc_ids, starts, enc.planes)}], schema=_SHARDS
            )

        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                codes, length = enc.encode(texts.slice(a, b - a))
                at = 0
                for doc_id, k in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), length.tolist()):
                    ids.append(codes[at : at + k])
                    doc_ids.append(doc_id)
                    lengths.append(k)
                    at, n = at + k, n + k
                    if n >= shard_tokens:
                        yield close()
                        ids, doc_ids, lengths, n, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield close()

    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The text's hash orders repeated doc_ids; the last key only lets equal rows be dealt apart.
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"), F.rand(11).alias("_r"))
        .repartitionByRange(n, "doc_id", "_h", "_r")
        .sortWithinPartitions("doc_id", "_h", "_r")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(shards, "part int, seq int, n_docs long, n_tokens long, image binary").write.option(
        "compression", "none"
    ).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards at path: doc_id, start, n_tokens, ids_crc32, shard place."""
    ship(spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c) for c in ("part", "seq", "image"))):
                matrix, doc_ids, starts = unpack(image.as_buffer())
                ids = matrix.decode().astype("<u4")
                edges = np.append(starts, matrix.n).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(edges[:-1], edges[1:])]
                k = len(doc_ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "part": pa.array(np.full(k, part.as_py(), np.int32)),
                        "seq": pa.array(np.full(k, seq.as_py(), np.int32)),
                        "local_start": pa.array(edges[:-1]),
                        "n_tokens": pa.array(np.diff(edges)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    shards = spark.read.parquet(path)
    # One row a shard (millions of ids each): few narrow rows, whatever the corpus.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    rows = shards.select("part", "seq", "image").mapInArrow(
        documents, "doc_id long, part int, seq int, local_start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "seq"
    )


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """How often each of the tokens stands in each shard, by rank alone: part, seq, token, n."""
    ship(spark)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c) for c in ("part", "seq", "image"))):
                matrix, _, _ = unpack(image.as_buffer())
                yield pa.RecordBatch.from_pylist(
                    [{"part": part.as_py(), "seq": seq.as_py(), "token": t, "n": matrix.count(t)} for t in tokens],
                    schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("token", pa.int64()), ("n", pa.int64())]),
                )

    shards = spark.read.parquet(path).select("part", "seq", "image")
    return shards.mapInArrow(counts, "part int, seq int, token long, n long")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every place of token: part, seq, doc_id and place within the document, by select alone."""
    ship(spark)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c) for c in ("part", "seq", "image"))):
                matrix, doc_ids, starts = unpack(image.as_buffer())
                at = matrix.occurrences(token)
                doc = np.searchsorted(starts.astype(np.int64), at, side="right") - 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(len(at), part.as_py(), np.int32)),
                        "seq": pa.array(np.full(len(at), seq.as_py(), np.int32)),
                        "doc_id": pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()),
                        "place": pa.array(at - starts.astype(np.int64)[doc], pa.int64()),
                    }
                )

    shards = spark.read.parquet(path).select("part", "seq", "image")
    return shards.mapInArrow(places, "part int, seq int, doc_id long, place long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of all documents, written, read back and digested."""
    import public_tokenizers

    path = f"{Scratch(spark, 'op2').root}/shards"
    write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, path)
