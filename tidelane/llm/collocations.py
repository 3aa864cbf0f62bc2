"""Operator 11: phrases of several words that occur together more often than their parts explain.

Texts are lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words
`[^\\x20\\x09]+`; no phrase crosses a piece. Everything is counted by language.

Each shard (a slice of a task's texts) gets a generalised suffix automaton over words, bounded to
phrases of up to max_words: a state is a class of phrases that end at the same places, it has the
number of these places (endpos), the lengths of its phrases from shortest to longest, and a suffix
link to the class of its longest suffix that ends at more places. Within the bound, the automaton's
link tree is the tree of the places' left contexts, so all states of a shard are made level by level
by sorting, for all places at once, and no word is walked on its own. A shard gives each phrase once
with its count, however often it holds it.

Counts are then summed over the shards. Phrases travel in packets, one for each language and bucket of a
shard that has any; the buckets are as many as the bytes of text call for, so that one never grows with
the input, and a phrase that every shard holds is one entry a shard. Phrases of fewer than `least`
occurrences end there: parts of a phrase occur as often at least, so all that scores need is left.

A cut of a phrase after its first k words scores floor(1000000 * a * a / (l * r)) with the counts a of the
phrase and l, r of the parts, in decimals of 38 digits; the lowest cut counts, of equal ones the one of
smallest k. A candidate is dropped if its words lie in a longer candidate with
100 * f(longer) >= inside_percent * a. Counts fall along suffix links and prefixes, so it is enough that
each candidate points at the one without its first word (its suffix link) and the one without its last.

Nulls: a null text has no words, a null lang counts as `und`. Repeated rows count as often as they are
there. An empty table gives an empty result. Other columns are not read. A text larger than a shard is cut
into several at words, each with the words before it as context, so that nothing is lost or counted
twice. Ties in score go by count, then by phrase in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm._shared import Scratch, give_back, ship, slices, table

MAX_WORDS, LEAST, INSIDE_PERCENT, TOP = 3, 10, 50, 2000
#: Bytes of text of a shard, and bytes of text for each bucket of phrases.
SHARD, BUCKET = 3 << 20, 1 << 24
UNNAMED = "und"

#: Of each byte: 0 part of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class SuffixAutomaton:
    """States of the suffix automaton of many word sequences, for phrases of up to depth words.

    words: codes of all words in order; room: how many words a phrase that ends there may have (1 to depth);
    root: a number for each place whose automaton it belongs to; own: whether the place counts.
    By state: length and shortest (words of its longest and shortest phrase), count, end (one of its
    places) and link (a state, or -1 for the root).
    """

    def __init__(self, words: np.ndarray, room: np.ndarray, root: np.ndarray, own: np.ndarray, depth: int):
        size = int(words.max(initial=0)) + 1
        group = root.astype(np.int64)
        levels = []
        for d in range(1, depth + 1):
            at = np.flatnonzero(own & (room >= d))
            _, inverse, count = np.unique(group[at] * size + words[at - (d - 1)], return_inverse=True, return_counts=True)
            end = np.zeros(len(count), np.int64)
            end[inverse] = at
            levels.append((count, end, group[end] if d > 1 else None))
            group = np.full(len(words), -1, np.int64)
            group[at] = inverse
        # A phrase all of whose places share the word before is in that longer phrase's class.
        kept, shortest = [], []
        for d, (count, end, parent) in enumerate(levels):
            least = np.full(len(count), d + 1)
            if parent is not None:
                same = count == levels[d - 1][0][parent]
                least[same] = shortest[d - 1][parent[same]]
                kept[d - 1][parent[same]] = False
            shortest.append(least)
            kept.append(np.ones(len(count), bool))
        # Numbers of the states; a class is found from any of its phrases.
        number, base = [], 0
        for alive in kept:
            number.append(base + np.cumsum(alive) - 1)
            base += int(alive.sum())
        for d in range(depth - 1, 0, -1):
            parent = levels[d][2]
            same = ~kept[d - 1][parent] & (levels[d][0] == levels[d - 1][0][parent])
            number[d - 1][parent[same]] = number[d][same]
        self.length = np.concatenate([np.full(int(k.sum()), d + 1) for d, k in enumerate(kept)])
        self.shortest = np.concatenate([s[k] for s, k in zip(shortest, kept)])
        self.count = np.concatenate([c[k] for (c, _, _), k in zip(levels, kept)])
        self.end = np.concatenate([e[k] for (_, e, _), k in zip(levels, kept)])
        self.link = np.full(base, -1, np.int64)
        # The link is the class of the suffix one word shorter than the class's shortest phrase.
        for d in range(1, depth):
            parent = levels[d][2]
            differs = levels[d][0] != levels[d - 1][0][parent]
            self.link[number[d][differs]] = number[d - 1][parent[differs]]

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All phrases, as end, number of words and count: those of a state are the suffixes of its longest one."""
        several = self.length - self.shortest + 1
        state = np.repeat(np.arange(len(several)), several)
        less = np.arange(len(state)) - np.repeat(np.cumsum(several) - several, several)
        return self.end[state], self.length[state] - less, self.count[state]


def _words(data: np.ndarray, edges: np.ndarray, depth: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts between edges in data: where words begin, the words (coded), their room, and words by text."""
    kind = _KIND[data]
    inside = kind == 0
    first = edges[:-1][np.diff(edges) > 0]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    upto = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    offsets = np.concatenate([upto[starts], upto[-1:]]).astype(np.int32)
    raw = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    apart = kind == 2
    apart[first] = True
    piece = np.cumsum(apart, dtype=np.int32)[starts]
    every = np.arange(len(starts))
    new = np.ones(len(starts), bool)
    new[1:] = piece[1:] != piece[:-1]
    room = np.minimum(every - np.maximum.accumulate(np.where(new, every, 0)) + 1, depth)
    return starts, words, room, np.diff(np.searchsorted(starts, edges))


def _blocks(texts: pa.Array, depth: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, edges of texts, and the first byte that counts; texts are one slice, or one large text in blocks."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    if len(texts) > 1 or len(data) <= most:
        yield data, edges, 0
        return
    context = at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and not _KIND[data[end]]:
            end += 1
        block = data[context:end]
        yield block, np.array([0, len(block)]), at - context
        inside = _KIND[block] == 0
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        context, at = context + (int(starts[-min(depth - 1, len(starts))]) if depth > 1 and len(starts) else len(block)), end


def _packets(texts: pa.Array, langs: pa.Array, depth: int, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    coded = langs.fill_null(UNNAMED).dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    for data, edges, counted in _blocks(texts, depth, most):
        if not len(data):
            continue
        starts, words, room, by_text = _words(data, edges, depth)
        if not len(starts):
            continue
        code, known = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        lang = np.repeat(codes, by_text)
        end, length, count = SuffixAutomaton(code, room, lang, starts >= counted, depth).phrases()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known.to_pylist()), np.uint64, len(known))
        key, texts_of, counts = [], [], []
        for d in range(1, depth + 1):
            some = np.flatnonzero(length == d)
            mixed = np.full(len(some), d, np.uint64)
            parts = []
            for back in range(d - 1, -1, -1):
                word = code[end[some] - back]
                mixed = (mixed ^ hashes[word]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                parts.append(known.take(pa.array(word)))
            texts_of.append(pc.binary_join_element_wise(*parts, b" ") if d > 1 else parts[0])
            key.append(lang[end[some]].astype(np.int64) * buckets + (mixed % np.uint64(buckets)).astype(np.int64))
            counts.append(count[some])
        key = np.concatenate(key)
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        key, counts = key[order], np.concatenate(counts)[order].astype("<i8")
        phrases = pa.concat_arrays([t.cast(pa.large_binary()) for t in texts_of]).take(pa.array(order))
        places = np.frombuffer(phrases.buffers()[1], np.int64)[: len(phrases) + 1]
        flat, sizes = memoryview(phrases.buffers()[2]), np.diff(places).astype("<u4")
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        bounds = list(zip(cut, [*cut[1:], len(key)]))
        raw = [b"".join((flat[places[a] : places[b]], sizes[a:b], counts[a:b])) for a, b in bounds]
        at = pa.array(key[cut])
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pc.divide(at, buckets)).cast(pa.string()),
                pc.subtract(at, pc.multiply(pc.divide(at, buckets), buckets)),
                pa.array([b - a for a, b in bounds], pa.int64()),
                pa.array(list(map(len, raw)), pa.int64()),
                pa.array([pa.compress(r, codec="zstd", asbytes=True) for r in raw], pa.binary()),
            ],
            names=["lang", "bucket", "entries", "bytes", "packet"],
        )


_SUMS = "lang string, phrase string, n_words long, f long"


def _summed(least: int):
    def run(key: tuple, packets: pa.Table) -> pa.Table:
        """Counts of a bucket's phrases; those of single words in all stand in a row without phrase."""
        phrases, sizes, counts = [], [], []
        for n, size, packet in zip(*(packets.column(c).to_pylist() for c in ("entries", "bytes", "packet"))):
            raw = pa.decompress(packet, size, codec="zstd")
            phrases.append(memoryview(raw)[: size - 12 * n])
            sizes.append(np.frombuffer(raw, "<u4", n, size - 12 * n))
            counts.append(np.frombuffer(raw, "<i8", n, size - 8 * n))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        all_of = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(phrases))])
        coded = all_of.dictionary_encode()
        counts = np.concatenate(counts)
        f = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(f, coded.indices.to_numpy(), counts)
        n_words = pc.count_substring(coded.dictionary, " ").to_numpy().astype(np.int64) + 1
        own = np.flatnonzero(f >= least)
        frequent = coded.dictionary.take(pa.array(own)).cast(pa.large_string()).cast(pa.string())
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * (len(own) + 1), pa.string()),
                "phrase": pa.concat_arrays([frequent, pa.nulls(1, pa.string())]),
                "n_words": np.append(n_words[own], 0),
                "f": np.append(f[own], f[n_words == 1].sum()),
            }
        )

    return run


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """docs (text, lang) -> lang, phrase, n_words, f of all phrases of at least `least` occurrences.

    Rows without phrase (n_words 0) sum to a language's occurrences of words.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, shard):
                yield from _packets(texts.slice(a, b - a), batch.column("lang").slice(a, b - a), max_words, buckets, shard)
                give_back()
        give_back()

    packets = docs.mapInArrow(run, "lang string, bucket long, entries long, bytes long, packet binary")
    return packets.groupBy("lang", "bucket").applyInArrow(_summed(least), _SUMS)


def scored(counts: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """phrase_counts() -> lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    f = counts.where("n_words > 0")
    candidates = f.where("n_words > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    shorter = candidates.where("n_words > 2").select(
        "lang",
        F.explode(
            F.array(
                F.concat_ws(" ", F.slice(words, F.lit(2), F.col("n_words").cast("int") - 1)),
                F.concat_ws(" ", F.slice(words, F.lit(1), F.col("n_words").cast("int") - 1)),
            )
        ).alias("phrase"),
        F.col("a").alias("longer"),
    )
    shorter = shorter.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = candidates.join(shorter, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True))
    )
    k = F.col("k")
    cuts = free.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("n_words").cast("int") - 1)).alias("k"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.concat_ws(" ", F.slice("words", F.lit(1), k)).alias("left"),
        F.concat_ws(" ", F.slice("words", k + 1, F.size("words"))).alias("right"),
    )
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def score(a, l, r):  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exact for counts below 10**15."""
    wide = "decimal(38,0)"
    above = (a.cast("decimal(19,0)") * a.cast("decimal(19,0)")).cast(wide) * F.lit(1000000).cast("decimal(7,0)")
    below = (l.cast("decimal(19,0)") * r.cast("decimal(19,0)")).cast(wide)
    return F.call_function("div", above.cast(wide), below)


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP, shard: int = SHARD
) -> DataFrame:
    """docs (text, lang) -> the first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = Scratch(docs.sparkSession, "collocations").keep(phrase_counts(docs, max_words, least, shard), "counts")
    n = counts.where("n_words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within parts of a language, so that no task ranks all of its candidates.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = scored(counts, inside_percent).withColumn("part", part)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return some.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of 2 to 3 words of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), seqs AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM seqs
), occurrences AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w)
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM occurrences GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10
), covered AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE m = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM candidates WHERE m = 3
), cover AS (
  SELECT lang, phrase, max(a) AS longer FROM covered GROUP BY ALL
), free AS (
  SELECT c.* FROM candidates c LEFT JOIN cover USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
), cuts AS (
  SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM free
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
    CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:c.m], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
