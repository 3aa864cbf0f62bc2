"""Operator 4: language by nearest centroids of TF-IDF n-gram vectors, with rejection by distance.

A text's letters, lower-cased, with one space for each run of anything else, give 2- and
3-grams, hashed into DIMS places. Counts become 1 + ln(count), are weighted by inverse document
frequency and scaled to length 1. Each language has up to CLUSTERS centroids (spherical k-means
over its sample); the nearest centroid of all, by cosine, names the language and its cosine is
the score.

Rejection: the cosine of a sound text depends on its length, so for each octave of letters the
sample's median cosine is kept, and a text below REJECT times the median of its octave is too far
from every language. An octave with fewer than LEAST sampled texts takes the threshold of the nearest
one that has them; where that is of longer texts, it shrinks with the square root of the length, as
the cosine of a short text does. If no octave has LEAST, all texts count as one, at their median
octave. A sampled text's cosine leaves the text itself out of its centroid, so that few texts do not
look closer than others of their language. Rejection is a column of its own; lang_pred is then still
the nearest language.

Fit: on a bounded sample of the distinct labelled texts with a letter: of each language those of the
least hashes, SAMPLE at most and MOST_SAMPLED in all (one at least of each language). Copies count once. The sample's vectors (at most DIMS counts each) are made on the
executors and the model (DIMS floats a centroid) is sent with the tasks.

Nulls: a text that is null or has no letter is `und`, score 0, rejected. Rows without lang are
predicted and never learned from; if nothing can be learned, every text is `und`. Repeated rows
are repeated in the result; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelane.llm._shared import freed, ship, slices, table

DIMS, CLUSTERS = 1 << 13, 4
SAMPLE, MOST_SAMPLED = 400, 4000
REJECT, LEAST = 0.5, 10
DEALT = 16
UND = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        flags = (chr(c).isalpha() for c in range(sys.maxunicode + 1))
        _letters.append(np.fromiter(flags, bool, sys.maxunicode + 1))
    return _letters[0]


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts, a row for each text, and its number of letters."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 1 for p in points])
    # A separator after every text; all texts go through at once.
    flat = np.zeros(int(sizes.sum()), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    ends = np.cumsum(sizes)
    for p, e in zip(points, ends):
        flat[e - 1 - len(p) : e - 1] = p
    is_letter = letters()[flat]
    n_letters = np.bincount(doc[is_letter], minlength=len(texts))
    flat[~is_letter] = 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    # A text's first letter follows a space, be it that of the text before; the first text needs one.
    flat, doc = np.append(np.zeros(2, np.uint32), flat[keep]), np.append(np.zeros(2, np.int32), doc[keep])
    a, b, c = flat[:-2], flat[1:-1], flat[2:]
    base = b * np.uint32(0x9E3779B1)
    two = (base + c * np.uint32(0x85EBCA6B)) >> np.uint32(19)
    three = (base + c * np.uint32(0xC2B2AE35) + a * np.uint32(0x27D4EB2F)) >> np.uint32(19)
    own = doc[2:].astype(np.int64) * DIMS
    pure2, pure3 = (b != 0) | (c != 0), (b != 0)
    grams = np.concatenate([(own + two)[pure2], (own + three)[pure3]])
    out = np.bincount(grams, minlength=len(texts) * DIMS).astype(np.float32).reshape(len(texts), DIMS)
    out[n_letters == 0] = 0
    return out, n_letters


def octave(n_letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(np.int64), 31)


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    nearest: np.ndarray  # the least cosine that isn't rejected, by octave

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), cosine, rejected."""
        x, n = counts(texts)
        if not len(self.centroids):
            return np.full(len(n), -1), np.zeros(len(n)), np.ones(len(n), bool)
        cosines = scaled(x, self.idf) @ self.centroids.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(n)), best].astype(np.float64), 0, 1)
        none = n == 0
        score[none] = 0
        return np.where(none, -1, self.owner[best]), score, none | (score < self.nearest[octave(n)])


def scaled(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of length 1 by spherical k-means."""
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) if (near == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32)


def closeness(x: np.ndarray, lang: np.ndarray, centroids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The cosine of each text to its nearest centroid, its language's nearest one made without the text."""
    cosines = x @ centroids.T
    near = np.where(owner == lang[:, None], cosines, -1).argmax(1)
    for j in range(len(centroids)):
        members = np.flatnonzero(near == j)
        total = x[members].sum(0)
        dots = x[members] @ total - 1
        # |total - x|, as x has length 1
        rest = np.sqrt(np.maximum(total @ total - 2 * dots - 1, 1e-12))
        cosines[members, j] = dots / rest if len(members) > 1 else 0
    return cosines.max(1)


def thresholds(octaves: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least cosine that isn't rejected, by octave, from the sample's octaves and cosines."""
    dense = [o for o in range(32) if (octaves == o).sum() >= LEAST]
    at = {o: REJECT * float(np.median(best[octaves == o])) for o in dense}
    if not at:
        at = {int(np.median(octaves)): REJECT * float(np.median(best))}
    out = np.zeros(32)
    for o in range(32):
        p = min(at, key=lambda p: (abs(p - o), p))
        out[o] = at[p] * 2.0 ** (min(o - p, 0) / 2)
    return out


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        fresh = []
        for key in zip(batch.column("lang").to_pylist(), batch.column("hash").to_pylist()):
            fresh.append(key not in seen)
            seen.add(key)
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        for a, b in slices(batch.column("text"), 1 << 20):
            for i in range(a, b, 256):
                part = batch.slice(i, min(256, b - i))
                x, n = counts([t or "" for t in part.column("text").to_pylist()])
                places = [np.flatnonzero(row) for row in x]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": part.column("lang"),
                        "hash": part.column("hash"),
                        "letters": pa.array(n.astype(np.int64)),
                        "place": pa.array([p.astype(np.uint16).tobytes() for p in places], pa.binary()),
                        "count": pa.array([row[p].tobytes() for row, p in zip(x, places)], pa.binary()),
                    }
                )


def fit(labelled: DataFrame, seed: int = 4) -> Model:
    """A model from labelled rows (text, lang); rows with a null in either are passed over."""
    ship(labelled.sparkSession)
    hashed = F.xxhash64(F.lit(seed), "text").alias("hash")
    rows = labelled.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).select("text", "lang", hashed)
    keys = rows.select("lang", "hash").distinct()
    languages = sorted(r.lang for r in keys.select("lang").distinct().collect())
    none = Model([], np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.ones(DIMS, np.float32), np.zeros(32))
    if not languages:
        return none
    quota = max(1, min(SAMPLE, MOST_SAMPLED // len(languages)))
    # First within DEALT parts of a language, so that no task reads more of it than a part or DEALT quotas.
    drawn = keys.withColumn("part", F.pmod("hash", F.lit(DEALT)))
    for by in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("hash"))
        drawn = drawn.withColumn("place", place).where(F.col("place") <= quota)
    drawn = drawn.select("lang", "hash")
    # At most MOST_SAMPLED keys; a task passes on one copy of a text, and one of those is kept.
    sample = rows.join(F.broadcast(drawn), ["lang", "hash"])
    kind = "lang string, hash long, letters long, place binary, count binary"
    got = sample.select("text", "lang", "hash").mapInArrow(_sparse, kind).dropDuplicates(["lang", "hash"]).collect()
    got = sorted((r for r in got if r.letters), key=lambda r: (r.lang, r.hash))
    if not got:
        return none
    x = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.place, np.uint16)] = np.frombuffer(r["count"], np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = scaled(x, idf)
    lang = np.array([languages.index(r.lang) for r in got])
    octaves = octave(np.array([r.letters for r in got]))
    rng = np.random.default_rng(seed)
    found = [clusters(x[lang == j], CLUSTERS, rng) if (lang == j).any() else x[:0] for j in range(len(languages))]
    centroids = np.concatenate(found)
    owner = np.repeat(np.arange(len(languages)), [len(f) for f in found])
    return Model(languages, centroids, owner, idf, thresholds(octaves, closeness(x, lang, centroids, owner)))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, other columns) with lang_pred, score and rejected; input columns so named are replaced."""
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*own)
    names = [*model.languages, UND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 20):
                for i in range(a, b, 256):
                    part = batch.slice(i, min(256, b - i))
                    lang, score, rejected = model.predict([t or "" for t in part.column("text").to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array([names[j] for j in lang]), pa.array(score), pa.array(rejected)],
                        names=[*own, "lang_pred", "score", "rejected"],
                    )

    kind = StructType([*docs.schema]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(freed(run), kind)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predicted(rows, model).drop("text")
