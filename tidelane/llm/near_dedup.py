"""Operator 7: near-duplicate documents by fast similarity sketching, banding and exact checks.

Sketch: in round i every shingle draws a bin and a value; a bin keeps the least value of the
first round that reached it. After as many rounds as there are bins, each further round is bound
to one bin, so every bin fills. A document of n shingles costs about n hashes plus the bins,
not n times the bins, and two sketches agree in a share of bins concentrated round the Jaccard
similarity.

Links: documents of equal shingle sets are one class, so copies never meet each other. Classes
whose sketches agree in all bins of a band are candidates. Each band's classes are first checked
against the least of them on their full sets. Bands whose classes are then still in several
components are compared between components, block by block, each pair in the first band that it
shares: sketches rule out the clearly different, and the rest meet again with their texts, where
full sets decide. So no pair is lost that banding finds, and no task puts out pairs: only rows
of the cell, or links that join components.

With BINS 128 in bands of BAND 4, a pair at similarity 0.8 shares no band with probability
5e-8; the sketch estimate of a pair at 0.8 is below LEAST_ESTIMATE with probability about 1e-6
(near_duplicates() takes None for it: then every pair that shares a band is checked in full). Texts of
any length are taken whole; a block of a crowded band is bounded by its rows and its shingles.

Nulls and ties: a null or wordless text has no shingles and no links; a text of fewer words than
a shingle is one shingle. A null doc_id has no links, component null, and is kept. Rows that
repeat a doc_id are one document to this operator: a row each with the same component (their
shingle sets join its links). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm._shared import Scratch, freed, ship, slices, table, word_codes
from tidelane.llm.components import stars

BINS, BAND = 128, 4
LEAST_ESTIMATE = 0.62
#: Rows of one band that are compared in one piece, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
_ODD = 0x9E3779B97F4A7C15
_M = np.uint64(_ODD)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of each text, sorted within it; how many each text has."""
    if lower:
        import pyarrow.compute as pc

        texts = pc.ascii_lower(texts)
    codes, words, counts = word_codes(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in words), np.uint64, len(words))
    w = hashes[codes] if len(words) else np.zeros(0, np.uint64)
    n = len(w)
    # Shingle i starts at word i; a short text's only shingle starts at its first word.
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    left = ends[doc] - np.arange(n) if n else np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        inside = left > k
        h[inside] = (h[inside] ^ w[np.flatnonzero(inside) + k]) * _M + np.uint64(k + 1)
    first = np.arange(n) == (ends - counts)[doc] if n else np.zeros(0, bool)
    whole = left >= size
    keep = whole | (first & (counts[doc] < size) if n else first)
    h, doc = _mix(h[keep]), doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(counts))


def sketches(h: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of bins for each set; sets without elements get zeros."""
    docs = len(counts)
    out = np.full(docs * bins, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(docs), counts)
    open_docs = counts > 0
    shift = np.uint64(64 - (bins - 1).bit_length())
    for i in range(2 * bins):
        alive = open_docs[doc]
        if not alive.any():
            break
        h, doc = h[alive], doc[alive]
        r = _mix(h + np.uint64((i + 1) * _ODD % 2**64))
        where = (r >> shift if i < bins else np.full(len(r), i - bins, np.uint64)).astype(np.int64)
        # The round stands above the value, so earlier rounds win.
        value = np.uint64(i) << np.uint64(48) | (r & np.uint64((1 << 48) - 1))
        np.minimum.at(out, doc * bins + where, value)
        full = (out.reshape(docs, bins) != np.iinfo(np.uint64).max).all(1)
        open_docs = open_docs & ~full
    out = _mix(out).astype(np.uint32).reshape(docs, bins)
    out[counts == 0] = 0
    return out


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                h, counts = shingle_sets(batch.column("text").slice(a, b - a), size)
                edges = np.concatenate([[0], np.cumsum(counts)])
                sums = [xxhash.xxh3_128_digest(h[i:j].data) if j > i else None for i, j in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_shingles": pa.array(counts.astype(np.int64)),
                        "set_id": pa.array(sums, pa.binary()),
                        "sketch": pa.array([s.tobytes() for s in sketches(h, counts)], pa.binary()),
                    }
                )

    return freed(run)


def _bands(bins: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, bins)
            h = np.zeros((len(s), bins // band), np.uint64) + np.arange(bins // band, dtype=np.uint64)
            for k in range(band):
                h = _mix(h * _M + s[:, k::band])
            yield pa.RecordBatch.from_pydict(
                {
                    "band": pa.array(h.view(np.int64).ravel()),
                    "number": pa.array(np.tile(np.arange(bins // band, dtype=np.int32), len(s))),
                    "rep": pa.array(np.repeat(batch.column("rep").to_numpy(), bins // band)),
                    "n": pa.array(np.repeat(batch.column("n_shingles").to_numpy(), bins // band)),
                }
            )

    return freed(run)


def _alike(size: int, percent: int):
    """(a, b, text_a, text_b) -> the pairs with 100 * intersection >= percent * union of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = np.zeros(batch.num_rows, bool)
            for i, j in slices(batch.column("text_a"), 1 << 22):
                sides = []
                for side in ("text_a", "text_b"):
                    coded = batch.column(side).slice(i, j - i).dictionary_encode()
                    h, counts = shingle_sets(coded.dictionary, size)
                    edges = np.concatenate([[0], np.cumsum(counts)])
                    sides.append((coded.indices.to_numpy(), h, edges))
                (ia, ha, ea), (ib, hb, eb) = sides
                for k in range(j - i):
                    x, y = ha[ea[ia[k]] : ea[ia[k] + 1]], hb[eb[ib[k]] : eb[ib[k] + 1]]
                    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or not len(x):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    hits[i + k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(hits))

    return freed(run)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links (a, b) to keep their nodes together."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            top[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in rows that are sorted by key, whole even across batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if rest and rest[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            rest.append(batch.slice(i, j - i))
            if j < len(k):
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two sides of a cell, and whether a pair of them is to be compared here."""
    side, rep, comp = (group.column(c).to_numpy() for c in ("side", "rep", "comp"))
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    ok = comp[left, None] != comp[None, right]
    if (side == 0).any():
        ok &= rep[left, None] < rep[None, right]
    return left, right, ok


def _hopeful(bins: int, band: int, least: float, percent: int):
    """Rows of a cell, sorted by cell -> those in a pair whose sketches look alike and meet here first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "cell"):
            left, right, ok = _sides(group)
            if not ok.any():
                continue
            n, number = group.column("n_shingles").to_numpy(), int(group.column("number")[0].as_py())
            s = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(-1, bins)
            hit = np.zeros(len(s), bool)
            step = max(1, (1 << 22) // (len(right) * bins + 1))
            for i in range(0, len(left), step):
                rows = left[i : i + step]
                same = s[rows, None, :] == s[None, right, :]
                met = same.reshape(len(rows), len(right), bins // band, band).all(3)
                good = ok[i : i + step] & (same.sum(2) >= least * bins) & (met.argmax(2) == number)
                x, y = n[rows, None], n[None, right]
                good &= np.minimum(x, y) * 100 >= percent * np.maximum(x, y)
                hit[rows] |= good.any(1)
                hit[right] |= good.any(0)
            if hit.any():
                kept = group.filter(pa.array(hit)).select(["cell", "side", "rep", "comp"])
                yield from kept.combine_chunks().to_batches()

    return freed(run)


def _exact(size: int, percent: int):
    """Rows (cell, side, rep, comp, text) sorted by cell -> enough true links to join what belongs together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "cell"):
            left, right, ok = _sides(group)
            h, counts = shingle_sets(group.column("text").combine_chunks(), size)
            row = np.repeat(np.arange(len(counts)), counts)
            # Only shingles of several rows matter; they are taken a thousand at a time.
            _, place, often = np.unique(h, return_inverse=True, return_counts=True)
            shared = often > 1
            place, row = (np.cumsum(shared) - 1)[place[shared[place]]], row[shared[place]]
            both = np.zeros((len(left), len(right)), np.float32)
            order = np.argsort(place, kind="stable")
            place, row = place[order], row[order]
            for start in range(0, int(shared.sum()), 1024):
                i, j = np.searchsorted(place, [start, start + 1024])
                m = np.zeros((len(counts), 1024), np.float32)
                m[row[i:j], place[i:j] - start] = 1
                both += m[left] @ m[right].T
            both = both.astype(np.int64)
            ok &= 100 * both >= percent * (counts[left, None] + counts[None, right] - both)
            x, y = np.nonzero(ok)
            if len(x):
                rep = group.column("rep").to_numpy()
                links = forest(rep[left[x]], rep[right[y]])
                yield pa.RecordBatch.from_pydict({"a": [u for u, _ in links], "b": [v for _, v in links]}, _LINKS)

    return freed(run)


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full shingle sets are alike enough."""
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    two = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_alike(size, percent), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bins: int = BINS,
    band: int = BAND,
    least_estimate: float | None = LEAST_ESTIMATE,
) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; see the module's text.

    least_estimate None: no pair that shares a band is ruled out by its sketches.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    features = scratch.keep(
        docs.mapInArrow(_features(shingle), "doc_id long, n_shingles long, set_id binary, sketch binary"), "features"
    )
    # One class for each distinct set, named by its least doc_id. Rows of one doc_id that have
    # several sets are tied together by links, below.
    reps = scratch.keep(
        features.where("set_id is not null and doc_id is not null")
        .groupBy("set_id", "sketch", "n_shingles")
        .agg(F.min("doc_id").alias("rep")),
        "reps",
    )
    bands = scratch.keep(
        reps.select("rep", "sketch", "n_shingles").mapInArrow(_bands(bins, band), "band long, number int, rep long, n long"), "bands"
    )
    hubs = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    shared = scratch.keep(bands.join(hubs.select("band", "hub").hint("merge"), "band"), "shared")
    scratch.drop(bands)
    # Every text that is compared below. Each way of joining is the same at every size.
    texts = docs.where("doc_id is not null").join(
        shared.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"
    )
    texts = scratch.keep(texts.where("text is not null").distinct(), "texts")
    checked = shared.where("hub < rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.keep(_confirm(checked, texts, shingle, percent), "links")
    near = stars(links, scratch)

    # Bands still in several components: all pairs across components, block against block.
    placed = shared.join(near.withColumnRenamed("id", "rep"), "rep", "left").select(
        "band", "number", "rep", "n", F.coalesce("component", "rep").alias("comp")
    )
    placed = scratch.keep(placed, "placed")
    mixed = (
        placed.groupBy("band")
        .agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.count("*").alias("rows"), F.sum("n").alias("shingles"))
        .where("c < d")
        # A cell holds two blocks at most: some thousand rows, and texts of a few million shingles.
        .select("band", F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    rows = placed.join(mixed, "band").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
        # 0: a block with itself; 1 and 2: the sides of two blocks
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        "number",
        "rep",
        "comp",
    )
    wide = rows.join(reps.select("rep", "sketch", "n_shingles"), "rep").repartition("cell").sortWithinPartitions("cell")
    hopeful = scratch.keep(
        wide.mapInArrow(_hopeful(bins, band, least_estimate or 0.0, percent), "cell long, side int, rep long, comp long"), "hopeful"
    )
    full = hopeful.join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    full = full.repartition("cell").sortWithinPartitions("cell")
    more = scratch.keep(full.mapInArrow(_exact(shingle, percent), "a long, b long"), "more")

    tied = (
        features.where("set_id is not null and doc_id is not null")
        .join(reps.select("set_id", "rep"), "set_id")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    all_links = links.union(more)
    final = scratch.keep(stars(all_links.union(_several_sets(tied)), scratch), "components")
    classes = reps.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_id", F.coalesce("component", "rep").alias("component_id")
    )
    found = features.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _several_sets(tied: DataFrame) -> DataFrame:
    """(a, b) for doc_ids a that stand in more than one class: those classes are linked through a."""
    twice = tied.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b < c").select("a")
    return tied.join(twice, "a").where("a <> b").distinct()


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 4-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
