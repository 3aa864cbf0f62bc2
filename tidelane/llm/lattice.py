"""Operator 10: near-duplicate vectors by E8 lattice hashing, verified by cosine.

In each of TABLES tables a vector, scaled to length 1, goes through random projections to BLOCKS
times eight dimensions, each of which is decoded to the nearest point of the E8 lattice; the
points together name the vector's own cell. It also probes the PROBES neighbouring cells that lie
nearest (one step along one of the 240 shortest lattice vectors in one block). Two vectors meet
where one's own cell is among the other's cells. A pair at cosine 0.95 meets in one table with
probability 0.55 and so in one of 8 tables with probability over 0.998; wider pairs are decided
by their cosine in double precision, so no link below the limit is made.

Vectors that are equal after scaling are one class, with a multiplicity. Cells where nothing
meets are dropped before any vector moves; a crowded cell is dealt out as pairs of blocks. A link
that several tables find is counted in the first of them, which each task derives from the cells that
come with the two vectors; so a task returns at most a count and a spanning set of links for its classes,
never the pairs themselves.

Nulls and ties: vectors that are null, of length zero, or hold null or non-finite components have
no links. A null vec_id has component null, no links, and is kept. Rows that repeat a vec_id are
separate vectors for the counts and share a component. Vectors of different lengths in one table
are compared within their length only. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm._shared import Scratch, ship, table
from tidelane.llm.components import stars
from tidelane.llm.near_dedup import _groups, forest

TABLES, BLOCKS, PROBES, WIDTH = 8, 2, 4, 2.0
#: Rows of one cell that are compared in one piece.
BLOCK = 1024


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, by their rule."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 = D8 and D8 + 1/2."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


@lru_cache(maxsize=64)
def _projection(dims: int, k: int, blocks: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([8, dims, k, blocks])
    factors = rng.integers(1, 2**63, 8 * blocks, dtype=np.int64).view(np.uint64) | np.uint64(1)
    return rng.normal(size=(dims, 8 * blocks)) / width, rng.normal(size=8 * blocks) * 3, factors


def cells(x: np.ndarray, k: int, blocks: int, probes: int, width: float) -> np.ndarray:
    """For rows of x in table k: the own cell and then the probed ones, as 64-bit names."""
    project, shift, factors = _projection(x.shape[1], k, blocks, width)
    y = x @ project + shift
    own = np.concatenate([nearest_e8(y[:, 8 * i : 8 * i + 8]) for i in range(blocks)], 1)
    # Twice a lattice point is a vector of integers; its name is linear in it, so that of a neighbour is a sum.
    weight = lambda v: (np.rint(2 * v).astype(np.int64).view(np.uint64) * factors[None, :]).sum(1, dtype=np.uint64)
    name = weight(own) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    rest = y - own
    gain = np.concatenate([rest[:, 8 * i : 8 * i + 8] @ SHORTEST.T for i in range(blocks)], 1)
    best = np.argpartition(-gain, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), np.int64)
    steps = np.zeros((240 * blocks, 8 * blocks))
    for i in range(blocks):
        steps[240 * i : 240 * i + 240, 8 * i : 8 * i + 8] = SHORTEST
    return np.concatenate([name[:, None], name[:, None] + weight(steps)[best]], 1).view(np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64)


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> vec_id, the scaled vector as bytes (null if it has no links)."""
    for batch in batches:
        out: list[bytes | None] = []
        for v in batch.column("embedding"):
            x = None
            if v.is_valid and len(v) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max()
                x = x / top if np.isfinite(x).all() and top > 0 else None
            out.append(None if x is None else (x / np.sqrt((x * x).sum()) + 0.0).tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "vec_id": batch.column("vec_id"),
                "key": pa.array([None if x is None else xxhash.xxh3_128_digest(x) for x in out], pa.binary()),
                "vector": pa.array(out, pa.binary()),
            }
        )


def _placed(tables: int, blocks: int, probes: int, width: float):
    """Adds to rows (key, vector, ...) the cells of all tables, own ones first, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.array([len(v.as_buffer()) for v in column])
            out = np.zeros((batch.num_rows, tables, probes + 1), np.int64)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                x = _vectors(column.take(pa.array(mine))).reshape(len(mine), -1)
                for k in range(tables):
                    out[mine, k] = cells(x, k, blocks, probes, width) + np.int64(size)
            found = pa.array([row.tobytes() for row in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "cells"])

    return run


def _dealt(tables: int, probes: int):
    """(key, cells) -> a row for each table and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = tables * (probes + 1)
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict(
                {
                    "tab": pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes + 1), n)),
                    "cell": pa.array(np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.int64)),
                    "own": pa.array(np.tile(np.arange(each) % (probes + 1) == 0, n)),
                    "key": batch.column("key").take(pa.array(np.repeat(np.arange(n), each))),
                }
            )

    return run


def _met(probes: int, least: float):
    """Rows of one part of a cell, sorted by part -> counts (a, null, copies linked) and links (a, b, 0),
    a and b being keys of classes."""

    def first_here(c: np.ndarray, k: int, number: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of linked pairs with i in its own cell: those that no earlier table, and no other cell of this one, counts."""
        ok = np.ones(len(i), bool)
        for t in range(k + 1):
            same = c[i, t, 0] == c[j, t, 0]
            back = (c[i, t] == c[j, t, :1]).any(1)
            if t < k:
                ok &= ~(same | back | (c[j, t] == c[i, t, :1]).any(1))
            else:
                ok &= own[j] | ~(back & (number[j] < number[i]))
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], []
        for group in _groups(batches, "part"):
            side, own = (group.column(c).to_numpy(zero_copy_only=False) for c in ("side", "own"))
            x = _vectors(group.column("vector")).reshape(len(own), -1)
            left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
            ok = (x[left] @ x[right].T >= least) & (own[left, None] | own[None, right])
            p, q = np.nonzero(ok)
            p, q = left[p], right[q]
            p, q = p[p != q], q[p != q]
            if not len(p):
                continue
            copies, keys = group.column("copies").to_numpy(), group.column("key").to_pylist()
            # Numbers in order of the keys; a class that comes with two of its cells has one number.
            order = {key: i for i, key in enumerate(sorted(set(keys)))}
            rep = np.array([order[key] for key in keys])
            names = list(order)
            once = (rep[p] < rep[q]) if (side == 0).any() else rep[p] != rep[q]
            p, q = p[once], q[once]
            if not len(p):
                continue
            # The product rounds by its blocking; the sum over each pair decides.
            sure = np.concatenate([(x[p[s : s + 65536]] * x[q[s : s + 65536]]).sum(1) for s in range(0, len(p), 65536)]) >= least
            p, q = p[sure], q[sure]
            for u, v in forest(rep[p], rep[q]):
                a.append(names[u])
                b.append(names[v])
                n.append(0)
            i, j = np.where(own[p], p, q), np.where(own[p], q, p)
            k = int(group.column("tab")[0].as_py())
            c = np.frombuffer(b"".join(group.column("cells").to_pylist()), np.int64).reshape(-1, k + 1, probes + 1)
            counted = first_here(c, k, rep, own, i, j)
            totals = np.bincount(i[counted], copies[j[counted]], len(rep)) + np.bincount(j[counted], copies[i[counted]], len(rep))
            for u in np.flatnonzero(totals):
                a.append(keys[u])
                b.append(None)
                n.append(int(totals[u]))
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64())}
        )

    return run


def near_vectors(
    vectors: DataFrame,
    least: float = 0.95,
    tables: int = TABLES,
    blocks: int = BLOCKS,
    probes: int = PROBES,
    width: float = WIDTH,
) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept; see the module's text."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lattice")
    scaled = scratch.keep(
        vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
            _scaled, "vec_id long, key binary, vector binary"
        ),
        "scaled",
    )
    usable = scaled.where("key is not null and vec_id is not null")
    # A class is named by the 128-bit hash of its vector, and a component by its least vec_id.
    classes = usable.groupBy("key", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    named = scratch.keep(
        classes.mapInArrow(
            _placed(tables, blocks, probes, width), "key binary, vector binary, rep long, copies long, cells binary"
        ),
        "named",
    )
    placed = scratch.keep(
        named.select("key", "cells").mapInArrow(_dealt(tables, probes), "tab int, cell long, own boolean, key binary"),
        "placed",
    )
    crowd = placed.groupBy("tab", "cell").agg(F.count("*").alias("n"), F.count_if("own").alias("owned"))
    crowd = crowd.where("owned > 0 and n > 1").select("tab", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    rows = placed.join(crowd, ["tab", "cell"]).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        F.xxhash64("tab", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        "tab",
        "own",
        "key",
    )
    # A pair is counted by what this table and those before it hold; later cells needn't move.
    upto = F.expr(f"substring(cells, 1, (tab + 1) * {8 * (probes + 1)})")
    full = rows.join(named.select("key", "vector", "copies", "cells"), "key").withColumn("cells", upto)
    full = full.repartition("part").sortWithinPartitions("part")
    met = scratch.keep(full.mapInArrow(_met(probes, least), "a binary, b binary, n long"), "met")
    scratch.drop(placed)
    counts = met.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    names = named.select("key", "rep")
    links = (
        met.where("b is not null")
        .select("a", "b")
        .distinct()
        .join(names.withColumnsRenamed({"key": "a", "rep": "u"}), "a")
        .join(names.withColumnsRenamed({"key": "b", "rep": "v"}), "b")
        .select(F.col("u").alias("a"), F.col("v").alias("b"))
    )
    member = usable.select("vec_id", "key").join(named.select("key", "rep"), "key").select("vec_id", "rep")
    twice = member.groupBy("vec_id").agg(F.min("rep").alias("l"), F.max("rep").alias("m")).where("l < m").select("vec_id")
    tied = member.join(twice, "vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    found = scratch.keep(stars(links.union(tied), scratch), "components")
    classes = (
        named.select("key", "rep", "copies")
        .join(counts.withColumnRenamed("a", "key"), "key", "left")
        .join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "key",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = scaled.select("vec_id", "key").join(classes, "key", "left")
    valid = F.col("vec_id").isNotNull()
    component = F.when(valid, F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id",
        F.when(valid, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings, cosine 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
