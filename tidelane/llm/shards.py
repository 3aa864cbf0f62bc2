"""Operator 6: a uniform shuffle into shards of exact sizes (law "rows"), DataFrame functions only.

A uniform permutation of all rows, cut into shards, sends a hypergeometric number of each source
partition's rows to each shard. So the matrix of these counts is drawn first, from the
partitions' row counts alone (at most MOST_SOURCES of them, by the shards; this small matrix is all that the driver
holds). Each partition's rows are then put in random order and dealt to the shards by the
matrix, and each shard's rows are put in random order again. Every order of all rows is equally likely, and
shard sizes differ by one at most by construction.

The random keys of a row are drawn once and written with the row's digest, so a task that runs
again reads the same ones. The last order is ranked within (shard, stretch of the key) and
shifted by the stretches' counts, so no shard is sorted in one task. The same seed over the same
partitions of input gives the same result.

Nulls and ties: a null text counts no bytes; a null doc_id is a row like others; repeated rows
are dealt apart like any rows. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm._shared import Scratch, table, u32

SHARDS = 40
MOST_SOURCES = 4096
#: Rows that one task ranks at a time, about.
STRETCH = 100_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    top = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - top
    down, up, p_down, p_up = mode, mode, top, top
    while u >= 0 and (down > low or up < high) and max(p_down, p_up) > 0:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows sent from each source to each shard; row sums are counts, column sums at most one apart."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    rng.shuffle(room)
    out = []
    for n in counts:
        left, rest, row = n, sum(room), []
        for j in range(shards):
            rest -= room[j]
            k = hypergeometric(rng, room[j], rest, left)
            row.append(k)
            left -= k
        room = [r - k for r, k in zip(room, row)]
        out.append(row)
    return out


def shuffle_rows(rows: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """rows with two more columns: shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Columns of these names in rows are replaced.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "shards")
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = scratch.keep(
        rows.select(
            F.struct(*own).alias("row") if own else F.struct(F.lit(1).alias("_")).alias("row"),
            F.pmod(F.spark_partition_id(), F.lit(MOST_SOURCES)).alias("part"),
            F.rand(seed).alias("first"),
            F.rand(seed + 1).alias("second"),
        ),
        "keyed",
    )
    counts = {r.part: r.n for r in keyed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    drawn = matrix([counts[p] for p in sorted(counts)], shards, seed)
    bounds = [
        {"part": p, "upto": [sum(row[: j + 1]) for j in range(shards)]} for p, row in zip(sorted(counts), drawn)
    ]
    kind = "array<struct<part: int, upto: array<bigint>>>"
    bounds = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(bounds)), kind)))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("first", "second")))
    stretches = max(16, math.ceil(sum(counts.values()) / shards / STRETCH))
    # At most MOST_SOURCES rows of one array: a proven bound.
    dealt = ranked.join(F.broadcast(bounds), "part").select(
        "row",
        "second",
        F.size(F.filter("upto", lambda x: x < F.col("rank"))).alias("shard"),
        F.floor(F.col("second") * stretches).cast("int").alias("stretch"),
    )
    dealt = scratch.keep(dealt, "dealt")
    scratch.drop(keyed)
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "stretch").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("second"))
    out = dealt.withColumn("place", place).join(starts, ["shard", "stretch"])
    return out.select(*[F.col("row")[c].alias(c) for c in own], "shard", (F.col("start") + F.col("place") - 1).alias("slot"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, law "rows"."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        u32(F.col("text")).alias("text_crc32"),
    )
    return shuffle_rows(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
