"""Operator 8: mixing sources to target weights by systematic sampling, DataFrame functions only.

Sources, in order of their names by code point, null last, weigh 1, 2, 3, 1, 2, ...; their
targets share all words by weight, but none exceeds MOST times its source's words: what is over
goes to the others by weight until no target is above (sorted by words per weight, the sources
that end at their limit come first, so running sums settle it). A document's expected copies are
its source's target over its source's words. Within a source the expected copies are summed up
document after document, from one random offset, and a document is emitted once for each whole
number that the sum passes. Documents stand in order of size (in classes of two leading digits),
then of a hash of id and text, so each size takes its share and the words taken come near the target.

Sums are exact: expected copies count in units of 1e-12. A document's rank in its source is its
rank in its cell (source, size class, first digits of the hash) plus the counts of the cells
before, so no source is sorted in one task; rows that share an id, or have none, are told apart by
their texts, and only rows that are the same in both stand in one cell. Offsets and hashes depend on
names, ids and texts only: reruns agree.

Nulls and ties: a null text has size 0; a null source is a source of its own; null doc_ids and
repeated rows are documents like others, and which of equal rows is taken makes no difference. A
source without words has target 0. An empty table gives an empty result. Input columns named like a
result column are replaced; other names never clash. Texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm._shared import WORD, Scratch, table

MOST = 3
UNIT = 10**12
HASH_DIGITS = 2
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes (source, source_size), one row a source -> with target, a double.

    The windows hold one row for each source.
    """
    total = Window.partitionBy()
    weight = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    x = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(total) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / open_weight.cast("double")
    x = x.withColumn("full", F.col("limit").cast("double") / F.col("weight") <= level)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(total), F.lit(0))
    closed = F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(total), F.lit(0))
    words_left = (F.sum("source_size").over(total) - taken).cast("double")
    share = F.try_divide(words_left, (F.sum("weight").over(total) - closed).cast("double"))
    return x.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, source, text, other columns) -> with size, source_size, target, copies (0 to most).

    keep: which of the documents' columns the result has (all).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    own = [c for c in keep or docs.columns if c not in ("size", "source_size", "target", "copies")]
    digits = F.lpad(F.substring(F.col("size").cast("string"), 1, 2), 2, "0").cast("int")
    # The documents' own columns travel in one struct, so that no name of theirs can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc")
    mine = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    placed = (
        docs.select(row, "source", words(F.col("text")).alias("size"), F.md5(mine.cast("binary")).alias("hash"))
        # a key that no source's name equals stands for null
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("class", F.length(F.col("size").cast("string")) * 100 + digits)
        .withColumn("cell", F.substring("hash", 1, HASH_DIGITS))
    )
    by_cell = scratch.keep(
        placed.groupBy("key", "class", "cell").agg(
            F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")
        ),
        "cells",
    )
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    classes = by_cell.groupBy("key", "class").agg(F.sum("n").alias("n"))
    classes = classes.select("key", "class", F.coalesce(F.sum("n").over(ahead("key", "class")), F.lit(0)).alias("c"))
    cells = by_cell.withColumn("d", F.coalesce(F.sum("n").over(ahead("key", "class", "cell")), F.lit(0)))
    sources = by_cell.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goals = targets(sources.select("source", "source_size"), most).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target"
    )
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), "key").cast("binary")), 1, 12), 16, 10).cast("long") % UNIT
    copies_each = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")) * float(UNIT))
    plan = (
        cells.join(classes, ["key", "class"])
        .join(goals, "key")
        .select(
            "key",
            "class",
            "cell",
            (F.col("c") + F.col("d")).alias("before"),
            "source_size",
            "target",
            F.coalesce(copies_each, F.lit(0)).cast("decimal(14,0)").alias("each"),
            offset.cast("decimal(14,0)").alias("offset"),
        )
    )
    plan = scratch.keep(plan, "plan")
    rank = F.row_number().over(Window.partitionBy("key", "class", "cell").orderBy("hash", "size"))
    ranked = placed.drop("source").withColumn("rank", rank).join(plan, ["key", "class", "cell"])
    ranked = ranked.withColumn("n", (F.col("before") + F.col("rank")).cast("decimal(18,0)"))
    upto = F.expr(f"(offset + n * each) div cast({UNIT} as decimal(14,0))")
    last = F.expr(f"(offset + (n - 1) * each) div cast({UNIT} as decimal(14,0))")
    return ranked.select(
        *[F.col("doc").getField(c).alias(c) for c in own], "size", "source_size", "target", (upto - last).cast("int").alias("copies")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of mix(), each as often as its copies say."""
    each = F.explode(F.sequence(F.lit(1), "copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in mixed.columns]).alias("row")
    return mixed.where("copies > 0").select(row, each.alias("copy")).select("row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, keep=["doc_id"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source),
l AS (
  SELECT *, source_size * {MOST} AS lim, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(source_size * {MOST}) OVER w, 0) AS lim_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM s WINDOW w AS (ORDER BY (source_size * {MOST})::DOUBLE / weight, source ASC NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, lim::DOUBLE / weight <= (total - lim_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS full_up FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN full_up THEN lim::DOUBLE
              ELSE (total - coalesce(sum(CASE WHEN full_up THEN lim END) OVER (), 0))::DOUBLE
                   / nullif((all_weight - coalesce(sum(CASE WHEN full_up THEN weight END) OVER (), 0))::DOUBLE, 0) * weight
         END AS target
  FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(floor(t.target / nullif(t.source_size::DOUBLE, 0) * 1e12), 0)::HUGEINT AS each,
         (('0x' || substr(md5('{SEED}' || coalesce('=' || d.source, '')), 1, 12))::BIGINT % {UNIT})::HUGEINT AS off,
         row_number() OVER (PARTITION BY d.source ORDER BY
           length(d.size::VARCHAR) * 100 + lpad(substr(d.size::VARCHAR, 1, 2), 2, '0')::INT, h, d.size)::HUGEINT AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (((off + n * each) // {UNIT} - (off + (n - 1) * each) // {UNIT}) * size)::BIGINT AS taken
FROM r
"""
