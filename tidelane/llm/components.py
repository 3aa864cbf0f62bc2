"""Connected components of a graph by alternating star contractions (DataFrame joins only).

Large-star ties every larger neighbour of a node to the node's least neighbour; small-star does
so for the smaller ones. Their alternation ends in stars around each component's least node,
after a number of rounds that grows with the logarithm of the longest path. A round writes its
edges to the shared folder, which cuts the lineage. Hubs of many edges are aggregated before the
shuffle for the minimum, and the join that follows is one whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm._shared import Scratch


def _to_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def stars(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b): pairs of long ids. Returns (id, component), for nodes other than the least.

    Self links and repeated links do no harm; null ends are ignored. Ids without links and the
    least id of each component are left out: they are their own component.
    """
    edges = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        near = _to_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", "m"))
        after_edges = scratch.keep(small.where("u <> v").distinct(), "edges")
        after = print_of(after_edges)
        scratch.drop(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
