"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonelens.llm.common import join_hot
from clonelens.session import staged


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Each round first links all larger neighbours of a node to the smallest node
    of its neighbourhood, then does the same among smaller neighbours; the edges
    end as stars around the smallest nodes.  Rounds are staged, their number
    grows with the logarithm of the longest path.  A hub's edges are not moved
    to one task (``join_hot``).  Nodes without a link are not returned.
    """
    larger = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = staged(larger.filter("u <> v").distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = staged(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links-both")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        spread = join_hot(both, staged(least, "links-least"), ["u"], "n", 2 * before[0])
        large = spread.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "links-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = join_hot(large, staged(down, "links-down"), ["u"], "n", before[0])
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(moved.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
