"""Connected components of a graph of integer nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots; a root is its component's smallest node.

    Each round is two aggregations by node with partial minima and two joins back; rows never outgrow the edges, a node's
    neighbours are never gathered, and what a round leaves is a written table. A node of many edges, such as the centre of a
    star, is one row on the aggregated side of the joins, so that adaptive execution can split its edges over tasks. Rounds
    go on until one changes nothing: every other round lowers some node's smallest neighbour, so that comes. Loops and
    repeated edges change nothing; edges with a null end are left out; no edges give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFF))).first()
        if mark == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
