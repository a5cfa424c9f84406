"""Connected components of an edge table by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from postalloom.operators.skew import join_hot
from postalloom.plans.lineage import cut

MOST_ROUNDS = 60
#: Up to so many edges no node has enough neighbours to fill a task, and the joins are left to Spark.
FEW_EDGES = 500_000


def _star(pairs: DataFrame, few: bool) -> DataFrame:
    """(u, v, low): each row of ``pairs`` with the least of u's neighbours and u itself."""
    lowest = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n"))
    return pairs.join(lowest, "u") if few else join_hot(pairs, lowest, ["u"], "n", ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v), label being the least node of its component.

    Self-loops, repeats and either direction are fine; nulls are left out. No edges give no rows. Each round is
    written to the checkpoint folder. A node with very many neighbours, as each label becomes, is joined
    by broadcast, so no task holds all its edges.
    """
    edges = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes, seen = edges, _mark(edges)
    for _ in range(MOST_ROUNDS):
        few = seen["n"] <= FEW_EDGES
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, few).where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        linked = _star(large, few)
        small = linked.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        edges, before = cut(small), seen
        seen = _mark(edges)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(edges.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("label"))


def _mark(edges: DataFrame) -> Row:
    """The number of edges and sums of their hashes: equal for equal sets."""
    h = F.xxhash64("u", "v")
    return edges.agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high")).first()
