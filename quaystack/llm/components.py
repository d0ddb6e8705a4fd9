"""Connected components of an edge table, each labelled by its smallest node.

Alternating star contraction: every round turns each node's neighbourhood
towards its smallest member, first over larger neighbours, then over
smaller ones. Each round is aggregations and equi-joins that combine on the
map side or can be split for hot nodes, and is stored in the shared folder,
so lineage stays short. The driver sees one count and checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystack.session import materialise


def _towards_smallest(edges: DataFrame) -> DataFrame:
    """Large star: larger neighbours v of u point to the smallest of u's."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.join(least, "a").filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _collapse(edges: DataFrame) -> DataFrame:
    """Small star: u (larger) and its smaller neighbours point to the smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .filter("a != b").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node but roots.

    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    edges = materialise(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), "cc-edges")
    state = _state(edges)
    while state[0]:
        edges = materialise(_collapse(_towards_smallest(edges)), "cc-round")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
