"""Connected components of an edge table, by contraction.

In every round each node picks, among itself and its neighbours, the one with the most edges, and
of equals the one with the least hash of that round; the edges are carried over to the picked
nodes. A star is one node after a round, and with a fresh hash order each round a path falls by a
constant factor in expectation. Picking is an aggregation with partial results, and edges of a hub
are only ever joined to its one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm.tables import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the (a, b) edges; ``component`` is its smallest node."""
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots, round_ = None, 0
    while edges.take(1):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degrees = saved(both.groupBy("a").agg(F.count("*").alias("d")), "cc-degrees")
        order = lambda c, d: F.struct((-F.col(d)).alias("d"), F.xxhash64(F.lit(round_), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        best = (
            both.join(degrees.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
            .groupBy("a")
            .agg(F.min(order("b", "e")).alias("m"))
        )
        picked = saved(
            best.join(degrees, "a").select(F.col("a").alias("node"), F.least(order("a", "d"), F.col("m"))["v"].alias("pick")),
            "cc-picks",
        )
        left = picked.select(F.col("node").alias("a"), F.col("pick").alias("pa"))
        right = picked.select(F.col("node").alias("b"), F.col("pick").alias("pb"))
        before = edges
        edges = saved(
            edges.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "cc-edges",
        )
        discard(before)
        if roots is None:
            roots = picked.select("node", F.col("pick").alias("root"))
        else:
            later = picked.select(F.col("node").alias("_n"), "pick")
            roots = saved(
                roots.join(later, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("pick", "root").alias("root")),
                "cc-roots",
            )
        round_ += 1
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
