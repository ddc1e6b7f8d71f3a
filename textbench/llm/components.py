"""Distributed union-find: alternating star contractions as DataFrame joins.

Each round hangs every node below the smallest node it sees; a round is two
aggregations with map-side combine and two equi-joins, so a hub with a third
of all edges is pre-aggregated for its minimum and its edges can be split by
the adaptive skew join.  The edge list of each round is written to the shared
folder, so lineage never grows and no executor's loss repeats earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.common import materialise


def _is_star_forest(edges: DataFrame) -> bool:
    """True if each node hangs below one root and no root hangs below another."""
    seen = edges.select(F.col("u").alias("n"), F.lit(1).alias("child")).unionAll(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("child")))
    per = seen.groupBy("n").agg(F.sum("child").alias("c"), F.min("child").alias("m"))
    return per.where((F.col("c") > 1) | ((F.col("c") == 1) & (F.col("m") == 0))).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link: component is the smallest
    node reachable.  Null ends and self links are ignored; repeated links are
    harmless.  An empty input gives an empty result."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    e = e.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("u") > F.col("v"))).select("u", "v")
    e = materialise(e.distinct(), "edges")
    while not _is_star_forest(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        low = low.select("x", F.least("x", "m").alias("m"))
        # large star: every larger neighbour of x hangs below the smallest node around x
        # (an edge (u, v), u > v, is a larger neighbour u of x = v)
        large = e.join(low, e["v"] == low["x"]).select("u", F.col("m").alias("v"))
        # small star: every smaller neighbour of u, and u, hang below the smallest
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, large["u"] == least["x"]).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("x").alias("u"), F.col("m").alias("v")))).alias("p")
        ).select("p.u", "p.v").where("u != v").distinct()
        e = materialise(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
