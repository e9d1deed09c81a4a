"""Connected components of an edge table by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is its smallest reachable node.

    Each round points every node at smaller nodes near it; the number of rounds grows with the
    logarithm of the longest path. A round is two aggregations and two joins on the node, so a
    hub with a large share of the edges is only a skewed join key. No edges: no rows.
    """
    now = saved(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Larger neighbours of a node go to the smallest node around it.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # Smaller neighbours of a node, and the node, go to the smallest of them.
        small = large.join(least, "a")
        now = saved(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # What is left are stars: every node beside its component's smallest.
    return now.groupBy("a").agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("a"), F.col("b").alias("component")).distinct()).withColumnRenamed("a", "node").groupBy("node").agg(F.min("component").alias("component"))


def merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b): the links are contracted to pairs of components first, so that parallel ones count once."""
    if component is None:
        return components(links)
    of = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    contracted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    up = saved(components(contracted), "components").select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = component.join(up, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = up.join(component, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return moved.unionByName(fresh)
