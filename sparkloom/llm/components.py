"""Connected components by repeated contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that its links reach.

    Each round points every node at its smallest neighbour, follows the pointers once and contracts the
    edges, so chains and stars alike end after about log n rounds. A hub's neighbours are reduced by a
    map-side minimum. Self-links, repeats and null ends are ignored; no edges give no rows.
    """
    pair = edges.where((F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stored(pair.distinct())
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        onward = nearest.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = stored(nearest.join(onward, "p").select("a", F.col("pp").alias("p")))
        at = lambda end: parent.select(F.col("a").alias(end), F.col("p").alias(f"p_{end}"))
        moved = left.join(at("a"), "a").join(at("b"), "b").where(F.col("p_a") != F.col("p_b"))
        left = stored(moved.select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).distinct())
        if found is None:
            found = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("a").alias("component"), F.col("p").alias("_next"))
            found = found.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stored(found)
