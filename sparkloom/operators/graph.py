"""Recursion and graphs by rounds of joins: hierarchies, closure, shortest paths, pattern matching, triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import block_join
from sparkloom.session import kept


def hierarchy(nodes: DataFrame, node: str, parent: str, roots: DataFrame) -> DataFrame:
    """CONNECT BY: (node, root, level, path, is_cycle) from the roots down. A node that is on its own path is reported
    once as a cycle and not followed, so that the levels end by themselves, however deep they are."""
    edges = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    level = kept(roots.select(F.col(node).alias("node"), F.col(node).alias("root"), F.lit(1).alias("level"), F.array(F.col(node)).alias("path"), F.lit(False).alias("is_cycle")))
    found, depth = level, 1
    while True:
        step = level.where(~F.col("is_cycle")).join(edges, F.col("node") == F.col("_p"))
        level = kept(step.select(
            F.col("_n").alias("node"), "root", (F.col("level") + 1).alias("level"),
            F.concat("path", F.array("_n")).alias("path"), F.array_contains("path", F.col("_n")).alias("is_cycle"),
        ))
        if level.isEmpty():
            return found
        found, depth = found.unionByName(level), depth + 1
        if depth % 32 == 0:  # so that the plan does not grow with the depth
            found = kept(found)


def search_order(found: DataFrame, kind: str = "depth", name: str = "search_order") -> DataFrame:
    """SEARCH DEPTH / BREADTH FIRST BY node SET name over hierarchy(): a column to order by. Depth first it is the path, breadth
    first the level with the node; both are values, so that nothing is numbered in one task."""
    if kind not in ("depth", "breadth"):
        raise ValueError(f"kind must be depth or breadth, not {kind}")
    return found.withColumn(name, F.col("path") if kind == "depth" else F.struct("level", "node"))


def leaves(found: DataFrame) -> DataFrame:
    """hierarchy() with is_leaf (CONNECT_BY_ISLEAF): rows that no row's path goes on from."""
    inner = found.where("level > 1").select("root", F.slice("path", 1, F.size("path") - 1).alias("path"), F.lit(True).alias("_inner")).distinct()
    return found.join(inner, ["root", "path"], "left").withColumn("is_leaf", F.col("_inner").isNull()).drop("_inner").select(*found.columns, "is_leaf")


def reachable(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, hops): the fewest hops from each source to every node that it reaches, itself at 0. Cycles end by themselves.
    With `most`, edges are followed for that many hops only, as WHERE hops < most does in a recursive CTE."""
    known = kept(sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("hops")).distinct())
    front, depth = known, 0
    links = edges.select("src", "dst").distinct()
    while most is None or depth < most:
        step = front.join(links, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        front = kept(step.join(known.select("source", "node"), ["source", "node"], "left_anti"))
        if front.isEmpty():
            return known
        known, depth = known.unionByName(front), depth + 1  # each front is written once
        if depth % 32 == 0:
            known = kept(known)
    return known


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str, most: float | None = None) -> DataFrame:
    """(source, node, distance) over non-negative weights; each round relaxes only what became nearer in the last one.
    With `most`, paths go on from nodes nearer than that only, as WHERE d < most does in a recursive CTE."""
    best = kept(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")).distinct())
    front = best
    while True:
        step = (front if most is None else front.where(F.col("distance") < most)).join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col(weight)).alias("_d"))
        front = kept(step.join(best, ["source", "node"], "left").where(F.col("distance").isNull() | (F.col("_d") < F.col("distance"))).select("source", "node", F.col("_d").alias("distance")))
        if front.isEmpty():
            return best
        best = kept(best.unionByName(front).groupBy("source", "node").agg(F.min("distance").alias("distance")))


def match(vertices: DataFrame, edges: DataFrame, pattern: list[tuple[str, dict | None, str, dict | None]], start: tuple[str, dict | None]) -> DataFrame:
    """A chain of graph-pattern steps as joins. start and each step name a vertex variable and its labels; a step is
    (direction '->', '<-' or '-', edge properties, variable, vertex properties). Columns are <variable>_id. Edges are cut to
    those that end in a wanted vertex before they are followed, and a vertex with many on both sides is passed in blocks."""

    def chosen(df: DataFrame, wanted: dict | None) -> DataFrame:
        for k, v in (wanted or {}).items():
            df = df.where(F.col(k) == v)
        return df

    last = f"{start[0]}_id"
    found = chosen(vertices, start[1]).select(F.col("id").alias(last))
    for direction, properties, name, wanted in pattern:
        e = chosen(edges, properties)
        out = e.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
        back = e.select(F.col("dst").alias("_a"), F.col("src").alias("_b"))
        step = out if direction == "->" else back if direction == "<-" else out.unionByName(back)
        ends = chosen(vertices, wanted).select(F.col("id").alias(f"{name}_id"))
        reach = step.join(ends, F.col("_b") == F.col(f"{name}_id")).drop("_b")
        found = block_join(kept(found), kept(reach), [(last, "_a")]).drop("_a")
        last = f"{name}_id"
    return found


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, of an undirected graph. Edges point from the end of lower degree, so that hubs are not expanded."""
    e = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x != y").distinct()
    degree = e.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    d = e.join(degree.select(F.col("v").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("v").alias("y"), F.col("d").alias("dy")), "y")
    low = F.struct("dx", "x") < F.struct("dy", "y")
    directed = d.select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("s"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("t"))
    two = directed.alias("p").join(directed.alias("q"), (F.col("p.s") == F.col("q.s")) & (F.col("p.t") < F.col("q.t"))).select(F.col("p.s").alias("u"), F.col("p.t").alias("x"), F.col("q.t").alias("y"))
    closed = two.join(e, ["x", "y"])
    three = F.array_sort(F.array("u", "x", "y"))
    return closed.select(three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def four_cliques(edges: DataFrame) -> DataFrame:
    """(a, b, c, d), a < b < c < d, all joined with each other: two triangles on one edge whose other corners are joined."""
    e = edges.select(F.least("src", "dst").alias("c"), F.greatest("src", "dst").alias("d")).where("c != d").distinct()
    three = kept(triangles(edges))
    return three.join(three.withColumnRenamed("c", "d"), ["a", "b"]).where("c < d").join(e, ["c", "d"], "left_semi").select("a", "b", "c", "d")
