"""Connected components of a graph given as a table of edges, without a driver-side step.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every node points all its
larger neighbours at its smallest one, then all its smaller ones.  The rounds end when the edges
are stars with the smallest node of each component in the middle: no round would change them.
Minima are taken by partial aggregation.  From SPLIT edges on a node with very many of them is joined
by broadcast (``with_group``), so its edges stay in the tasks that have read them; fewer edges than
that, 16 bytes each, are no load for a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_group
from .scratch import forget, keep

ROUNDS = 100
SPLIT = 1_000_000


def _star(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """One round over rows (u, v), u < v, each edge once; there are ``total`` of them."""

    def joined(rows: DataFrame, key: str) -> DataFrame:
        return rows.join(least.drop("n"), key) if total < SPLIT else with_group(rows, least, [key], "n", total)

    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        moved = joined(both.filter("v > u"), "u").select(F.col("m").alias("u"), "v")
    else:
        least = edges.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = joined(edges, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
        moved = moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return moved.filter("u < v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether rows (u, v), u < v, each edge once, are stars: every v has one edge and is no u."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.count_if(F.col("down") + F.col("up") > 1)).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with an edge, from rows (u, v); root is the smallest node.

    Loops, repeated edges and either order of the ends are fine, edges with a null end are no
    edges; no edges, no rows.  The result is a kept table, which the caller may forget.
    """
    now = keep(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    if total := now.count():
        for _ in range(ROUNDS):
            large = keep(_star(now, True, total), "large")
            forget(now)
            now = keep(_star(large, False, total), "small")
            forget(large)
            if _settled(now):
                break
        else:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    out = keep(now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()), "roots")
    forget(now)
    return out


def forest(left, right):
    """Edges (node, root) of the components of edges given as two arrays of numbers, in memory."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(parent) if root(x) != x]
