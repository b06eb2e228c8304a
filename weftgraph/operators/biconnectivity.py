"""Blocks, bridges and cut vertices after Tarjan and Vishkin, for components that no task could hold.

Of a rooted spanning forest every vertex but the roots stands for the edge to its parent. ``low`` and ``high`` are
the least and greatest preorder numbers that edges outside the forest join to a vertex's subtree. Two
forest edges lie in one block if a chain of these conditions links them:

* an edge outside the forest joins two vertices of which neither is an ancestor of the other: their edges;
* the subtree of a child reaches beyond its parent's subtree: the child's edge and the parent's.

Components of small diameter have the shorter form of :mod:`weftgraph.operators.shallow`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import shallow
from weftgraph.operators.euler import range_extremes, rooted
from weftgraph.operators.trees import minimum_spanning_edges
from weftgraph.plans.fixpoint import checkpoint, meet


def reached(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """The rooted forest (id, parent, via, pre, size, depth, low, high) and the edges outside it (eid, a, b, pa, pb, za) with
    pa < pb, the preorder numbers of their ends, and za, the size of a's subtree. Vertices carry their component as payload."""
    tree = checkpoint(minimum_spanning_edges(graph).select("eid", "src", "dst"))
    forest = rooted(tree, graph.V.where("id = payload").select("id"))
    n = forest.count()
    spot = forest.select("id", "pre", "size")
    rest = graph.E.where("src != dst").join(tree.select("eid"), "eid", "left_anti").select("eid", "src", "dst")
    rest = meet(meet(rest, spot.select(F.col("id").alias("src"), F.col("pre").alias("ps"), F.col("size").alias("zs")), "src"), spot.select(F.col("id").alias("dst"), F.col("pre").alias("pd"), F.col("size").alias("zd")), "dst")
    first = F.col("ps") < F.col("pd")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    rest = checkpoint(rest.select("eid", pick("src", "dst").alias("a"), pick("dst", "src").alias("b"), pick("ps", "pd").alias("pa"), pick("pd", "ps").alias("pb"), pick("zs", "zd").alias("za")))
    values = forest.select(F.col("pre").alias("pos"), F.col("pre").alias("x")).union(rest.select("pa", "pb")).union(rest.select("pb", "pa"))
    values = values.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    far = range_extremes(values, forest.where("parent IS NOT NULL").select("id", F.col("pre").alias("start"), "size"), n)
    return checkpoint(forest.join(far.select("id", F.col("lo").alias("low"), F.col("hi").alias("high")), "id", "left")), rest


def _shallow(graph: Graph) -> tuple[DataFrame, DataFrame | None, int]:
    """The ends of all edges, the breadth-first forest where it is shallow, and the number of vertices."""
    ends, n = shallow.pairs(graph.E), graph.V.count()
    return ends, shallow.hung(ends, graph.V.where("id = payload").select("id"), n), n


def bridges(graph: Graph) -> DataFrame:
    """src, dst of forest edges whose lower subtree no other edge leaves."""
    ends, tree, n = _shallow(graph)
    if tree is not None:
        return shallow.bridges(graph, ends, tree, n)
    forest, _ = reached(graph)
    cut = forest.where("parent IS NOT NULL AND low >= pre AND high < pre + size").select(F.col("via").alias("eid"))
    return graph.E.join(cut, "eid", "left_semi").select("src", "dst")


def blocks(graph: Graph) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(id, parent, block) of the forest's edges, and what gives eid, src, dst, block of every edge but loops; block is a vertex id."""
    from weftgraph.operators.components import labels

    ends, tree, n = _shallow(graph)
    if tree is not None:
        low = shallow.blocks(ends, tree, n)
        return low.select("id", "parent", "block"), lambda: shallow.of_edges(graph.E, low, tree.where("parent IS NULL"))
    forest, rest = reached(graph)
    down = forest.where("parent IS NOT NULL")
    above = down.select(F.col("id").alias("parent"), F.col("pre").alias("pp"), F.col("size").alias("zp"))  # parents that are no roots
    out = meet(down.select("id", "parent", "low", "high"), above, "parent").where("low < pp OR high >= pp + zp").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    across = rest.where("pb >= pa + za").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = checkpoint(out.union(across).distinct())
    same = checkpoint(labels(Graph.from_edges(links, down.select("id"))).withColumnRenamed("component", "block"))
    tree = checkpoint(down.select("id", "parent", "via").join(same, "id"))

    def edges() -> DataFrame:
        named = tree.select(F.col("via").alias("eid"), "block").union(meet(rest.select("eid", F.col("b").alias("id")), same, "id").select("eid", "block"))
        return checkpoint(graph.E.select("eid", "src", "dst").join(named, "eid"))

    return tree.select("id", "parent", "block"), edges
