"""Fundamental cycles of a spanning forest by lowest common ancestors, and paths written out by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import shallow
from weftgraph.operators.euler import climb, lifted, lowest_common_ancestors, rooted
from weftgraph.operators.trees import minimum_spanning_edges
from weftgraph.plans.fixpoint import checkpoint, meet


def fundamental_cycles(graph: Graph, root: int | None = None) -> DataFrame:
    """cycle array<bigint>: for each pair of vertices that an edge outside the forest joins, the edge's ends and the forest
    path between them, by way of their lowest common ancestor; self-loops are cycles of one vertex. Parallel
    edges close no cycle. Vertices carry their component as payload; with ``root`` only its component counts,
    hung from it."""
    if root is not None:
        part = graph.V.where(F.col("id") == root).select("payload")
        V = graph.V.join(F.broadcast(part), "payload", "left_semi")
        graph = graph.with_(checkpoint(V.select("id", F.lit(root).cast("bigint").alias("payload"))), graph.E.join(V.select(F.col("id").alias("src")), "src", "left_semi").select("eid", "src", "dst", "payload"))
    pairs = graph.E.select("eid", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).groupBy("src", "dst").agg(F.min("eid").alias("eid"))
    pairs = checkpoint(pairs.select("eid", "src", "dst"))
    loops = pairs.where("src = dst").select(F.array("src").alias("cycle"))
    low = shallow.forest(pairs, graph.V.where("id = payload").select("id"), graph.V.count())
    if low is not None:  # short cycles; those of any spanning forest may be as long as its paths
        return shallow.cycles(pairs.where("src != dst"), low).union(loops)
    tree = checkpoint(minimum_spanning_edges(graph.with_(E=pairs.withColumn("payload", F.lit(1.0)))).select("eid", "src", "dst"))
    forest = rooted(tree, graph.V.where("id = payload").select("id"))
    rest = pairs.where("src != dst").join(tree.select("eid"), "eid", "left_anti").select("eid", F.col("src").alias("u"), F.col("dst").alias("w"))
    tables = lifted(forest)
    top = lowest_common_ancestors(checkpoint(rest), forest, tables)
    deep = forest.select("id", "depth")
    for end in ("u", "w", "lca"):
        top = meet(top, deep.select(F.col("id").alias(end), F.col("depth").alias(f"d_{end}")), end)
    top = checkpoint(top.select("eid", "u", "w", (F.col("d_u") - F.col("d_lca")).alias("left"), (F.col("d_w") - F.col("d_lca")).alias("right")))
    # u and its ancestors up to the common one, then down to w: every place is so many steps above u or w
    left = top.select("eid", F.col("u").alias("v"), F.explode(F.expr("sequence(0L, left)")).alias("steps"), F.lit(0).cast("bigint").alias("from"))
    right = top.where("right > 0").select("eid", F.col("w").alias("v"), F.explode(F.expr("sequence(0L, right - 1)")).alias("steps"), (F.col("left") + F.col("right")).alias("from"))
    spots = left.select("eid", "v", "steps", F.col("steps").alias("pos")).union(right.select("eid", "v", "steps", F.col("from") - F.col("steps")))
    found = climb(checkpoint(spots), "v", F.col("steps"), tables)
    return found.groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c")).select(F.col("c.v").alias("cycle")).union(loops)


def chain_up(tables: list[DataFrame], head: DataFrame) -> DataFrame:
    """pos, id: the vertices of ``head`` (id) and all their ancestors, pos steps above; the rows double with each table."""
    rows = head.select(F.lit(0).cast("bigint").alias("pos"), "id")
    for k, table in enumerate(tables):
        rows = checkpoint(rows.union(rows.join(table, "id").select(F.col("pos") + (1 << k), "up")))
    return rows
