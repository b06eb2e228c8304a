"""Minimum cuts of graphs that no task holds: spanning forests show which edges no lighter cut can separate."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, Weight
from weftgraph.operators import kernels as K
from weftgraph.operators import local
from weftgraph.operators.components import labels
from weftgraph.operators.trees import minimum_spanning_edges
from weftgraph.plans.fixpoint import checkpoint, written

#: Vertices of a graph that goes to the kernel at once: it takes time with their cube (2,000 some seconds).
SMALL = 1_000
#: Vertices that the kernel takes where nothing can be contracted: a matrix of 800 MB. More are refused.
MOST = 10_000


def minimum_cut(graph: Graph, weight: Weight = None) -> tuple[float, DataFrame] | None:
    """The weight of a lightest cut and one side of it (id); None for fewer than two vertices.

    Heaviest spanning forests are taken out of the graph one after another. The ends of an edge of weight w in the k-th
    forest are joined by k edge-disjoint paths of edges no lighter than w, itself among them, so no cut below k * w
    separates them; for an edge left over after k forests the bound is (k + 1) * w. Edges whose bound reaches the
    lightest cut seen so far (a single vertex, to begin with) are contracted, parallel edges added up, and forests
    taken from what is left, until SMALL or fewer vertices go to the kernel. Before forests, vertices that hang by half of
    their weight or more from one neighbour are contracted with it (:func:`_leaning`). Weights that are no numbers count as
    0, and negative ones are refused. Where forests use up all edges and contract nothing, the kernel takes the
    graph, up to MOST vertices.
    """
    arcs = graph.with_(directed=True).weighted(weight, 1.0).where("src != dst")
    arcs = arcs.select("src", "dst", F.nanvl(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    if not arcs.where("w < 0").isEmpty():
        raise ValueError("a negative weight")
    names = checkpoint(graph.V.select("id", F.col("id").alias("at")))
    edges = _added(arcs.where("w > 0"))
    if names.limit(2).count() < 2:
        return None
    parts = checkpoint(labels(_graph(names.select(F.col("at").alias("id")), edges)))
    first, last = parts.agg(F.min("component"), F.max("component")).head()
    if first != last:
        return 0.0, parts.where(F.col("component") == first).select("id")
    best = side = None
    while not edges.isEmpty():
        ends = checkpoint(edges.select(F.col("src").alias("at"), "w").union(edges.select("dst", "w")).groupBy("at").agg(F.sum("w").alias("w")))
        low = ends.orderBy("w", "at").head()
        if best is None or low.w < best:
            best, side = low.w, names.where(F.col("at") == low.at).select("id")
        joined = None
        n = ends.count()
        if n > SMALL:
            joined = _leaning(edges, ends)
            if joined is None or 10 * joined.count() < n:
                joined = _inseparable(edges, best, n) or joined
        if joined is None:
            if n > MOST:
                raise ValueError(f"no edge can be contracted and {n} vertices are left: the kernel takes {MOST}")
            g = _graph(ends.select(F.col("at").alias("id")), edges)
            found = checkpoint(local.as_whole(g, K.min_cut, "value double, side array<bigint>", "payload"))
            value = found.select("value").head()[0]
            if value < best:
                best, side = value, names.join(found.select(F.explode("side").alias("at")), "at", "left_semi").select("id")
            break
        # the ends of contracted edges take the least id of their group; the rest keep their own
        group = labels(_graph(ends.select(F.col("at").alias("id")), joined)).select(F.col("id").alias("at"), F.col("component").alias("to"))
        group = checkpoint(group)
        names = checkpoint(names.join(group, "at").select("id", F.col("to").alias("at")))
        a, b = (group.select(F.col("at").alias(k), F.col("to").alias(k[0])) for k in ("src", "dst"))
        edges = _added(edges.join(a, "src").join(b, "dst").where("s != d").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"))
    return float(best), side


def _added(pairs: DataFrame) -> DataFrame:
    """src < dst, w: parallel edges added up; kept in the checkpoint folder."""
    return written(pairs.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w")))


def _graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    E = edges.select(F.monotonically_increasing_id().alias("eid"), "src", "dst", F.col("w").alias("payload"))
    return Graph(nodes.select("id", F.lit(None).cast("string").alias("payload")), E)


def _leaning(edges: DataFrame, ends: DataFrame) -> DataFrame | None:
    """src, dst, w: edges that carry half of the weight of src or more, or None if there are none.

    Any cut but that of src alone stays as light if src changes to the side of dst. That holds for many at once if no
    dst is itself a src, so a coin parts the vertices; and a side of such vertices alone weighs at least half of their
    weights together, so no less than the lightest of them alone.
    """
    both = edges.select("src", "dst", "w").union(edges.select("dst", "src", "w"))
    heavy = checkpoint(both.join(ends.select(F.col("at").alias("src"), F.col("w").alias("all")), "src").where("2 * w >= all").select("src", "dst", "w"))
    if heavy.isEmpty():
        return None
    for salt in count():
        coin = [F.xxhash64(c, F.lit(salt)).bitwiseAND(F.lit(1)) for c in ("src", "dst")]
        chosen = heavy.where((coin[0] == 1) & (coin[1] == 0)).groupBy("src").agg(F.max(F.struct("w", "dst")).alias("t"))
        chosen = checkpoint(chosen.select("src", "t.dst", "t.w"))
        if not chosen.isEmpty():
            return chosen


def _inseparable(edges: DataFrame, best: float, n: int) -> DataFrame | None:
    """src, dst, w of edges that no cut below ``best`` separates, as soon as they touch a tenth of the ``n`` vertices;
    fewer only if forests have used up all edges, and None if there are none."""
    rest = written(edges.withColumn("eid", F.monotonically_increasing_id()))
    found, k = None, 0
    while True:
        k += 1
        g = Graph.from_edges(rest.select("eid", "src", "dst", (-F.col("w")).alias("payload")))
        tree = checkpoint(minimum_spanning_edges(g, "payload").select("eid", "src", "dst", (-F.col("w")).alias("w")))
        sure = tree.where(k * F.col("w") >= best).select("src", "dst", "w")
        found = sure if found is None else found.union(sure)
        rest = written(rest.join(tree.select("eid"), "eid", "left_anti"))
        both = checkpoint(found.union(rest.where((k + 1) * F.col("w") >= best).select("src", "dst", "w")))
        touched = both.select("src").union(both.select("dst")).distinct().count()
        if 10 * touched >= n or rest.isEmpty():
            return both if touched else None
