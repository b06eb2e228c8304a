"""Searches from many sources at once, by joins keyed (source, vertex).

The measures that need a search from every vertex broadcast the graph where it is small enough
(:func:`weftgraph.operators.local.fan_out`). Beyond that bound they use these forms: nothing is
broadcast, sources go in batches so that one batch's rows bound the disk that is held, and only
sums are kept of each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.fixpoint import checkpoint

#: Sources that are searched from at once; a batch holds a row per source and vertex that it reaches.
SOURCES = 4096


def batches(sources: DataFrame) -> Iterator[DataFrame]:
    """The sources (id) in parts of about SOURCES."""
    n = -(-sources.count() // SOURCES)
    for k in range(n):
        yield checkpoint(sources.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).select("id"))


def forward(arcs: DataFrame, sources: DataFrame, avoid: DataFrame | None = None) -> list[DataFrame]:
    """The levels of breadth-first searches over ``arcs`` (src, dst, m parallel edges): (s, id, sigma, clean) each.

    sigma counts the shortest paths from s, clean those of them that pass no vertex of ``avoid`` (id).
    """
    front = checkpoint(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma"), F.lit(1.0).alias("clean")))
    levels, seen = [front], front.select("s", "id")
    while True:
        step = arcs.join(front.withColumnRenamed("id", "src"), "src").groupBy("s", F.col("dst").alias("id"))
        step = step.agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"), F.sum(F.col("clean") * F.col("m")).alias("clean"))
        if avoid is not None:
            step = step.join(avoid.select("id", F.lit(0.0).alias("no")), "id", "left").select("s", "id", "sigma", F.coalesce("no", "clean").alias("clean"))
        front = checkpoint(step.join(seen, ["s", "id"], "left_anti"))
        if front.isEmpty():
            return levels
        levels.append(front)
        seen = seen.union(front.select("s", "id"))


def backward(arcs: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """From arcs (src, dst, m): (s, id, delta) of all vertices, and (src, dst, c), the dependencies of vertices and of arcs."""
    deep = checkpoint(levels[-1].select("s", "id", "sigma", F.lit(0.0).alias("delta")))
    deltas, parts = deep.select("s", "id", "delta"), None
    for up in reversed(levels[:-1]):
        pairs = arcs.join(deep.select("s", F.col("id").alias("dst"), F.col("sigma").alias("sw"), "delta"), "dst")
        pairs = checkpoint(pairs.join(up.select("s", F.col("id").alias("src"), "sigma"), ["s", "src"]).select("s", "src", "dst", "m", (F.col("sigma") / F.col("sw") * (1 + F.col("delta"))).alias("c")))
        of_arcs = pairs.groupBy("src", "dst").agg(F.sum("c").alias("c"))
        parts = of_arcs if parts is None else parts.union(of_arcs)
        sums = pairs.groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("c") * F.col("m")).alias("delta"))
        deep = checkpoint(up.select("s", "id", "sigma").join(sums, ["s", "id"], "left").select("s", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        deltas = deltas.union(deep.select("s", "id", "delta"))
    if parts is None:
        parts = arcs.limit(0).select("src", "dst", F.lit(0.0).alias("c"))
    return deltas, parts


def merged_arcs(graph: Graph) -> DataFrame:
    return checkpoint(graph.arcs().groupBy("src", "dst").agg(F.count("*").alias("m")))


def over_sources(graph: Graph, sums: Callable[[DataFrame, DataFrame], DataFrame], sources: DataFrame | None = None) -> DataFrame:
    """The union of ``sums(arcs, batch)`` over all batches; each is written when it is done."""
    arcs, out = merged_arcs(graph), None
    for batch in batches(graph.V.select("id") if sources is None else sources):
        part = checkpoint(sums(arcs, batch))
        out = part if out is None else out.union(part)
    return sums(arcs, graph.V.select("id").limit(0)) if out is None else out


def hops(graph: Graph) -> DataFrame:
    """s, id, dist (edges) of every pair that is joined by a path, a vertex with itself at 0."""
    def sums(arcs, batch):
        out = None
        for d, level in enumerate(forward(arcs, batch)):
            one = level.select("s", "id", F.lit(d).cast("double").alias("dist"))
            out = one if out is None else out.union(one)
        return out

    return over_sources(graph, sums)


def reach_sums(graph: Graph) -> DataFrame:
    """s, r, total: how many other vertices each source reaches, and the sum of its distances to them."""
    def sums(arcs, batch):
        out = None
        for d, level in enumerate(forward(arcs, batch)):
            one = level.groupBy("s").agg(F.count("*").alias("n")).select("s", (F.col("n") if d else F.lit(0).cast("bigint")).alias("r"), (F.col("n") * d).cast("double").alias("total"))
            out = one if out is None else out.union(one)
        return out.groupBy("s").agg(F.sum("r").alias("r"), F.sum("total").alias("total"))

    return over_sources(graph, sums)


def vertex_dependencies(graph: Graph, endpoints: bool) -> DataFrame:
    """id, c: Brandes' sums of every vertex."""
    def sums(arcs, batch):
        levels = forward(arcs, batch)
        deltas, _ = backward(arcs, levels)
        own = F.col("delta") + (1.0 if endpoints else 0.0)
        out = deltas.where("s != id").groupBy("id").agg(F.sum(own).alias("c")).union(batch.select("id", F.lit(0.0).alias("c")))
        if endpoints:
            out = out.union(deltas.where("s != id").groupBy(F.col("s").alias("id")).agg(F.count("*").cast("double").alias("c")))
        return out.groupBy("id").agg(F.sum("c").alias("c"))

    return over_sources(graph, sums).groupBy("id").agg(F.sum("c").alias("c"))


def arc_dependencies(graph: Graph) -> DataFrame:
    """src, dst, c: Brandes' sums of one edge between two vertices, in the direction in which it is walked."""
    return over_sources(graph, lambda arcs, batch: backward(arcs, forward(arcs, batch))[1].groupBy("src", "dst").agg(F.sum("c").alias("c"))).groupBy("src", "dst").agg(F.sum("c").alias("c"))


def lost_share(graph: Graph, group: DataFrame) -> float:
    """Over pairs outside the group, the sum of the shares of their shortest paths that pass it."""
    def sums(arcs, batch):
        out = None
        for level in forward(arcs, batch, group)[1:]:
            one = level.join(group, "id", "left_anti").agg(F.sum(1 - F.col("clean") / F.col("sigma")).alias("c"))
            out = one if out is None else out.union(one)
        return batch.limit(0).agg(F.sum(F.lit(0.0)).alias("c")) if out is None else out

    total = over_sources(graph, sums, graph.V.select("id").join(group, "id", "left_anti")).agg(F.sum("c")).head()[0]
    return total or 0.0
