"""Frontier expansion as joins; event-by-event searches as kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.graph import Graph, Weight, number
from weftgraph.operators import kernels as K
from weftgraph.operators.local import PART_ROWS, as_whole, within
from weftgraph.plans.fixpoint import checkpoint, meet, written


def bfs_distances(graph: Graph, sources: DataFrame, undirected: bool | None = None) -> DataFrame:
    """id, dist (hops from the nearest source). A round joins only the newest layer."""
    arcs = checkpoint(graph.arcs(undirected).select("src", "dst").distinct())
    front = checkpoint(graph.V.join(sources, "id", "left_semi").select("id"))
    seen, d = front.withColumn("dist", F.lit(0).cast("bigint")), 0
    while True:
        d += 1
        front = checkpoint(arcs.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = checkpoint(seen.union(front.withColumn("dist", F.lit(d).cast("bigint"))))


def reach(graph: Graph, start: DataFrame) -> DataFrame:
    """The ids that ``start`` reaches, itself included."""
    return bfs_distances(graph, start).select("id")


def bfs_layers(graph: Graph, sources=None) -> DataFrame:
    """layer, id; without sources all vertices are layer 0."""
    if sources is None:
        return graph.V.select(F.lit(0).cast("bigint").alias("layer"), "id")
    return bfs_distances(graph, graph.node_frame(sources)).select(F.col("dist").alias("layer"), "id")


def _others(graph: Graph, node: int) -> DataFrame:
    if not graph.has_node(node):
        raise IndexError(f"no node {node}")
    return reach(graph, graph.node_frame([node])).where(F.col("id") != node)


def descendants(graph: Graph, node: int) -> DataFrame:
    return _others(graph, node)


def ancestors(graph: Graph, node: int) -> DataFrame:
    return _others(graph.reverse() if graph.directed else graph, node)


def bfs_successors(graph: Graph, node: int) -> DataFrame:
    """id, payload, children: for each vertex reached, its successors' payloads (by id); vertices without any are left out."""
    found = bfs_distances(graph, graph.node_frame([node]))
    near = graph.arcs().select(F.col("src").alias("id"), F.col("dst").alias("c")).distinct()
    kids = near.join(graph.V.select(F.col("id").alias("c"), F.col("payload").alias("cp")), "c").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "cp"))).alias("k"))
    return found.join(kids, "id").join(graph.V, "id").select("id", "dist", "payload", F.col("k.cp").alias("children"))


def bfs_predecessors(graph: Graph, node: int) -> DataFrame:
    return bfs_successors(graph.reverse() if graph.directed else graph, node).withColumnRenamed("children", "parents")


def generate_random_path(graph: Graph, source: int, length: int, seed: int = 0) -> list[int]:
    """A random walk; parallel edges raise a neighbour's chance; it ends early where no edge leads on."""
    import random

    rng, path = random.Random(seed), [source]
    arcs = graph.arcs().select("src", "dst", "eid")
    for _ in range(length):
        near = [r[0] for r in arcs.where(F.col("src") == path[-1]).orderBy("eid", "dst").select("dst").collect()]
        if not near:
            break
        path.append(rng.choice(near))
    return path


EVENTS = "pos bigint, event string, id bigint, src bigint, dst bigint, w double"


def dfs_edges(graph: Graph, source: int | None = None) -> DataFrame:
    """Tree edges in preorder: pos, src, dst. Of a large graph a task gets what ``source`` reaches without the twigs, which a search
    can only enter from where they hang and never leaves by another way; their edges are put in between afterwards."""
    if within(PART_ROWS, graph.V, graph.E):
        return as_whole(graph, lambda g: K.dfs_edges(g, source), "pos bigint, src bigint, dst bigint")
    graph = _reached(graph, None if source is None else [source])
    arcs, rounds = _twigs(graph, source)
    known = graph.V.select("id")
    for twigs in rounds:
        known = known.join(twigs.select("id"), "id", "left_anti")
    core = Graph(checkpoint(known).withColumn("payload", F.lit(None).cast("string")), arcs.select("eid", "src", "dst", F.lit(None).cast("double").alias("payload")), True)
    core = checkpoint(as_whole(core, lambda g: K.dfs_forest(g, source), "id bigint, parent bigint, eid bigint, pre bigint, last bigint, depth bigint"))
    if not rounds:
        rows = core.select("pre", F.lit(0).alias("up"), F.array().cast("array<bigint>").alias("path"), "parent", "id")
    else:
        rows = _with_twigs(core, rounds)
    rows = rows.where("parent != id").select("pre", "up", "path", F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("pos"))
    return number(rows, "pos", ["pre", "up", "path"]).select("pos", "src", "dst")


def _twigs(graph: Graph, source: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """The arcs (src, dst, eid; one per pair) without twigs, and the twigs (id, parent, eid) by rounds until one takes fewer than one in twenty:
    vertices with arcs from one vertex only and to no other. Where every vertex is a source in turn, the one they hang on is the lesser."""
    arcs = written(graph.arcs().where("src != dst").groupBy("src", "dst").agg(F.min("eid").alias("eid")))
    apart, left, rounds = "id > parent" if source is None else f"id != {int(source)}", graph.V.count(), []
    while True:
        into = arcs.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"), F.max("src").alias("most"), F.min("eid").alias("eid")).where(f"parent = most AND {apart}")
        out = arcs.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
        twigs = checkpoint(into.join(out, "id", "left").where("a IS NULL OR a = parent AND b = parent").select("id", "parent", "eid"))
        n = twigs.count()
        if not n:
            return arcs, rounds
        rounds.append(twigs)
        gone = twigs.select("id")
        arcs = written(arcs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "eid"))
        if n < left // 20 + 1:
            return arcs, rounds
        left -= n


def _with_twigs(core: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """pre, up, path, parent, id of the core's vertices and the twigs; in the order of the first three a search meets them.

    A twig comes after the last vertex of the core (``pre``) that is met before it, those that hang deeper first (``up``), and among
    what hangs on one vertex by the arcs that lead to it (``path``).
    """
    known = core.select("id", F.col("id").alias("top"), F.array().cast("array<bigint>").alias("path"))
    every = None
    for twigs in reversed(rounds):
        new = meet(twigs, known.withColumnRenamed("id", "parent"), "parent").select("id", "parent", "top", F.array_append("path", F.col("eid")).alias("path"))
        new = checkpoint(new)
        known = known.union(new.select("id", "top", "path"))
        every = new if every is None else every.union(new)
    every = meet(every, core.select(F.col("id").alias("top"), "pre", "depth"), "top")
    kids = core.where("parent != id").select(F.col("parent").alias("top"), F.col("eid").alias("first"), "last")
    if not kids.isEmpty():
        cols = ("id", "parent", "top", "path", "pre", "depth", F.col("path")[0].alias("first"), F.lit(None).cast("bigint").alias("last"))
        both = every.select(*cols).unionByName(kids, allowMissingColumns=True)
        before = F.last("last", ignorenulls=True).over(W.partitionBy("top").orderBy("first"))
        every = both.withColumn("pre", F.coalesce(before, "pre")).where("id IS NOT NULL")
    own = core.select("pre", (-F.col("depth")).alias("up"), F.array().cast("array<bigint>").alias("path"), "parent", "id")
    return own.union(every.select("pre", (-F.col("depth")).alias("up"), "path", "parent", "id"))


def _reached(graph: Graph, sources) -> Graph:
    """What a search from ``sources`` can meet: of a large graph only that goes to its task. Arcs lead on from vertices that are reached, so no event changes."""
    if sources is None or within(PART_ROWS, graph.V, graph.E):
        return graph
    ids = checkpoint(reach(graph, graph.node_frame(sources)))
    E = graph.E.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("eid", "src", "dst", "payload")
    return graph.with_(graph.V.join(ids, "id", "left_semi"), E)


def bfs_search(graph: Graph, sources=None, visitor=None, weight: Weight = None) -> DataFrame:
    """The events of a breadth-first search; a visitor's hooks run in the task and may raise StopSearch or PruneSearch."""
    return as_whole(_reached(graph, sources), lambda g: K.bfs_events(g, sources, visitor), EVENTS, weight)


def dfs_search(graph: Graph, sources=None, visitor=None, weight: Weight = None) -> DataFrame:
    return as_whole(_reached(graph, sources), lambda g: K.dfs_events(g, sources, visitor), EVENTS, weight)


def dijkstra_search(graph: Graph, sources=None, weight: Weight = None, visitor=None) -> DataFrame:
    return as_whole(graph, lambda g: K.dijkstra_events(g, sources, visitor), EVENTS, weight)
