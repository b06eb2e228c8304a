"""Directed acyclic graphs: levels by peeling, longest paths by relaxation along levels, runs by doubling, dominators as kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.errors import DAGHasCycle, InvalidNode, NullGraph
from weftgraph.graph import Graph, Weight, condition, number
from weftgraph.operators import kernels as K
from weftgraph.operators.cycles import chain_up
from weftgraph.operators.euler import lifted
from weftgraph.operators.local import as_whole, by_component
from weftgraph.operators.traversal import reach
from weftgraph.plans.fixpoint import checkpoint, meet


def _generations(graph: Graph) -> tuple[DataFrame, bool]:
    """generation, id by peeling the vertices whose last edge in has gone; and whether all were peeled."""
    arcs = checkpoint(graph.E.groupBy("src", "dst").agg(F.count("*").alias("m")))
    need = arcs.groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("n"))
    left = checkpoint(graph.V.select("id").join(need, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))
    out, g = None, 0
    while True:
        ready = checkpoint(left.where("n = 0").select("id"))
        if ready.isEmpty():
            break
        layer = ready.select(F.lit(g).cast("bigint").alias("generation"), "id")
        out = layer if out is None else out.union(layer)
        cut = arcs.join(ready.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("c"))
        left = checkpoint(left.where("n > 0").join(cut, "id", "left").select("id", (F.col("n") - F.coalesce("c", F.lit(0))).alias("n")))
        g += 1
    if out is None:
        out = graph.V.limit(0).select(F.lit(0).cast("bigint").alias("generation"), "id")
    return out, left.isEmpty()


def is_directed_acyclic_graph(graph: Graph) -> bool:
    return _generations(graph)[1]


def topological_generations(graph: Graph) -> DataFrame:
    out, whole = _generations(graph)
    if not whole:
        raise DAGHasCycle("the graph has a cycle")
    return out


def topological_sort(graph: Graph) -> DataFrame:
    """pos, id: generations in order, ids inside them."""
    return number(topological_generations(graph).withColumn("pos", F.lit(0)), "pos", ["generation", "id"]).select("pos", "id")


def lexicographical_topological_sort(graph: Graph, key, reverse: bool = False, initial: list[int] | None = None) -> DataFrame:
    """pos, id by Kahn's algorithm with a heap of (key, id); ``key``: Column, SQL or callable of the payload."""
    if initial is not None:
        bad = graph.node_frame(initial).join(graph.V, "id", "left_anti")
        if not bad.isEmpty():
            raise ValueError("an initial node does not exist")
    return as_whole(graph, lambda g: K.lexicographic(g, {v: x or "" for v, x in g.node.items()}, reverse, initial), "pos bigint, id bigint", node=condition(key, F.col("payload"), "string"))


def _longest(graph: Graph, weight: Weight, integer: bool, default: float = 1.0) -> DataFrame:
    """id, generation, dist, via: the greatest sum of weights of a path that ends in each vertex, 0 at least.

    Generation by generation; a generation meets only those that its arcs come from.
    """
    gens = checkpoint(topological_generations(graph))
    kind = "bigint" if integer else "double"
    arcs = graph.weighted(weight, default).select("eid", "src", "dst", F.col("w").cast(kind).alias("w"))
    arcs = meet(meet(arcs, gens.select(F.col("id").alias("src"), F.col("generation").alias("g")), "src"), gens.select(F.col("id").alias("dst"), F.col("generation").alias("h")), "dst")
    arcs = checkpoint(arcs)
    if not integer and not arcs.where("isnan(w)").isEmpty():
        raise ValueError("a weight is not a number")
    feeds: dict[int, list[int]] = {}
    for r in arcs.select("g", "h").distinct().collect():  # at most a row per pair of generations, each of which is a job anyway
        feeds.setdefault(r.h, []).append(r.g)
    last, layers = gens.agg(F.max("generation")).head()[0], []
    for g in range(0 if last is None else last + 1):
        layer = gens.where(F.col("generation") == g).select("id", "generation")
        if not g:
            new = layer.select("id", "generation", F.lit(0).cast(kind).alias("dist"), F.lit(None).cast("bigint").alias("via"))
        else:
            before = None
            for f in feeds[g]:
                before = layers[f] if before is None else before.union(layers[f])
            into = meet(arcs.where(F.col("h") == g), before.select(F.col("id").alias("src"), "dist"), "src")
            best = into.groupBy(F.col("dst").alias("id")).agg(F.max(F.struct((F.col("dist") + F.col("w")).alias("d"), F.col("eid"), F.col("src"))).alias("m"))
            new = layer.join(best, "id", "left").select("id", "generation", F.greatest(F.coalesce("m.d", F.lit(0)), F.lit(0)).cast(kind).alias("dist"), F.when(F.col("m.d") >= 0, F.col("m.src")).alias("via"))
        layers.append(checkpoint(new))
    if not layers:
        return graph.V.limit(0).select("id", F.lit(0).cast("bigint").alias("generation"), F.lit(0).cast(kind).alias("dist"), F.lit(None).cast("bigint").alias("via"))
    out = layers[0]
    for more in layers[1:]:
        out = out.union(more)
    return out


def _longest_path(state: DataFrame) -> list[int]:
    """The path to the farthest vertex: ancestors along ``via``, found by doubling."""
    state = checkpoint(state)
    head = state.orderBy(F.desc("dist"), "id").limit(1)
    tables = lifted(state.select("id", F.col("via").alias("parent")))
    return [r.id for r in chain_up(tables, head).orderBy(F.desc("pos")).collect()]


def dag_longest_path(graph: Graph, weight: Weight = None) -> list[int]:
    return _longest_path(_longest(graph, weight, True))


def dag_longest_path_length(graph: Graph, weight: Weight = None) -> int:
    return _longest(graph, weight, True).agg(F.max("dist")).head()[0] or 0


def dag_weighted_longest_path(graph: Graph, weight: Weight) -> list[int]:
    return _longest_path(_longest(graph, weight, False))


def dag_weighted_longest_path_length(graph: Graph, weight: Weight) -> float:
    return _longest(graph, weight, False).agg(F.max("dist")).head()[0] or 0.0


def layers(graph: Graph, first: list[int]) -> DataFrame:
    """layer, id: a vertex follows when all its edges in come from layers before."""
    start = graph.node_frame(first)
    if not start.join(graph.V, "id", "left_anti").isEmpty():
        raise InvalidNode("a node of the first layer does not exist")
    arcs = checkpoint(graph.E.groupBy("src", "dst").agg(F.count("*").alias("m")))
    need = checkpoint(arcs.groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("n")))
    front = checkpoint(start)
    seen, out, n = front, front.select(F.lit(0).cast("bigint").alias("layer"), "id"), 0
    have = arcs.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("c"))
    have = checkpoint(have)
    while True:
        n += 1
        front = checkpoint(have.join(need, "id").where("c = n").select("id").join(seen, "id", "left_anti"))
        if front.isEmpty():
            return out
        if n > graph.num_nodes():
            raise DAGHasCycle("the graph has a cycle")
        out = out.union(front.select(F.lit(n).cast("bigint").alias("layer"), "id"))
        seen = checkpoint(seen.union(front))
        more = arcs.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("c"))
        have = checkpoint(have.union(more).groupBy("id").agg(F.sum("c").alias("c")))


def run_members(graph: Graph, pred) -> DataFrame:
    """head, generation, id: the maximal chains of nodes that pass and have one successor, a row per member.

    Nodes that pass hang from their only successor, if that passes too. Where several hang from one, the chain whose
    head comes first by (generation, id) goes on and the others end. That head is the least leaf under a vertex, found
    by doubling in O(log length) rounds; no task holds a chain or a component.
    """
    gens = topological_generations(graph)
    passing = graph.V.where(F.coalesce(condition(pred, F.col("payload")).cast("boolean"), F.lit(False))).select("id")
    nodes = checkpoint(gens.join(passing, "id", "left_semi").select("id", "generation"))
    single = graph.E.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("up"), F.max("dst").alias("far")).where("up = far")
    hung = single.join(nodes.select("id"), "id", "left_semi").select("id", "up")
    hung = checkpoint(hung.join(nodes.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"))
    leaf = F.when(F.col("up").isNull(), F.struct("generation", "id"))
    least = nodes.join(hung.select(F.col("up").alias("id"), "up").distinct(), "id", "left").select("id", leaf.alias("head"))
    least, jump = checkpoint(least), hung
    while not jump.isEmpty():
        below = jump.join(least, "id").groupBy(F.col("up").alias("id")).agg(F.min("head").alias("low"))
        least = checkpoint(least.join(below, "id", "left").select("id", F.least("head", "low").alias("head")))
        jump = checkpoint(meet(jump, jump.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")))
    return least.join(nodes, "id").select(F.col("head.id").alias("head"), "generation", "id")


def collect_runs(graph: Graph, pred) -> DataFrame:
    """run: ids of maximal chains of nodes that pass and have one successor; :func:`run_members` as arrays."""
    rows = run_members(graph, pred).groupBy("head").agg(F.array_sort(F.collect_list(F.struct("generation", "id"))).alias("run"))
    return rows.select(F.col("run.id").alias("run"))


def collect_bicolor_runs(graph: Graph, pred, colour) -> DataFrame:
    """run: blocks of nodes that share two edge colours."""
    if not is_directed_acyclic_graph(graph):
        raise DAGHasCycle("the graph has a cycle")

    def kernel(g):
        return K.bicolor_runs(g, {v: None if x is None else x == "true" for v, x in g.node.items()}, {e: None if x is None else int(x) for e, x in g.edge.items()})

    return by_component(graph, kernel, "run array<bigint>", node=condition(pred, F.col("payload")).cast("boolean"), edge=condition(colour, F.col("payload"), "bigint").cast("bigint"))


def transitive_reduction(graph: Graph) -> tuple[Graph, DataFrame]:
    """The fewest edges with the same reachability, and (old_id, new_id)."""
    if not is_directed_acyclic_graph(graph):
        raise ValueError("the graph has a cycle")
    once = checkpoint(graph.E.groupBy("src", "dst").agg(F.min("eid").alias("eid"), F.max_by("payload", "eid").alias("payload")))
    gens = checkpoint(_generations(graph)[0])
    # an edge can only go if its head lies more than one generation on, and a successor of its tail leads there:
    # the walk goes from such tails and stops at the generation of their farthest head
    arcs = once.join(gens.select(F.col("id").alias("src"), F.col("generation").alias("g")), "src").join(gens.select(F.col("id").alias("dst"), F.col("generation").alias("h")), "dst")
    arcs = checkpoint(arcs.select("src", "dst", "g", "h"))
    far = checkpoint(arcs.where("h > g + 1").groupBy(F.col("src").alias("s")).agg(F.max("h").alias("last")))
    # (s, at): at is reached from s by two edges or more
    step = far.join(arcs.withColumnRenamed("src", "s"), "s").where("h < last").select("s", "last", F.col("dst").alias("at"))
    seen = front = checkpoint(step.distinct())
    reached = None
    while not front.isEmpty():
        new = front.join(arcs.select(F.col("src").alias("at"), F.col("dst").alias("to"), "h"), "at").where("h <= last").select("s", "last", F.col("to").alias("at"), "h")
        new = checkpoint(new.distinct())
        hit = new.select(F.col("s").alias("src"), F.col("at").alias("dst"))
        reached = hit if reached is None else reached.union(hit)
        front = checkpoint(new.where("h < last").select("s", "last", "at").join(seen, ["s", "at"], "left_anti"))
        seen = checkpoint(seen.unionByName(front))
    E = once if reached is None else once.join(reached.distinct(), ["src", "dst"], "left_anti")
    E = E.select("eid", "src", "dst", "payload")
    g, names = graph.with_(E=E, multigraph=False).subgraph_with_nodemap(graph.V)
    return g, names.select("old_id", "new_id")


def transitive_closure(graph: Graph) -> DataFrame:
    """src, dst of every pair joined by a path of one edge or more; path lengths double each round."""
    pairs = checkpoint(graph.arcs().select("src", "dst").distinct())
    n = pairs.count()
    while True:
        pairs = checkpoint(pairs.union(pairs.select("src", F.col("dst").alias("m")).join(pairs.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst")).distinct())
        k = pairs.count()
        if k == n:
            return pairs
        n = k


def _start(graph: Graph, start: int) -> None:
    if graph.V.isEmpty():
        raise NullGraph("the graph has no nodes")
    if not graph.has_node(start):
        raise InvalidNode(f"no node {start}")


def _reached(graph: Graph, start: int) -> Graph:
    ids = checkpoint(reach(graph, graph.node_frame([start])))
    E = graph.E.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select("eid", "src", "dst", "payload")
    return graph.with_(graph.V.join(ids, "id", "left_semi"), E)


def immediate_dominators(graph: Graph, start: int) -> DataFrame:
    """id, idom for what the start reaches; the start dominates itself."""
    _start(graph, start)
    return as_whole(_reached(graph, start), lambda g: list(K.dominators(g, start).items()), "id bigint, idom bigint")


def dominance_frontiers(graph: Graph, start: int) -> DataFrame:
    """id, frontier (array, maybe empty)."""
    _start(graph, start)
    return as_whole(_reached(graph, start), lambda g: [(v, sorted(f)) for v, f in K.frontiers(g, start).items()], "id bigint, frontier array<bigint>")


def ranked(gens: DataFrame) -> DataFrame:
    """Position of each vertex inside its generation."""
    return gens.withColumn("rank", F.row_number().over(W.partitionBy("generation").orderBy("id")))
