"""Spanning trees by Boruvka rounds, Steiner trees by Voronoi regions, metric closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, Weight, number
from weftgraph.operators import kernels as K
from weftgraph.operators.local import can_broadcast, fan_out, within
from weftgraph.operators.paths import _checked, all_pairs_by_joins
from weftgraph.plans import fixpoint as fix
from weftgraph.plans.fixpoint import checkpoint, fixpoint, meet


def minimum_spanning_edges(graph: Graph, weight: Weight = None, default: float = 1.0) -> DataFrame:
    """eid, src, dst, w of a minimum spanning forest.

    A round takes the least (weight, edge id) out of each part, merges parts along these edges by pointer
    doubling and keeps of the edges between two merged parts the least one. Parts at least halve, so there
    are O(log n) rounds on tables that shrink; edge ids break ties, so no cycle can close.
    """
    edges = checkpoint(graph.with_(directed=True).weighted(weight, default).where("src != dst").select("eid", "src", "dst", "w"))
    if not edges.where("isnan(w) OR w IS NULL").isEmpty():
        raise ValueError("a weight is not a number")
    live, taken = _least_between(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "eid").alias("m"))), None
    while not live.isEmpty():
        sides = live.select("a", "b", "m").union(live.select("b", "a", "m"))
        best = sides.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("m", "b")).alias("t"))
        best = checkpoint(best.select("id", F.col("t.b").alias("up"), F.col("t.m.eid").alias("eid")))
        taken = best.select("eid") if taken is None else taken.union(best.select("eid"))
        root, _, _ = fixpoint(_rooted(best), _double, lambda _, new: not new.where("up != old").isEmpty())
        a, b = (root.select(F.col("id").alias(k), F.col("up").alias(k + k)) for k in "ab")
        live = _least_between(meet(meet(live, a, "a"), b, "b").select(F.col("aa").alias("a"), F.col("bb").alias("b"), "m").where("a != b"))
    return edges if taken is None else edges.join(taken.distinct(), "eid", "left_semi")


def _least_between(pairs: DataFrame) -> DataFrame:
    """Of (a, b, m) the least m of each unordered pair."""
    ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "m")
    return checkpoint(ends.groupBy("a", "b").agg(F.min("m").alias("m")))


def _rooted(best: DataFrame) -> DataFrame:
    """id, up: of two that point at each other the lesser becomes a root, which points at itself."""
    s = best.select("id", "up")
    both = meet(s, s.select(F.col("id").alias("up"), F.col("up").alias("next")), "up")
    return both.select("id", F.when((F.col("next") == F.col("id")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up")).alias("up"), F.col("up").alias("old"))


def _double(s: DataFrame, _: int) -> DataFrame:
    far = s.select(F.col("id").alias("up"), F.col("up").alias("next"))
    return meet(s.select("id", "up"), far, "up").select("id", F.col("next").alias("up"), F.col("up").alias("old"))


def minimum_spanning_tree(graph: Graph, weight: Weight = None, default: float = 1.0) -> Graph:
    """The same as a graph; ids are kept."""
    keep = minimum_spanning_edges(graph, weight, default).select("eid")
    return graph.with_(E=graph.E.join(keep, "eid", "left_semi"))


#: Vertices and edges of a graph that is searched from every vertex, leaves or not.
SEARCHED = 500


def metric_closure(graph: Graph, weight: Weight = None, default: float = 1.0) -> DataFrame:
    """src, dst, dist, path of every pair src < dst; a graph that is not connected raises.

    The result is quadratic: one search per source gives its distances and paths, so that no pairs are joined. Of a large
    graph whose vertices are leaves by a quarter or more, only the rest is searched; leaves follow from what they hang on.
    """
    from weftgraph.operators.components import labels

    arcs = _checked(graph, weight, default)
    if not graph.directed and not within(SEARCHED, graph.V, graph.E):
        leaves, n = _leaves(arcs), graph.num_nodes()
        if 4 * leaves.count() >= n:
            gone = leaves.select("id")
            E = graph.E.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
            core = graph.with_(graph.V.join(gone, "id", "left_anti"), E.select("eid", "src", "dst", "payload")).cached()
            return _hung(metric_closure(core, weight, default), core.V, leaves, n)
    if labels(graph).select("component").distinct().limit(2).count() > 1:
        raise ValueError("the graph is not connected")
    if can_broadcast(graph):
        out = fan_out(graph, _from_source, "src bigint, dst bigint, dist double, path array<bigint>", weight, default)
        if not graph.directed:
            return out
        out = checkpoint(out)
    else:
        dist = all_pairs_by_joins(graph, weight, default).where("src < dst")
        out = checkpoint(dist.hint("merge").join(all_pairs_by_joins(graph, weight, default, paths=True).where("src < dst"), ["src", "dst"]))
    n = graph.num_nodes()
    if out.count() != n * (n - 1) // 2:
        raise ValueError("the graph is not connected")
    return out


def _leaves(arcs: DataFrame) -> DataFrame:
    """id, top, w of the vertices with one neighbour, and the least weight there; of two that have only each other, one."""
    one = arcs.where("src != dst").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("top"), F.max("dst").alias("most"), F.min("w").alias("w")).where("top = most").select("id", "top", "w")
    one = checkpoint(one)
    pairs = one.join(one.select(F.col("id").alias("top"), F.col("top").alias("id")), ["id", "top"], "left_semi").where("id < top")
    return checkpoint(one.join(pairs.select("id"), "id", "left_anti"))


#: Vertices in a strip (a task keeps the pairs of two strips at a time), strips on a side of what goes to one task, and pairs per task.
STRIP, SIDE, TASK_PAIRS = 64, 16, 16_000_000


def _hung(closure: DataFrame, V: DataFrame, leaves: DataFrame, n: int) -> DataFrame:
    """The closure of all ``n`` vertices from that of ``V``, on which ``leaves`` (id, top, w) hang.

    Vertices are put into strips by what they hang on; pairs of strips are dealt to tasks, and a task writes the pairs of their
    vertices out, so that nothing but strips is ever joined. A sum of weights may end on another digit than along the path.
    """
    every = leaves.union(V.select("id", F.col("id").alias("top"), F.lit(0.0).alias("w")))
    every = number(every.withColumn("i", F.lit(0)), "i", ["top", "id"])
    strips = every.groupBy("top", F.expr(f"i div {STRIP}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("ids"))
    strips = checkpoint(number(strips.withColumn("s", F.lit(0)), "s", ["top", "k"]).select("s", "top", "ids"))
    own = V.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"), F.array("id").alias("path"))
    near = closure.select("src", "dst", "dist", "path").union(own).withColumnsRenamed({"src": "a", "dst": "b"}).hint("merge")
    x, y = (strips.select(F.col("s").alias(k), F.col("top").alias(t), F.col("ids").alias(k + k)) for k, t in ("xa", "yb"))
    near = near.join(x.select("x", "a"), "a").join(y.select("y", "b"), "b").where("a != b OR x <= y")
    tasks = max(V.sparkSession.sparkContext.defaultParallelism, n * n // 2 // TASK_PAIRS)
    x, y = (F.broadcast(s) if n <= fix.IDS else s for s in (x.drop("a"), y.drop("b")))
    both = near.repartition(tasks, F.expr(f"x div {SIDE}"), F.expr(f"y div {SIDE}")).join(x, "x").join(y, "y")
    u = both.select("a", "b", "dist", "path", "x", "y", "yy", F.inline("xx").alias("u", "uw"))
    v = u.select("a", "b", "dist", "path", "x", "y", "u", "uw", F.inline("yy").alias("v", "vw")).where("x != y OR u < v")
    lone = lambda c, top: F.when(F.col(c) == F.col(top), F.array().cast("array<bigint>")).otherwise(F.array(c))
    path = F.concat(lone("u", "a"), "path", lone("v", "b"))
    path = F.when(F.col("u") < F.col("v"), path).otherwise(F.reverse(path))
    return v.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), (F.col("uw") + F.col("dist") + F.col("vw")).alias("dist"), path.alias("path"))


def _from_source(g, s):
    dist, via = K.dijkstra(g, s)
    return [(s, v, float(d), K.path_to(via, v)) for v, d in dist.items() if v > s]


def steiner_tree(graph: Graph, terminals, weight: Weight = None, default: float = 1.0) -> Graph:
    """An approximation within 2(1 - 1/t): vertices join the nearest terminal, bridges between the regions
    make a graph of terminals, its minimum spanning tree is written out as paths, leaves that are no terminals go."""
    t = checkpoint(graph.node_frame(terminals))
    if not t.join(graph.V, "id", "left_anti").isEmpty():
        raise ValueError("a terminal does not exist")
    arcs = checkpoint(graph.weighted(weight, default).groupBy("src", "dst").agg(F.min(F.struct("w", "eid")).alias("m")).select("src", "dst", "m.w", "m.eid"))
    state = checkpoint(t.select("id", F.col("id").alias("near"), F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("via"), F.lit(None).cast("bigint").alias("by")))
    front = state
    while True:
        step = arcs.join(front.select(F.col("id").alias("src"), "near", "dist"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("d"), "near", "src", "eid")).alias("m"))
        new = step.join(state.select("id", "dist"), "id", "left").where("dist IS NULL OR m.d < dist - 1e-12 * greatest(1D, dist)")
        new = checkpoint(new.select("id", F.col("m.near").alias("near"), F.col("m.d").alias("dist"), F.col("m.src").alias("via"), F.col("m.eid").alias("by")))
        if new.isEmpty():
            break
        state = checkpoint(state.join(new.select("id"), "id", "left_anti").unionByName(new))
        front = new
    a = state.select(F.col("id").alias("src"), F.col("near").alias("s"), F.col("dist").alias("ds"))
    b = state.select(F.col("id").alias("dst"), F.col("near").alias("t"), F.col("dist").alias("dt"))
    cross = arcs.join(a, "src").join(b, "dst").where("s < t").select("s", "t", (F.col("ds") + F.col("w") + F.col("dt")).alias("d"), "eid", "src", "dst")
    cross = checkpoint(cross.groupBy("s", "t").agg(F.min(F.struct("d", "eid", "src", "dst")).alias("m")).select("s", "t", "m.*"))
    tg = Graph.from_edges(cross.select(F.col("eid"), F.col("s").alias("src"), F.col("t").alias("dst"), F.col("d").alias("payload")), t)
    tree = minimum_spanning_edges(tg, "payload").select("eid")
    if tree.count() != t.count() - 1:
        raise ValueError("the terminals are not connected")
    used = checkpoint(cross.join(tree, "eid", "left_semi"))
    keep = used.select("eid")
    walk = checkpoint(used.select(F.col("src").alias("id")).union(used.select("dst")).distinct())
    while not walk.isEmpty():  # from the bridges back to the terminals
        up = walk.join(state.where("via IS NOT NULL"), "id").select("via", "by")
        up = checkpoint(up)
        keep = keep.union(up.select("by"))
        walk = checkpoint(up.select(F.col("via").alias("id")).distinct())
    E = checkpoint(graph.E.join(keep.distinct(), "eid", "left_semi").select("eid", "src", "dst", "payload"))
    g = graph.with_(E=E)
    best = minimum_spanning_edges(g, weight, default).select("eid")
    E = checkpoint(E.join(best, "eid", "left_semi").select("eid", "src", "dst", "payload"))
    while True:
        ends = E.select(F.col("src").alias("id")).union(E.select("dst")).groupBy("id").count().where("count = 1").join(t, "id", "left_anti").select("id")
        ends = checkpoint(ends)
        if ends.isEmpty():
            break
        E = checkpoint(E.join(ends.select(F.col("id").alias("src")), "src", "left_anti").join(ends.select(F.col("id").alias("dst")), "dst", "left_anti").select("eid", "src", "dst", "payload"))
    nodes = E.select(F.col("src").alias("id")).union(E.select("dst")).union(t)
    return graph.with_(graph.V.join(nodes, "id", "left_semi"), E)
