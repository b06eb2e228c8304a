"""Shortest and simple paths. Single-source operators relax a frontier by joins; all-pairs ones fan out over sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.errors import NegativeCycle, NoPathFound
from weftgraph.graph import Graph, Weight, condition
from weftgraph.operators import kernels as K
from weftgraph.operators import levels, local
from weftgraph.operators.local import as_whole, can_broadcast, fan_out, within
from weftgraph.operators.traversal import bfs_distances, reach
from weftgraph.plans.fixpoint import checkpoint, handy, written


def _checked(graph: Graph, weight: Weight, default: float, undirected: bool | None = None) -> DataFrame:
    """Weighted arcs; a negative (-0.0 too) or NaN weight raises."""
    arcs = checkpoint(graph.weighted(weight, default, undirected))
    if not arcs.where("w < 0 OR isnan(w) OR w IS NULL OR cast(w AS string) = '-0.0'").isEmpty():
        raise ValueError("weights must be numbers that are not negative")
    return arcs


def _relax(graph: Graph, arcs: DataFrame, source: int, rounds: int | None = None) -> DataFrame:
    """id, dist, via (the vertex before; null at the source): label correcting.

    A round joins only vertices whose distance fell; each keeps its least (dist, via). With
    ``rounds`` a negative cycle raises.
    """
    if not graph.has_node(source):
        raise IndexError(f"no node {source}")
    return _settle(arcs, graph.node_frame([source]), rounds)


def _circular(state: DataFrame, n: int) -> bool:
    """Do the parents (via) of any vertices form a cycle? Steps to the parent double until they exceed ``n``."""
    up = state.where("via IS NOT NULL").select("id", F.col("via").alias("to"))
    up, k = checkpoint(up), 1
    while k <= n and not up.isEmpty():
        up = checkpoint(up.join(up.select(F.col("id").alias("to"), F.col("to").alias("on")), "to").select("id", F.col("on").alias("to")))
        k *= 2
    return not up.isEmpty()


def _settle(arcs: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """The relaxation from all ``sources`` at distance 0. With ``rounds`` (the number of vertices) the
    parents are looked at after 8, 16, 32, ... rounds: they are circular only on a negative cycle."""
    arcs = checkpoint(arcs.groupBy("src", "dst").agg(F.min("w").alias("w")))
    state = checkpoint(sources.select("id", F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("via")))
    front, n = state, 0
    while True:
        n += 1
        step = arcs.join(front.select(F.col("id").alias("src"), "dist"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("d"), F.col("src").alias("v"))).alias("m"))
        new = checkpoint(step.join(state.select("id", "dist"), "id", "left").where("dist IS NULL OR m.d < dist - 1e-12 * greatest(1D, abs(dist))").select("id", F.col("m.d").alias("dist"), F.col("m.v").alias("via")))
        if new.isEmpty():
            return state
        state = checkpoint(state.join(new.select("id"), "id", "left_anti").unionByName(new))
        if rounds is not None and (n > rounds or n >= 8 and n & (n - 1) == 0 and _circular(state, rounds)):
            raise NegativeCycle("a negative cycle can be reached")
        front = new


def dijkstra_shortest_path_lengths(graph: Graph, node: int, weight: Weight = None, goal: int | None = None, default: float = 1.0) -> DataFrame:
    """id, dist; the source itself is left out."""
    out = _relax(graph, _checked(graph, weight, default), node).where(F.col("id") != node).select("id", "dist")
    return out if goal is None else out.where(F.col("id") == goal)


def _paths(state: DataFrame, source: int, targets: DataFrame | None = None) -> DataFrame:
    """dst, path from the parents, all targets at once: a round puts one vertex before each path."""
    up = checkpoint(state.select("id", "via"))
    ends = up.where(F.col("id") != source).select("id") if targets is None else targets.join(up, "id", "left_semi").where(F.col("id") != source)
    todo, done = checkpoint(ends.select(F.col("id").alias("dst"), F.col("id").alias("head"), F.array("id").alias("path"))), None
    while True:
        todo = todo.join(up.select(F.col("id").alias("head"), "via"), "head").select("dst", F.col("via").alias("head"), F.array_prepend("path", F.col("via")).alias("path"))
        todo = checkpoint(todo)
        full = todo.where(F.col("head") == source).select("dst", "path")
        done = full if done is None else done.union(full)
        todo = todo.where(F.col("head") != source)
        if todo.isEmpty():
            return done


def dijkstra_shortest_paths(graph: Graph, source: int, target: int | None = None, weight: Weight = None, default: float = 1.0, as_undirected: bool = False) -> DataFrame:
    """dst, path; of equal paths the one whose last steps have the least ids."""
    state = _relax(graph, _checked(graph, weight, default, as_undirected), source)
    return _paths(state, source, None if target is None else graph.node_frame([target]))


def bellman_ford_shortest_path_lengths(graph: Graph, node: int, weight: Weight = None, goal: int | None = None, default: float = 1.0) -> DataFrame:
    out = _relax(graph, graph.weighted(weight, default), node, graph.num_nodes()).where(F.col("id") != node).select("id", "dist")
    return out if goal is None else out.where(F.col("id") == goal)


def bellman_ford_shortest_paths(graph: Graph, source: int, target: int | None = None, weight: Weight = None, default: float = 1.0, as_undirected: bool = False) -> DataFrame:
    state = _relax(graph, graph.weighted(weight, default, as_undirected), source, graph.num_nodes())
    return _paths(state, source, None if target is None else graph.node_frame([target]))


def has_path(graph: Graph, source: int, target: int, as_undirected: bool = False) -> bool:
    """False for source = target, as the source never counts as reached."""
    if source == target:
        return False
    g = graph.with_(directed=False) if as_undirected else graph
    return not reach(g, graph.node_frame([source])).where(F.col("id") == target).isEmpty()


def single_source_all_shortest_paths(graph: Graph, source: int, weight: Weight = None, default: float = 1.0, as_undirected: bool = False, target: int | None = None) -> DataFrame:
    """dst, path for every path of least length (the source with its own)."""
    arcs = _checked(graph, weight, default, as_undirected)
    dist = checkpoint(_relax(graph, arcs, source).select("id", "dist"))
    tight = arcs.join(dist.select(F.col("id").alias("src"), F.col("dist").alias("a")), "src").join(dist.select(F.col("id").alias("dst"), F.col("dist").alias("b")), "dst").where("a + w = b").select("src", "dst").distinct()
    tight = checkpoint(tight)
    if target is not None:  # only what leads to the target
        back = reach(graph.with_(E=tight.select(F.lit(0).cast("bigint").alias("eid"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("payload")), directed=True), graph.node_frame([target]))
        tight = checkpoint(tight.join(back.select(F.col("id").alias("dst")), "dst", "left_semi"))
    front = checkpoint(graph.node_frame([source]).select(F.col("id").alias("dst"), F.array("id").alias("path")))
    out = front
    while True:
        front = checkpoint(front.join(tight.select(F.col("src").alias("dst"), F.col("dst").alias("n")), "dst").where(~F.array_contains("path", F.col("n"))).select(F.col("n").alias("dst"), F.array_append("path", F.col("n")).alias("path")))
        if front.isEmpty():
            return out
        out = out.union(front)


def all_shortest_paths(graph: Graph, source: int, target: int, weight: Weight = None, default: float = 1.0, as_undirected: bool = False) -> DataFrame:
    """Every shortest path; none for source = target."""
    if source == target:
        return graph.V.limit(0).select(F.array("id").alias("path"))
    return single_source_all_shortest_paths(graph, source, weight, default, as_undirected, target).where(F.col("dst") == target).select("path")


def num_shortest_paths_unweighted(graph: Graph, source: int) -> DataFrame:
    """id, cnt decimal(38,0); the source is left out; parallel edges count singly."""
    arcs = checkpoint(graph.arcs().groupBy("src", "dst").agg(F.count("*").alias("m")))
    dist = checkpoint(bfs_distances(graph, graph.node_frame([source])))
    front = graph.node_frame([source]).select("id", F.lit(1).cast("decimal(38,0)").alias("cnt"))
    out, d = None, 0
    while True:
        d += 1
        step = arcs.join(front.select(F.col("id").alias("src"), "cnt"), "src").join(dist.where(F.col("dist") == d).select(F.col("id").alias("dst")), "dst")
        front = checkpoint(step.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("cnt") * F.col("m")).cast("decimal(38,0)").alias("cnt")))
        if front.isEmpty():
            return graph.V.limit(0).select("id", F.lit(0).cast("decimal(38,0)").alias("cnt")) if out is None else out
        out = front if out is None else out.union(front)


def k_shortest_path_lengths(graph: Graph, start: int, k: int, weight: Weight = None, goal: int | None = None) -> DataFrame:
    """id, dist: the length of the k-th shortest walk from ``start`` to each vertex that k walks reach."""
    if within(local.PART_ROWS, graph.V, graph.E):
        out = as_whole(graph, lambda g: [(v, float(d)) for v, d in K.k_shortest(g, start, k).items()], "id bigint, dist double", weight)
    else:
        out = k_best(graph, start, k, weight).where(F.col("rank") == k).select("id", "dist")
    return out if goal is None else out.where(F.col("id") == goal)


def k_best(graph: Graph, start: int, k: int, weight: Weight = None) -> DataFrame:
    """id, rank (from 1), dist: the k shortest walks of each vertex.

    A round makes all lists anew from those of the vertices before, so no walk counts twice; each is cut to k before the
    shuffle. After t rounds the lists are those of walks of up to t arcs, and it ends when none changes.
    """
    arcs = written(_checked(graph, weight, 1.0))
    here = graph.node_frame([start]).select("id", F.lit(0.0).alias("dist"))
    best = W.partitionBy("id").orderBy("dist")
    lists = checkpoint(here.select("id", F.lit(1).alias("rank"), "dist"))
    while True:
        n = lists.count()
        more = arcs.join(handy(lists.select(F.col("id").alias("src"), F.col("dist").alias("d")), n), "src").select(F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("dist"))
        new = checkpoint(more.union(here).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "dist"))
        if new.join(lists.withColumnRenamed("dist", "o"), ["id", "rank"], "left").where("o IS NULL OR dist != o").isEmpty():
            return new
        lists = new


def astar_shortest_path(graph: Graph, node: int, goal, weight: Weight = None, estimate="0D") -> list[int]:
    """``goal`` and ``estimate``: Column, SQL over the vertex row, or a callable of the payload."""
    if not graph.has_node(node):
        raise IndexError(f"no node {node}")
    info = F.concat_ws(" ", condition(goal, F.col("payload")).cast("boolean").cast("string"), condition(estimate, F.col("payload"), "double").cast("double").cast("string"))

    def kernel(g):
        known = {v: x.split(" ") for v, x in g.node.items()}
        path = K.astar(g, node, lambda v: known[v][0] == "true", lambda v: float(known[v][-1]))
        return [(path,)] if path else []

    row = as_whole(graph, kernel, "path array<bigint>", weight, node=info).head()
    if row is None:
        raise NoPathFound("no path to a goal")
    return list(row[0])


# --- all pairs ---------------------------------------------------------------------------------


def all_pairs_dijkstra_path_lengths(graph: Graph, weight: Weight = None, default: float = 1.0) -> DataFrame:
    """src, dst, dist; pairs of a vertex with itself are left out. Beyond the broadcast bound: :func:`all_pairs_by_joins`."""
    _checked(graph, weight, default)
    if not can_broadcast(graph):
        return all_pairs_by_joins(graph, weight, default)
    return fan_out(graph, lambda g, s: [(s, v, float(d)) for v, d in K.dijkstra(g, s)[0].items() if v != s], "src bigint, dst bigint, dist double", weight, default)


def all_pairs_by_joins(graph: Graph, weight: Weight = None, default: float = 1.0, paths: bool = False) -> DataFrame:
    """src, dst, dist (or path): the relaxation of all sources at once, keyed (source, vertex); nothing is broadcast."""
    arcs = checkpoint(graph.weighted(weight, default).groupBy("src", "dst").agg(F.min("w").alias("w")))
    state = checkpoint(graph.V.select(F.col("id").alias("s"), "id", F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("via")))
    front = state
    while True:
        step = arcs.join(front.select("s", F.col("id").alias("src"), "dist"), "src").groupBy("s", F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("d"), F.col("src").alias("v"))).alias("m"))
        new = step.join(state.select("s", "id", "dist"), ["s", "id"], "left").where("dist IS NULL OR m.d < dist - 1e-12 * greatest(1D, abs(dist))")
        new = checkpoint(new.select("s", "id", F.col("m.d").alias("dist"), F.col("m.v").alias("via")))
        if new.isEmpty():
            break
        state = checkpoint(state.join(new.select("s", "id"), ["s", "id"], "left_anti").unionByName(new))
        front = new
    if not paths:
        return state.where("s != id").select(F.col("s").alias("src"), F.col("id").alias("dst"), "dist")
    up = checkpoint(state.where("via IS NOT NULL").select("s", F.col("id").alias("head"), "via"))
    todo, done = up.select("s", F.col("head").alias("dst"), "head", F.array("head").alias("path")), None
    while True:  # a vertex is put before each path per round
        todo = checkpoint(todo.join(up, ["s", "head"]).select("s", "dst", F.col("via").alias("head"), F.array_prepend("path", F.col("via")).alias("path")))
        full = todo.where("head = s").select(F.col("s").alias("src"), "dst", "path")
        done = full if done is None else done.union(full)
        todo = todo.where("head != s")
        if todo.isEmpty():
            return done


def _pair_paths(run):
    def kernel(g, s):
        _, via = run(g, s)
        return [(s, v, K.path_to(via, v)) for v in via if v != s]

    return kernel


def all_pairs_dijkstra_shortest_paths(graph: Graph, weight: Weight = None, default: float = 1.0) -> DataFrame:
    _checked(graph, weight, default)
    if not can_broadcast(graph):
        return all_pairs_by_joins(graph, weight, default, paths=True)
    return fan_out(graph, _pair_paths(K.dijkstra), "src bigint, dst bigint, path array<bigint>", weight, default)


def _no_negative_cycle(graph: Graph, weight: Weight, default: float = 1.0) -> None:
    if negative_edge_cycle(graph, weight, default):
        raise NegativeCycle("the graph has a negative cycle")


def all_pairs_bellman_ford_path_lengths(graph: Graph, weight: Weight = None, default: float = 1.0) -> DataFrame:
    _no_negative_cycle(graph, weight, default)
    if not can_broadcast(graph):
        return all_pairs_by_joins(graph, weight, default)
    return fan_out(graph, lambda g, s: [(s, v, float(d)) for v, d in K.bellman_ford(g, s)[0].items() if v != s], "src bigint, dst bigint, dist double", weight, default)


def all_pairs_bellman_ford_shortest_paths(graph: Graph, weight: Weight = None, default: float = 1.0) -> DataFrame:
    _no_negative_cycle(graph, weight, default)
    if not can_broadcast(graph):
        return all_pairs_by_joins(graph, weight, default, paths=True)
    return fan_out(graph, _pair_paths(K.bellman_ford), "src bigint, dst bigint, path array<bigint>", weight, default)


def negative_edge_cycle(graph: Graph, weight: Weight = None, default: float = 1.0) -> bool:
    """The relaxation from every vertex at once; without a negative weight there is nothing to look for."""
    arcs = checkpoint(graph.weighted(weight, default))
    if arcs.where("w < 0").isEmpty():
        return False
    try:
        _settle(arcs, graph.V.select("id"), graph.num_nodes())
    except NegativeCycle:
        return True
    return False


def find_negative_cycle(graph: Graph, weight: Weight = None) -> list[int]:
    row = as_whole(graph, lambda g: [(c,)] if (c := K.negative_cycle(g)) else [], "cycle array<bigint>", weight).head()
    if row is None:
        raise ValueError("no negative cycle")
    return list(row[0])


def distance_matrix(graph: Graph, as_undirected: bool = False, null_value: float = 0.0, dense: bool = False) -> DataFrame:
    """src, dst, dist in hops for pairs that are reached; ``dense`` adds the rest as ``null_value``."""
    g = graph.with_(directed=False) if as_undirected else graph
    if can_broadcast(g):
        out = fan_out(g, lambda x, s: [(s, v, float(d)) for v, d in K.bfs(x, s).items()], "src bigint, dst bigint, dist double")
    else:
        out = levels.hops(g).select(F.col("s").alias("src"), F.col("id").alias("dst"), "dist")
    if not dense:
        return out
    ids = graph.V.select("id")
    full = ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst")))
    return full.join(out, ["src", "dst"], "left").withColumn("dist", F.coalesce("dist", F.lit(null_value)))


def floyd_warshall(graph: Graph, weight: Weight = None, default: float = 1.0, as_undirected: bool = False) -> DataFrame:
    """src, dst, dist of reached pairs, the diagonal too; negative weights are allowed."""
    g = graph.with_(directed=False) if as_undirected else graph
    if not within(DENSE, g.V):
        return _tiled(g, weight, default).where("dist < double('inf')").select("src", "dst", "dist")

    def kernel(g):
        d, _ = K.floyd_warshall(g)
        return [(a, b, float(d[i, j])) for i, a in enumerate(g.ids) for j, b in enumerate(g.ids) if d[i, j] < math.inf]

    return as_whole(g, kernel, "src bigint, dst bigint, dist double", weight, default)


#: Vertices of a distance matrix that one task makes; larger ones are made of tiles.
DENSE = 400


def _tiled(graph: Graph, weight: Weight, default: float) -> DataFrame:
    from weftgraph.operators.tiles import all_distances, pairs

    return pairs(*all_distances(graph, weight, default))


def floyd_warshall_successor_and_distance(graph: Graph, weight: Weight = None, default: float = 1.0, as_undirected: bool = False) -> DataFrame:
    """src, dst, dist (infinite if not reached), next (the vertex after src; dst itself if not reached); the diagonal is 0."""
    g = graph.with_(directed=False) if as_undirected else graph
    if not within(DENSE, g.V):
        return _tiled(g, weight, default).withColumn("dist", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("dist")))

    def kernel(g):
        d, nxt = K.floyd_warshall(g)
        return [(a, b, 0.0 if i == j else float(d[i, j]), g.ids[nxt[i, j]]) for i, a in enumerate(g.ids) for j, b in enumerate(g.ids)]

    return as_whole(g, kernel, "src bigint, dst bigint, dist double, next bigint", weight, default)


def floyd_warshall_numpy(graph: Graph, weight: Weight = None, default: float = 1.0, as_undirected: bool = False):
    """The dense matrix, ids in order; infinite where not reached, 0 on the diagonal."""
    import numpy as np

    rows = floyd_warshall_successor_and_distance(graph, weight, default, as_undirected).orderBy("src", "dst").toPandas()
    n = int(math.isqrt(len(rows)))
    return np.asarray(rows["dist"]).reshape(n, n)


def unweighted_average_shortest_path_length(graph: Graph, as_undirected: bool = False, disconnected: bool = False) -> float:
    n = graph.num_nodes()
    if n <= 1:
        return math.nan
    g = graph.with_(directed=False) if as_undirected else graph
    if can_broadcast(g):
        sums = fan_out(g, lambda x, s: [(float(sum(d.values())), len(d) - 1) for d in [K.bfs(x, s)]], "total double, r bigint")
    else:
        sums = levels.reach_sums(g)
    total, pairs = sums.agg(F.sum("total"), F.sum("r")).head()
    if disconnected:
        return total / pairs if pairs else math.nan
    return total / (n * (n - 1)) if pairs == n * (n - 1) else math.inf


# --- simple paths ------------------------------------------------------------------------------


def _expand(graph: Graph, start: DataFrame, cutoff: int | None, targets: DataFrame | None):
    """Simple paths (path) from ``start(id)``, a step per round; parallel edges give a path each."""
    arcs = checkpoint(graph.arcs().select("src", "dst"))
    front = checkpoint(start.select(F.array("id").alias("path")))
    found, n = None, 1
    limit = cutoff if cutoff is not None else graph.num_nodes() + 1
    while n < limit:
        n += 1
        step = front.join(arcs.withColumnRenamed("src", "s"), F.element_at("path", -1) == F.col("s"))
        first = F.element_at("path", 1)
        step = checkpoint(step.select("path", "dst").where(~F.array_contains("path", F.col("dst")) | ((F.col("dst") == first) & (F.size("path") == 1))).select(F.array_append("path", F.col("dst")).alias("path")))
        if step.isEmpty():
            break
        hit = step if targets is None else step.join(targets, F.element_at("path", -1) == F.col("id"), "left_semi")
        found = hit if found is None else found.union(hit)
        front = step.where(F.size(F.array_distinct("path")) == F.size("path"))
    return graph.V.limit(0).select(F.array("id").alias("path")) if found is None else found


def all_simple_paths(graph: Graph, origin: int, to, min_depth: int | None = None, cutoff: int | None = None) -> DataFrame:
    """path; depths count vertices; a self-loop is [s, s] when origin = to."""
    from weftgraph.errors import InvalidNode

    goals = [to] if isinstance(to, int) else list(to)
    for v in [origin, *goals]:
        if not graph.has_node(v):
            raise InvalidNode(f"no node {v}")
    out = _expand(graph, graph.node_frame([origin]), cutoff, graph.node_frame(goals))
    return out if min_depth is None else out.where(F.size("path") >= min_depth)


def all_pairs_all_simple_paths(graph: Graph, min_depth: int | None = None, cutoff: int | None = None) -> DataFrame:
    if min_depth is not None and min_depth < 2 or cutoff is not None and cutoff < 2:
        raise ValueError("depths count vertices and are 2 or more")
    out = _expand(graph, graph.V.select("id"), cutoff, None).select(F.element_at("path", 1).alias("src"), F.element_at("path", -1).alias("dst"), "path")
    out = out.where("src != dst")
    return out if min_depth is None else out.where(F.size("path") >= min_depth)


def longest_simple_path(graph: Graph) -> list[int] | None:
    first = graph.V.agg(F.min("id")).head()[0]
    if first is None:
        return None
    row = all_pairs_all_simple_paths(graph).orderBy(F.desc(F.size("path")), "path").head()
    return [first] if row is None else list(row.path)


# --- hyperbolic routing ------------------------------------------------------------------------


def _heights(a, b, a0=None):
    """cosh(distance) - 1 of points on the hyperboloid, for numbers or arrays of them (one per coordinate) alike:
    (|a - b|^2 + |a ^ b|^2) / (1 + a0 b0 + ab), which keeps its digits where points lie near each other and far out."""
    import numpy as np

    def dot(p, q):
        out = 0.0
        for x, y in zip(p, q, strict=True):
            out = out + x * y
        return out

    d = [x - y for x, y in zip(a, b, strict=True)]
    near, ab = dot(d, d), dot(a, b)
    for i in range(len(b)):
        for j in range(i):
            w = d[i] * b[j] - d[j] * b[i]
            near = near + w * w
    both = (np.sqrt(1 + dot(a, a)) if a0 is None else a0) * np.sqrt(1 + dot(b, b))
    out, opposite = near / (1 + both + ab), ab < -0.5 * both
    return np.where(opposite, both - ab - 1, out) if np.any(opposite) else out


def _apart(a, b):
    return float(_heights(a, b))


def _greedy(g, pos, s, t):
    path, seen = [s], {s}
    total = 0.0
    while path[-1] != t:
        near = g.neighbors(path[-1])
        if not near:
            return None
        x = min(near, key=lambda v: (_apart(pos[v], pos[t]), v))
        if x in seen:
            return None
        seen.add(x)
        total += 1
        path.append(x)
    return path


class _Steps:
    """The step of :func:`_greedy` from every vertex to a target at once."""

    #: Points whose distances are found at a time, so that they stay in the processor's cache.
    BLOCK = 8192

    def __init__(self, g, pos):
        self._set(g.ids, [e[1] for e in g.edges], [e[2] for e in g.edges], g.directed, pos)

    @classmethod
    def of(cls, ids, src, dst, directed, pos):
        out = cls.__new__(cls)
        out._set(ids, src, dst, directed, pos)
        return out

    def _set(self, ids, src, dst, directed, pos):
        import numpy as np

        self.ids = np.sort(np.array(ids, np.int64))
        points = np.array([pos[v] for v in self.ids.tolist()], float).reshape(len(self.ids), -1)
        self.points, self.zero = [x for x in np.ascontiguousarray(points.T) if x.any()], np.sqrt(1 + sum((x * x for x in points.T), np.zeros(len(self.ids))))
        a, b = (np.searchsorted(self.ids, np.array(x, np.int64)) for x in (src, dst))
        if not directed:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        arcs = np.unique(a * max(1, len(self.ids)) + b)  # by tail, then head
        a, self.heads = np.divmod(arcs, max(1, len(self.ids)))
        self.tails, self.starts, self.sizes = np.unique(a, return_index=True, return_counts=True)
        self.guess = self.heads[self.starts]  # of each tail, a neighbour that was nearer to the last target

    def _least(self, z, rows):
        """Of ``rows`` of the tails the neighbour of least ``z``, the first of equals."""
        import numpy as np

        sizes = self.sizes[rows]
        first = np.cumsum(sizes) - sizes
        heads = self.heads[np.repeat(self.starts[rows] - first, sizes) + np.arange(sizes.sum())]
        near = z[heads]
        hit = np.flatnonzero(near == np.repeat(np.minimum.reduceat(near, first), sizes))
        at = np.searchsorted(first, hit, "right")
        return heads[hit[np.flatnonzero(np.diff(at, prepend=0))]]

    def arriving(self, target):
        """How many other vertices' walks end at the target: all, where each vertex has a neighbour that is nearer to it."""
        import numpy as np

        t, n = int(np.searchsorted(self.ids, target)), len(self.ids)
        to, z = [float(x[t]) for x in self.points], np.empty(n)
        for i in range(0, n, self.BLOCK):
            z[i : i + self.BLOCK] = _heights([x[i : i + self.BLOCK] for x in self.points], to, self.zero[i : i + self.BLOCK])
        own = z if len(self.tails) == n else z[self.tails]
        stuck = np.flatnonzero(~(z[self.guess] < own))
        stuck = stuck[self.tails[stuck] != t]
        if len(stuck):
            self.guess[stuck] = self._least(z, stuck)
            stuck = stuck[~(z[self.guess[stuck]] < own[stuck])]
        if not len(stuck) and len(self.tails) + (t not in self.tails if len(self.tails) < n else 0) == n:
            return n - 1
        step = np.full(n + 1, n)  # the last stands for no way on
        if len(self.tails):
            step[self.tails] = self._least(z, np.arange(len(self.tails)))
        step[t] = t
        for _ in range(n.bit_length()):
            step = step[step]
        return int((step[:n] == t).sum()) - 1


def hyperbolic_greedy_routing(graph: Graph, pos: dict[int, list[float]], source: int, destination: int) -> list[int] | None:
    """A walk to the neighbour nearest to the destination on the hyperboloid; None if it returns to a vertex."""
    if len({len(p) for p in pos.values()}) > 1:
        raise ValueError("positions must have one dimension")
    row = as_whole(graph, lambda g: [(p,)] if (p := _greedy(g, pos, source, destination)) else [], "path array<bigint>").head()
    return None if row is None else list(row[0])


def hyperbolic_greedy_success_rate(graph: Graph, pos: dict[int, list[float]]) -> float:
    if not pos:
        return math.nan
    """Share of the ordered pairs between which the greedy walk arrives. All walks to one target take the same step from
    a vertex, so a target costs one step per vertex and not one walk."""
    n, spark = len(pos), graph.spark
    if not can_broadcast(graph):
        raise ValueError(f"more than {local.BROADCAST_EDGES} vertices or edges: the steps to a target are found in one task")
    ids, ends = graph.V.select("id").toPandas()["id"].to_numpy(), graph.E.select("src", "dst").toPandas()
    shared = spark.sparkContext.broadcast(_Steps.of(ids, ends["src"].to_numpy(), ends["dst"].to_numpy(), graph.directed, pos))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"ok": [sum(shared.value.arriving(int(t)) for t in pdf["id"])]})

    tasks = max(1, min(len(ids), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    got = graph.V.select("id").repartitionByRange(tasks, "id").mapInPandas(run, "ok bigint").agg(F.sum("ok")).head()[0]
    return got / (n * (n - 1)) if n > 1 else math.nan


def top_distances(dist: DataFrame, k: int) -> DataFrame:
    """The k nearest targets of each source (a top-k report)."""
    return dist.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))).where(F.col("r") <= k).drop("r")
