"""Centrality: degree aggregations, power iterations as joins, path-based measures fanned out over sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import FailedToConverge
from weftgraph.graph import Graph, Weight, weight_column
from weftgraph.operators import kernels as K
from weftgraph.operators import levels
from weftgraph.operators.local import can_broadcast, fan_out
from weftgraph.operators.traversal import bfs_distances
from weftgraph.plans.fixpoint import checkpoint, handy, written


def degree_centrality(graph: Graph) -> DataFrame:
    """id, score: degree/(n-1). Directed: in and out degrees add; the divisor is 2(n-1) only when the sum equals it."""
    n, d = graph.num_nodes(), graph.degrees()
    if n <= 1:
        return d.select("id", F.lit(1.0 if n == 1 and not graph.directed else 0.0).alias("score")) if n == 1 else d.select("id", F.lit(0.0).alias("score"))
    if graph.directed:
        return d.select("id", F.when(F.col("degree") == 2 * (n - 1), 1.0).otherwise(F.col("degree") / (n - 1)).alias("score"))
    near = graph.arcs().groupBy(F.col("src").alias("id")).count()
    return graph.V.select("id").join(near, "id", "left").select("id", (F.coalesce("count", F.lit(0)) / (n - 1)).alias("score"))


def in_degree_centrality(graph: Graph) -> DataFrame:
    n = graph.num_nodes()
    return graph.degrees().select("id", (F.col("in_degree") / max(1, n - 1)).alias("score"))


def out_degree_centrality(graph: Graph) -> DataFrame:
    n = graph.num_nodes()
    return graph.degrees().select("id", (F.col("out_degree") / max(1, n - 1)).alias("score"))


def betweenness_centrality(graph: Graph, normalized: bool = True, endpoints: bool = False) -> DataFrame:
    """Brandes' sums over sources; each worker adds up its own sources before the shuffle. Beyond the broadcast bound by joins."""
    def kernel(g, s):
        order, delta, *_ = K.brandes(g, s)
        return [(v, delta[v] + (1.0 if endpoints else 0.0) if v != s else float(len(order) - 1) if endpoints else 0.0) for v in order]

    n = graph.num_nodes()
    if can_broadcast(graph):
        sums = fan_out(graph, kernel, "id bigint, c double").groupBy("id").agg(F.sum("c").alias("c"))
    else:
        sums = levels.vertex_dependencies(graph, endpoints)
    if normalized:
        pairs = n * (n - 1) if endpoints else (n - 1) * (n - 2)
        scale = 1 / pairs if n > (1 if endpoints else 2) else 1.0
    else:
        scale = 1.0 if graph.directed else 0.5
    return sums.select("id", (F.col("c") * scale).alias("score"))


def edge_betweenness_centrality(graph: Graph, normalized: bool = True) -> DataFrame:
    def kernel(g, s):
        return list(K.brandes(g, s)[2].items())

    n = graph.num_nodes()
    scale = (1 / (n * (n - 1)) if n > 1 else 1.0) if normalized else (1.0 if graph.directed else 0.5)
    if can_broadcast(graph):
        sums = fan_out(graph, kernel, "eid bigint, c double").groupBy("eid").agg(F.sum("c").alias("c"))
    else:
        sums = graph.arcs().select("eid", "src", "dst").join(levels.arc_dependencies(graph), ["src", "dst"]).groupBy("eid").agg(F.sum("c").alias("c"))
    return graph.E.select("eid").join(sums, "eid", "left").select("eid", (F.coalesce("c", F.lit(0.0)) * scale).alias("score"))


def closeness_centrality(graph: Graph, wf_improved: bool = True) -> DataFrame:
    """Distances on reversed arcs: (r-1)/sum, times (r-1)/(n-1) when improved."""
    n = graph.num_nodes()
    g = graph.reverse() if graph.directed else graph

    def kernel(x, s):
        d = K.bfs(x, s)
        total, r = sum(d.values()), len(d) - 1
        c = r / total if total else 0.0
        return [(s, c * r / (n - 1) if wf_improved and n > 1 else c)]

    if not can_broadcast(g):
        return _closeness(levels.reach_sums(g), n, wf_improved)
    return fan_out(g, kernel, "id bigint, score double")


def _closeness(sums: DataFrame, n: int, wf_improved: bool) -> DataFrame:
    """id, score from (s, r, total)."""
    c = F.when(F.col("total") > 0, F.col("r") / F.col("total")).otherwise(0.0)
    return sums.select(F.col("s").alias("id"), (c * F.col("r") / (n - 1) if wf_improved and n > 1 else c).alias("score"))


def newman_weighted_closeness_centrality(graph: Graph, weight: Weight = None, wf_improved: bool = True, default: float = 1.0) -> DataFrame:
    n = graph.num_nodes()

    def kernel(x, s):
        d, _ = K.dijkstra(x, s, reverse=True, length=lambda w: 1 / w)
        total, r = sum(d.values()), len(d) - 1
        c = r / total if total else 0.0
        return [(s, c * r / (n - 1) if wf_improved and n > 1 else c)]

    if not can_broadcast(graph):
        from weftgraph.operators.paths import all_pairs_by_joins

        back = graph.weighted(weight, default).select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), (1 / F.col("w")).alias("payload"))
        pairs = all_pairs_by_joins(graph.with_(E=back, directed=True), "payload").groupBy(F.col("src").alias("s")).agg(F.count("*").alias("r"), F.sum("dist").alias("total"))
        sums = graph.V.select(F.col("id").alias("s")).join(pairs, "s", "left").select("s", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("total", F.lit(0.0)).alias("total"))
        return _closeness(sums, n, wf_improved)
    return fan_out(graph, kernel, "id bigint, score double", weight, default)


def _folded(graph: Graph, weight: Weight, default: float = 1.0) -> DataFrame:
    return written(graph.weighted(weight, default).groupBy("src", "dst").agg(F.sum("w").alias("w")))


def _push(arcs: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """id, s: the sum over arcs of w times the value at the tail; ``n``: rows of x."""
    return arcs.join(handy(x.select(F.col("id").alias("src"), "x"), n), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("s"))


def eigenvector_centrality(graph: Graph, weight: Weight = None, default: float = 1.0, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Shifted power iteration x += A'x with unit length; stops when the change is below n * tol."""
    arcs, n = _folded(graph, weight, default), graph.num_nodes()
    x = checkpoint(graph.V.select("id", F.lit(1.0).alias("x")))
    for _ in range(max_iter):
        y = checkpoint(x.join(_push(arcs, x, n), "id", "left").select("id", F.col("x").alias("o"), (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("y")))
        norm = math.sqrt(y.agg(F.sum(F.col("y") * F.col("y"))).head()[0] or 0.0)
        if norm == 0:
            break
        x = y.select("id", (F.col("y") / norm).alias("x"))
        if (y.agg(F.sum(F.abs(F.col("y") / norm - F.col("o")))).head()[0] or 0.0) < n * tol:
            return x.select("id", F.col("x").alias("score"))
    raise FailedToConverge(f"no convergence in {max_iter} rounds")


def katz_centrality(graph: Graph, alpha: float = 0.1, beta=None, weight: Weight = None, default: float = 1.0, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """x = alpha * A'x + beta, scaled to unit length at the end; ``beta``: a number or {id: number} for all vertices."""
    arcs, n = _folded(graph, weight, default), graph.num_nodes()
    if isinstance(beta, dict):
        b = graph.spark.createDataFrame([(int(k), float(v)) for k, v in beta.items()], "id bigint, b double")
        if graph.V.join(b, "id", "left_semi").count() != n:
            raise ValueError("beta must cover every node")
    else:
        b = graph.V.select("id", F.lit(1.0 if beta is None else float(beta)).alias("b"))
    b = checkpoint(graph.V.select("id").join(b, "id"))
    x = checkpoint(graph.V.select("id", F.lit(0.0).alias("x")))
    for _ in range(max_iter):
        y = x.join(_push(arcs, x, n), "id", "left").join(b, "id").select("id", F.col("x").alias("o"), (alpha * F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("x"))
        y = checkpoint(y)
        gone, size = y.agg(F.sum(F.abs(F.col("x") - F.col("o"))), F.sqrt(F.sum(F.col("x") * F.col("x")))).head()
        if (gone or 0.0) < n * tol:
            return y.select("id", (F.col("x") / (size or 1.0)).alias("score"))
        x = y.select("id", "x")
    raise FailedToConverge(f"no convergence in {max_iter} rounds")


def _vector(graph: Graph, given: dict | None, name: str) -> DataFrame:
    """A map over ids, scaled to sum 1; missing ids are 0; without a map all are equal."""
    n = graph.num_nodes()
    if given is None:
        return graph.V.select("id", F.lit(1.0 / max(1, n)).alias(name))
    total = sum(given.values())
    rows = graph.spark.createDataFrame([(int(k), float(v) / total) for k, v in given.items()], f"id bigint, {name} double")
    return graph.V.select("id").join(rows, "id", "left").select("id", F.coalesce(name, F.lit(0.0)).alias(name))


def pagerank(graph: Graph, alpha: float = 0.85, weight: Weight = None, nstart: dict | None = None, personalization: dict | None = None, tol: float = 1e-6, max_iter: int = 100, dangling: dict | None = None) -> DataFrame:
    """id, score. Parallel edges add. A round is one join, one aggregation and one sweep over the vertices, which gives
    the change and the mass that the next round loses at vertices without out-edges. Stops when the change is
    below n * tol and gives back the iterate before."""
    n = graph.num_nodes()
    if n == 0:
        return graph.V.select("id", F.lit(0.0).alias("score"))
    arcs = graph.weighted(weight).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = arcs.groupBy("src").agg(F.sum("w").alias("t"))
    arcs = written(arcs.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("w")))
    tails = arcs.select(F.col("src").alias("id"), F.lit(False).alias("sink")).distinct()
    spread = dangling if dangling is not None else personalization
    # where all vertices are equal the share of each is a number, else a column of the vertices
    fixed = None
    if personalization is not None or spread is not None:
        fixed = checkpoint(_vector(graph, personalization, "p").join(_vector(graph, spread, "d"), "id"))
    p, d = (F.col("p"), F.col("d")) if fixed is not None else (F.lit(1.0 / n), F.lit(1.0 / n))
    start = _vector(graph, nstart, "x").join(tails, "id", "left")
    x = checkpoint(start.select("id", "x", F.coalesce("sink", F.lit(True)).alias("sink")))
    lost = x.where("sink").agg(F.sum("x")).head()[0] or 0.0
    for _ in range(max_iter):
        y = x.join(_push(arcs, x, n), "id", "left")
        y = y if fixed is None else y.join(fixed, "id")
        y = checkpoint(y.select("id", "sink", F.col("x").alias("o"), (alpha * (F.coalesce("s", F.lit(0.0)) + lost * d) + (1 - alpha) * p).alias("x")))
        change, lost = y.agg(F.sum(F.abs(F.col("x") - F.col("o"))), F.coalesce(F.sum(F.when(F.col("sink"), F.col("x"))), F.lit(0.0))).head()
        if change < n * tol:
            return y.select("id", F.col("o").alias("score"))
        x = y.drop("o")
    raise FailedToConverge(f"no convergence in {max_iter} rounds")


def hits(graph: Graph, weight: Weight = None, nstart: dict | None = None, tol: float = 1e-6, max_iter: int = 100, normalized: bool = True) -> DataFrame:
    """id, hub, authority: two joins a round, values scaled by their greatest, in the end to sum 1."""
    arcs = _folded(graph, weight)
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    ids, n = graph.V.select("id"), graph.num_nodes()
    if not n:
        return ids.select("id", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))
    hub = checkpoint(_vector(graph, nstart, "x"))

    def scaled(frame: DataFrame) -> DataFrame:
        got = checkpoint(ids.join(frame, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("x")))
        top = got.agg(F.max("x")).head()[0] or 1.0
        return got.select("id", (F.col("x") / top).alias("x"))

    for _ in range(max_iter):
        auth = scaled(_push(arcs, hub, n))
        new = checkpoint(scaled(_push(back, auth, n)))
        change = new.join(hub.withColumnRenamed("x", "o"), "id").agg(F.sum(F.abs(F.col("x") - F.col("o")))).head()[0]
        hub = new
        if change < tol:
            auth = checkpoint(scaled(_push(arcs, hub, n)))
            out = hub.withColumnRenamed("x", "hub").join(auth.withColumnRenamed("x", "authority"), "id")
            if not normalized:
                return out
            h, a = out.agg(F.sum("hub"), F.sum("authority")).head()
            return out.select("id", (F.col("hub") / (h or 1.0)).alias("hub"), (F.col("authority") / (a or 1.0)).alias("authority"))
    raise FailedToConverge(f"no convergence in {max_iter} rounds")


def _group(graph: Graph, group) -> tuple[DataFrame, int, int]:
    s = checkpoint(graph.node_frame(group))
    k = s.count()
    if graph.V.join(s, "id", "left_semi").count() != k:
        raise ValueError("the group names a node that does not exist")
    return s, k, graph.num_nodes()


def group_degree_centrality(graph: Graph, group) -> float:
    s, k, n = _group(graph, group)
    if k >= n:
        return 0.0
    near = graph.arcs().join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(s, "id", "left_anti")
    return near.count() / (n - k)


def group_closeness_centrality(graph: Graph, group) -> float:
    s, k, n = _group(graph, group)
    total = bfs_distances(graph.reverse() if graph.directed else graph, s).agg(F.sum("dist")).head()[0] or 0
    return (n - k) / total if total else 0.0


def group_betweenness_centrality(graph: Graph, group, normalized: bool = True) -> float:
    """Over pairs outside the group: the share of shortest paths that are lost, or made longer, without the group."""
    s, k, n = _group(graph, group)
    members = {r[0] for r in s.collect()}  # the caller's list

    def kernel(g, v):
        if v in members:
            return []
        order, _, _, sigma, dist = K.brandes(g, v)
        # paths that avoid the group, along the same levels
        clean = {v: 1.0}
        for a in order:
            if a not in clean:
                continue
            for b, *_ in g.out[a]:
                if b not in members and dist.get(b) == dist[a] + 1:
                    clean[b] = clean.get(b, 0.0) + clean[a]
        return [(sum(1 - clean.get(t, 0.0) / sigma[t] for t in order if t != v and t not in members),)]

    total = (fan_out(graph, kernel, "c double").agg(F.sum("c")).head()[0] or 0.0) if can_broadcast(graph) else levels.lost_share(graph, s)
    if not graph.directed:
        total /= 2
    if normalized:
        pairs = (n - k) * (n - k - 1) / (1 if graph.directed else 2)
        return total / pairs if pairs > 0 else 0.0
    return total


def transitivity(graph: Graph) -> float:
    """Triangles over connected triples. Edges point from the lower (degree, id) to the higher, so no vertex opens more than about sqrt(2m) wedges."""
    if graph.directed:
        return _directed_transitivity(graph)
    e = checkpoint(graph.E.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    d = checkpoint(e.select(F.col("a").alias("id")).union(e.select("b")).groupBy("id").count())
    triples = d.agg(F.sum(F.col("count") * (F.col("count") - 1))).head()[0] or 0
    o = _oriented(e, d)
    closed = _triangles(o).count()
    return 6 * closed / triples if closed else 0.0


def _oriented(e: DataFrame, d: DataFrame) -> DataFrame:
    r = e.join(d.select(F.col("id").alias("a"), F.col("count").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("count").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    return checkpoint(r.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))


def _triangles(o: DataFrame) -> DataFrame:
    w = o.join(o.select("u", F.col("v").alias("x")), "u").where("v < x")
    ends = o.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("x"))
    return w.join(ends, ["v", "x"]).select("u", "v", "x")


def _directed_transitivity(graph: Graph) -> float:
    arcs = checkpoint(graph.E.where("src != dst").select("src", "dst").distinct())
    pairs = arcs.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("m"))
    pairs = checkpoint(pairs)
    d = pairs.select(F.col("a").alias("id"), "m").union(pairs.select("b", "m")).groupBy("id").agg(F.sum("m").alias("t"), F.sum(F.when(F.col("m") == 2, 1).otherwise(0)).alias("bi"))
    triples = d.agg(F.sum(F.col("t") * (F.col("t") - 1) - 2 * F.col("bi"))).head()[0] or 0
    simple = d.select("id", F.col("t").alias("count"))
    tri = _triangles(_oriented(pairs.select("a", "b"), simple))
    total = None
    for x, y in (("u", "v"), ("u", "x"), ("v", "x")):
        m = pairs.select(F.col("a"), F.col("b"), F.col("m").alias(f"m_{x}{y}"))
        tri = tri.join(m, (F.least(x, y) == F.col("a")) & (F.greatest(x, y) == F.col("b"))).drop("a", "b")
    # each corner counts the directed triangles through it; a triangle of the three pairs has m1*m2*m3 orientations, two per corner
    total = tri.agg(F.sum(F.col("m_uv") * F.col("m_ux") * F.col("m_vx"))).head()[0] or 0
    return 6 * total / triples / 2 if triples and total else 0.0


def core_number(graph: Graph) -> DataFrame:
    """id, core: each round takes the h-index of the neighbours' values, which falls to the core number. After the first
    round only vertices are touched of which a neighbour's value fell."""
    arcs = written(graph.arcs(True).select("src", "dst").distinct())
    deg = arcs.groupBy(F.col("src").alias("id")).count()
    x = checkpoint(graph.V.select("id").join(deg, "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("core")))
    n, fell, near = x.count(), None, arcs
    while True:
        if fell is not None:
            at = arcs.join(handy(fell.select(F.col("id").alias("dst")), k), "dst", "left_semi").select("src").distinct()
            near = arcs.join(handy(checkpoint(at), n), "src", "left_semi")
        vals = near.join(handy(x.select(F.col("id").alias("dst"), "core"), n), "dst").groupBy(F.col("src").alias("id"), "core").count()
        h = vals.groupBy("id").agg(F.expr("aggregate(reverse(array_sort(collect_list(struct(core, count)))), named_struct('n', 0L, 'h', 0L), (a, s) -> named_struct('n', a.n + s.count, 'h', greatest(a.h, least(s.core, a.n + s.count))), a -> a.h)").alias("h"))
        y = checkpoint(x.join(h, "id", "left").select("id", F.col("core").alias("o"), F.least(F.col("core"), F.coalesce("h", F.col("core") if fell is not None else F.lit(0))).alias("core")))
        fell = y.where("core < o").select("id")
        k = fell.count()
        if not k:
            return y.select("id", F.col("core").cast("bigint").alias("core"))
        x = y.select("id", "core")


def weights(graph: Graph, weight: Weight, default: float = 1.0) -> DataFrame:
    return graph.E.select("eid", weight_column(weight, default).alias("w"))
