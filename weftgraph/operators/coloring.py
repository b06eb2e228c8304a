"""Colouring, matching and token swapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import GraphNotBipartite, InvalidMapping
from weftgraph.graph import Graph, Weight
from weftgraph.operators import kernels as K
from weftgraph.operators.components import labels
from weftgraph.operators.local import as_whole, by_component, by_size
from weftgraph.operators.traversal import bfs_distances
from weftgraph.plans.fixpoint import checkpoint, hot_keys, meet


def two_color(graph: Graph) -> DataFrame | None:
    """id, color 0 or 1, or None if an edge joins equal colours. The least id of each part has colour 1; colours are the parity of the distance to it."""
    roots = labels(graph).where("id = component").select("id")
    color = checkpoint(bfs_distances(graph, roots, True).select("id", (1 - F.col("dist") % 2).cast("bigint").alias("color")))
    a, b = color.select(F.col("id").alias("src"), F.col("color").alias("a")), color.select(F.col("id").alias("dst"), F.col("color").alias("b"))
    return color if graph.E.join(a, "src").join(b, "dst").where("a = b").isEmpty() else None


def _adjacency(g):
    return {v: set(g.all_neighbors(v)) - {v} for v in g.ids}


def greedy_color(graph: Graph, preset: dict[int, int] | None = None, strategy: str = "degree") -> DataFrame:
    """id, color; strategies degree, saturation, independent_set; parts are coloured in parallel.

    By degree, components of more than PART_ROWS vertices and edges are coloured in rounds (:func:`colored_in_rounds`) with
    the same result; the other strategies choose the next vertex by all colours so far and stay sequential.
    """
    given = dict(preset or {})
    kernel, schema = lambda g: list(K.greedy_colors(_adjacency(g), {v: c for v, c in given.items() if v in g.out}, strategy).items()), "id bigint, color bigint"
    if strategy != "degree":
        return by_component(graph, kernel, schema)
    small, large = by_size(graph)
    near = None if small is None else by_component(graph, kernel, schema, parts=small)
    if large is None:
        return near
    far = colored_in_rounds(large, given)
    return far if near is None else near.union(far)


def colored_in_rounds(graph: Graph, preset: dict[int, int]) -> DataFrame:
    """id, color: the greedy colouring by falling degree, then id (after the preset vertices), where a vertex takes the least colour that is free as
    soon as all neighbours before it have theirs. Every round colours all such vertices, so there are as many
    rounds as the longest chain of neighbours in that order; each arc is a message once."""
    arcs = checkpoint(graph.E.select("src", "dst").union(graph.E.select("dst", "src")).where("src != dst").distinct())
    order = graph.V.select("id").join(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    if preset:
        given = graph.spark.createDataFrame([(int(v), int(c)) for v, c in preset.items()], "id bigint, color bigint")
        order = order.join(given, "id", "left")
    else:
        order = order.withColumn("color", F.lit(None).cast("bigint"))
    order = checkpoint(order)
    # arcs lead from earlier vertices to later ones that are not coloured yet
    rank = lambda c, d: F.struct(F.col(c).isNull(), -F.col(d), F.col("src" if d == "ds" else "dst"))
    both = meet(arcs, order.select(F.col("id").alias("src"), F.col("d").alias("ds"), F.col("color").alias("cs")), "src")
    both = meet(both, order.select(F.col("id").alias("dst"), F.col("d").alias("dd"), F.col("color").alias("cd")), "dst")
    ahead = checkpoint(both.where("cd IS NULL").where(rank("cs", "ds") < rank("cd", "dd")).select("src", "dst"))
    waits = ahead.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    done = checkpoint(order.where("color IS NOT NULL").select("id", "color"))
    left = checkpoint(order.where("color IS NULL").select("id").join(waits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))
    left = left.withColumn("colors", F.array().cast("array<bigint>"))
    front, parts, m = done, [done], left.count()
    hubs = hot_keys(ahead, "src")
    while True:
        told = meet(ahead, front.select(F.col("id").alias("src"), "color"), "src", hubs).select(F.col("dst").alias("id"), "color")
        heard = checkpoint(told.groupBy("id").agg(F.count("*").alias("c"), F.collect_set("color").alias("colors")))
        left = left.join(heard.withColumnRenamed("colors", "more"), "id", "left").select("id", (F.col("n") - F.coalesce("c", F.lit(0))).alias("n"), F.array_union("colors", F.coalesce("more", F.array().cast("array<bigint>"))).alias("colors"))
        left = checkpoint(left)
        ready = left.where("n = 0").select("id", F.expr("array_min(array_except(sequence(0L, cast(size(colors) AS bigint)), colors))").alias("color"))
        front = checkpoint(ready)
        k = front.count()
        if not k:
            break
        parts.append(front)
        left = left.where("n > 0")
        m -= k
        if not m:
            break
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _edge_adjacency(g):
    at: dict[int, set[int]] = {}
    for e, u, v, _ in g.edges:
        at.setdefault(u, set()).add(e)
        at.setdefault(v, set()).add(e)
    return {e: (at[u] | at[v]) - {e} for e, u, v, _ in g.edges}


def greedy_edge_color(graph: Graph, preset: dict[int, int] | None = None, strategy: str = "degree") -> DataFrame:
    given = dict(preset or {})

    def kernel(g):
        adj = _edge_adjacency(g)
        return list(K.greedy_colors(adj, {e: c for e, c in given.items() if e in adj}, strategy).items())

    return by_component(graph, kernel, "eid bigint, color bigint")


def misra_gries_edge_color(graph: Graph) -> DataFrame:
    return by_component(graph, K.edge_fans, "eid bigint, color bigint")


def bipartite_edge_color(graph: Graph) -> DataFrame:
    """As many colours as the greatest degree."""
    if two_color(graph) is None:
        raise GraphNotBipartite("the graph is not bipartite")
    return by_component(graph, lambda g: K.bipartite_edges(g, None), "eid bigint, color bigint")


def max_weight_matching(graph: Graph, max_cardinality: bool = False, weight: Weight = None, default: int = 1, verify_optimum: bool = False) -> DataFrame:
    """src, dst of a matching of greatest weight (integers); parts are matched in parallel.

    ``verify_optimum`` has every part prove its result by its duals, and fails the job if they do not.
    """
    return by_component(graph, lambda g: K.max_weight_matching(g, max_cardinality, verify_optimum), "src bigint, dst bigint", weight, float(default))


def is_matching(graph: Graph, matching) -> bool:
    """Every pair is an edge and no vertex occurs twice."""
    m = _pairs(graph, matching)
    ends = m.select(F.col("src").alias("id")).union(m.select("dst"))
    if not ends.groupBy("id").count().where("count > 1").isEmpty():
        return False
    return m.join(graph.arcs(True).select("src", "dst"), ["src", "dst"], "left_anti").isEmpty()


def _pairs(graph: Graph, matching) -> DataFrame:
    if isinstance(matching, DataFrame):
        return matching.select("src", "dst")
    return graph.spark.createDataFrame([(int(a), int(b)) for a, b in {tuple(sorted(p)) for p in matching}], "src bigint, dst bigint")


def is_maximal_matching(graph: Graph, matching) -> bool:
    m = _pairs(graph, matching)
    if not is_matching(graph, m):
        return False
    used = m.select(F.col("src").alias("id")).union(m.select("dst"))
    free = graph.E.where("src != dst").join(used.select(F.col("id").alias("src")), "src", "left_anti").join(used.select(F.col("id").alias("dst")), "dst", "left_anti")
    return free.isEmpty()


def token_swapper(graph: Graph, mapping: dict[int, int], trials: int = 4, seed: int = 0) -> DataFrame:
    """pos, src, dst: swaps along edges after which the token of each key lies at its value."""
    ids = set(mapping) | set(mapping.values())
    if len(set(mapping.values())) != len(mapping):
        raise InvalidMapping("two tokens want one place")
    comp = {r.id: r.component for r in labels(graph).where(F.col("id").isin(list(ids))).collect()} if ids else {}
    if len(comp) != len(ids) or any(comp[a] != comp[b] for a, b in mapping.items()):
        raise InvalidMapping("a token cannot reach its place")
    return as_whole(graph, lambda g: K.token_swaps(g, mapping, trials, seed), "pos bigint, src bigint, dst bigint")
