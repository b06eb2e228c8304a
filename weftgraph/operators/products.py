"""Graph by graph operators: union, products, line graph, isomorphism, bisimulation; and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, Weight, number
from weftgraph.operators import kernels as K
from weftgraph.operators import local
from weftgraph.operators.local import BROADCAST_EDGES, Local, can_broadcast
from weftgraph.operators.refinement import isomorphism
from weftgraph.plans.fixpoint import checkpoint, fixpoint


def union(first: Graph, second: Graph, merge_nodes: bool = False, merge_edges: bool = False) -> Graph:
    """``second`` after ``first``. merge_nodes: equal payloads are the first such node of ``first``;
    merge_edges: an edge between merged nodes goes if an edge of equal payload is there. Equality joins, no pair loop."""
    at, eat = first._next(first.V, "id"), first._next(first.E, "eid")
    m = number(second.V.withColumn("n", F.lit(0)), "n", ["id"]).select("id", "payload", (F.col("n") + at).alias("n"))
    if merge_nodes:
        known = first.V.where("payload IS NOT NULL").groupBy("payload").agg(F.min("id").alias("k"))
        m = m.join(known, "payload", "left")
    else:
        m = m.withColumn("k", F.lit(None).cast("bigint"))
    m = checkpoint(m.select("id", "payload", F.coalesce("k", "n").alias("new"), F.col("k").isNotNull().alias("old")))
    V = first.V.unionByName(m.where("NOT old").select(F.col("new").alias("id"), "payload"))
    E = second.E.join(m.select(F.col("id").alias("src"), F.col("new").alias("s"), F.col("old").alias("sold")), "src").join(m.select(F.col("id").alias("dst"), F.col("new").alias("t"), F.col("old").alias("told")), "dst")
    if merge_edges:
        have = first.arcs().select(F.col("src").alias("s"), F.col("dst").alias("t"), F.col("payload").alias("p_"), F.lit(True).alias("hit")).distinct()
        E = E.join(have, (E.s == have.s) & (E.t == have.t) & E.payload.eqNullSafe(have.p_) & E.sold & E.told, "left_anti")
    E = number(E.select("eid", F.col("s").alias("src"), F.col("t").alias("dst"), "payload"), "eid", ["eid", "src", "dst"]).withColumn("eid", F.col("eid") + eat)
    return first.with_(V, first.E.unionByName(E.select("eid", "src", "dst", "payload")))


def _dense(g: Graph, a: str, b: str) -> DataFrame:
    return number(g.V.withColumn("r", F.lit(0)), "r", ["id"]).select(F.col("id").alias(a), F.col("r").alias(b), F.col("payload").alias(f"p{a}"))


def _grid(first: Graph, second: Graph) -> tuple[DataFrame, DataFrame]:
    """All pairs of vertices with row-major ids (a product's size by definition), and (x, y, id)."""
    n = second.num_nodes()
    x, y = _dense(first, "x", "rx"), _dense(second, "y", "ry")
    both = checkpoint(x.crossJoin(y).withColumn("id", F.col("rx") * n + F.col("ry")))
    return both.select("id", F.struct(F.col("px").alias("first"), F.col("py").alias("second")).alias("payload")), both.select("x", "y", "id")


def _between(E: DataFrame, m: DataFrame) -> DataFrame:
    """Product edges (x, y) - (u, v) with their new ids, numbered."""
    E = E.join(m.select("x", "y", F.col("id").alias("src")), ["x", "y"]).join(m.select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("id").alias("dst")), ["u", "v"])
    return number(E.withColumn("eid", F.lit(0)), "eid", ["part", "src", "dst", "e1", "e2"]).select("eid", "src", "dst", "payload")


def cartesian_product(first: Graph, second: Graph) -> tuple[Graph, DataFrame]:
    """Edges of one factor at each vertex of the other, with their payloads. Also (x, y, id)."""
    V, m = _grid(first, second)
    null = F.lit(None).cast("bigint")
    one = first.E.crossJoin(second.V.select(F.col("id").alias("y"))).select(F.lit(0).alias("part"), F.col("src").alias("x"), "y", F.col("dst").alias("u"), F.col("y").alias("v"), F.col("eid").alias("e1"), null.alias("e2"), "payload")
    two = second.E.crossJoin(first.V.select(F.col("id").alias("x"))).select(F.lit(1).alias("part"), "x", F.col("src").alias("y"), F.col("x").alias("u"), F.col("dst").alias("v"), null.alias("e1"), F.col("eid").alias("e2"), "payload")
    return first.with_(V, _between(one.union(two), m)), m


def tensor_product(first: Graph, second: Graph) -> tuple[Graph, DataFrame]:
    """An edge per pair of edges; undirected also crosswise unless one is a self-loop. Also (x, y, id)."""
    V, m = _grid(first, second)
    a = first.E.select(F.col("eid").alias("e1"), F.col("src").alias("x"), F.col("dst").alias("u"), F.col("payload").alias("p1"))
    b = second.E.select(F.col("eid").alias("e2"), F.col("src").alias("y"), F.col("dst").alias("v"), F.col("payload").alias("p2"))
    pairs = a.crossJoin(b)
    payload = F.struct(F.col("p1").alias("first"), F.col("p2").alias("second")).alias("payload")
    E = pairs.select(F.lit(0).alias("part"), "x", "y", "u", "v", "e1", "e2", payload)
    if not first.directed:
        E = E.union(pairs.where("x != u AND y != v").select(F.lit(1).alias("part"), "x", F.col("v").alias("y"), "u", F.col("y").alias("v"), "e1", "e2", payload))
    return first.with_(V, _between(E, m)), m


def line_graph(graph: Graph) -> tuple[Graph, DataFrame]:
    """A node per edge; an edge for two edges at each end they share. Also (eid, id)."""
    m = checkpoint(number(graph.E.select("eid").withColumn("id", F.lit(0)), "id", ["eid"]))
    ends = graph.E.select("eid", F.col("src").alias("at")).union(graph.E.where("src != dst").select("eid", "dst")).join(m, "eid").select("at", "id")
    pairs = ends.join(ends.select("at", F.col("id").alias("other")), "at").where("id < other").select(F.col("id").alias("src"), F.col("other").alias("dst"), "at")
    E = number(pairs.withColumn("eid", F.lit(0)), "eid", ["at", "src", "dst"]).select("eid", "src", "dst", F.lit(None).cast("string").alias("payload"))
    V = m.join(graph.E, "eid").select("id", "payload")
    return graph.with_(V, E, multigraph=False), m


# --- isomorphism -------------------------------------------------------------------------------


def _local(graph: Graph) -> Local:
    """The graph in this process; its size is checked."""
    if not can_broadcast(graph) or graph.V.limit(BROADCAST_EDGES + 1).count() > BROADCAST_EDGES:
        raise ValueError(f"more than {BROADCAST_EDGES} vertices or edges: the search is sequential")
    return Local([r[0] for r in graph.V.select("id").collect()], [(r[0], r[1], r[2], 0.0) for r in graph.E.select("eid", "src", "dst").collect()], graph.directed)


def vf2_mapping(first: Graph, second: Graph, node_matcher=None, edge_matcher=None, subgraph: bool = False, induced: bool = True, call_limit: int | None = None, id_order: bool = True):
    """Maps {id of first: id of second}, one by one. Matchers are callables of two payloads. ``id_order``: vertices are matched by id, else the most constrained ones first; the maps are the same."""
    a, b = _local(first), _local(second)
    if first.directed != second.directed:
        raise TypeError("both graphs must be of one kind")
    node_ok = edge_ok = None
    if node_matcher is not None:
        pa, pb = ({r.id: r.payload for r in g.V.collect()} for g in (first, second))
        node_ok = lambda t, p: node_matcher(pa[t], pb[p])
    if edge_matcher is not None:
        ea, eb = {}, {}
        for g, into in ((first, ea), (second, eb)):
            for r in g.arcs().collect():
                into.setdefault((r.src, r.dst), []).append(r.payload)
        def edge_ok(t, p):
            left = list(ea.get(t, ()))
            for y in eb.get(p, ()):
                i = next((i for i, x in enumerate(left) if edge_matcher(x, y)), None)
                if i is None:
                    return False
                left.pop(i)
            return True
    for found in K.embeddings(a, b, node_ok, edge_ok, induced, not subgraph, call_limit, id_order):
        yield {t: p for p, t in sorted(found.items(), key=lambda x: x[1])}


def is_isomorphic(first: Graph, second: Graph, node_matcher=None, edge_matcher=None, call_limit: int | None = None, id_order: bool = True) -> bool:
    """Sizes and degree sequences are compared as aggregations first. Without matchers, graphs of more than PART_ROWS vertices
    and edges are compared by colour refinement; equal keys instead of matchers: ``refinement.isomorphism``."""
    def degrees(g):
        return g.degrees().groupBy("in_degree", "out_degree").count() if g.directed else g.degrees().groupBy("degree").count()

    if first.num_nodes() != second.num_nodes() or first.num_edges() != second.num_edges():
        return False
    if not degrees(first).exceptAll(degrees(second)).isEmpty():
        return False
    if node_matcher is None and edge_matcher is None and call_limit is None and not local.within(local.PART_ROWS, first.V, first.E):
        return isomorphism(first, second) is not None
    return next(vf2_mapping(first, second, node_matcher, edge_matcher, call_limit=call_limit, id_order=id_order), None) is not None


def is_isomorphic_node_match(first: Graph, second: Graph, matcher) -> bool:
    return is_isomorphic(first, second, node_matcher=matcher)


def is_subgraph_isomorphic(first: Graph, second: Graph, node_matcher=None, edge_matcher=None, induced: bool = True, call_limit: int | None = None, id_order: bool = False) -> bool:
    """Whether ``second`` occurs in ``first``. Without matchers, in a graph of more than PART_ROWS vertices and edges, by joins (:func:`find_pattern`)."""
    if node_matcher is None and edge_matcher is None and call_limit is None and not local.within(local.PART_ROWS, first.V, first.E):
        return not find_pattern(first, second, induced).isEmpty()
    return next(vf2_mapping(first, second, node_matcher, edge_matcher, True, induced, call_limit, id_order), None) is not None


def find_pattern(graph: Graph, pattern: Graph, induced: bool = False) -> DataFrame:
    """All embeddings of a small pattern as one join per pattern edge: columns v<id>. For graphs of any size."""
    p = _local(pattern)
    need: dict[tuple[int, int], int] = {}
    for v in p.ids:
        for x, *_ in p.out[v]:
            need[v, x] = need.get((v, x), 0) + 1
    arcs = checkpoint(graph.arcs().groupBy("src", "dst").agg(F.count("*").alias("m")))
    out, have = None, []
    todo = sorted(k for k in need if p.directed or k[0] <= k[1])
    while todo or len(have) < len(p.ids):
        e = next((k for k in todo if k[0] in have or k[1] in have), todo[0] if todo else None)
        if e is None:
            v = next(v for v in p.ids if v not in have)
            one = graph.V.select(F.col("id").alias(f"v{v}"))
            out = one if out is None else out.join(one, [F.col(f"v{v}") != F.col(f"v{h}") for h in have])
            have.append(v)
            continue
        todo.remove(e)
        a, b = e
        side = arcs.where((F.col("m") >= need[e]) & ((F.col("src") == F.col("dst")) == F.lit(a == b))).select(F.col("src").alias(f"v{a}"), *([] if a == b else [F.col("dst").alias(f"v{b}")]))
        out = side if out is None else out.join(side, [f"v{x}" for x in dict.fromkeys(e) if x in have]) if any(x in have for x in e) else out.crossJoin(side)
        new = [x for x in dict.fromkeys(e) if x not in have]
        for x in new:
            for h in have:
                out = out.where(F.col(f"v{x}") != F.col(f"v{h}"))
            have.append(x)
    if induced:
        for a in p.ids:
            for b in p.ids:
                if p.directed or a <= b:
                    k = need.get((a, b), 0)
                    bad = arcs.where(F.col("m") > k).select(F.col("src").alias("s_"), F.col("dst").alias("t_"))
                    out = out.join(bad, (F.col(f"v{a}") == F.col("s_")) & (F.col(f"v{b}") == F.col("t_")), "left_anti")
    return out if out is not None else graph.V.limit(0)


def digraph_maximum_bisimulation(graph: Graph) -> DataFrame:
    """block, id of the coarsest partition in which nodes of a block have successors in the same blocks: signatures are refined until their number stays."""
    arcs = checkpoint(graph.E.select("src", "dst").distinct())

    def step(s: DataFrame, _: int) -> DataFrame:
        sig = arcs.join(s.select(F.col("id").alias("dst"), "block"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("block")).alias("sig"))
        named = s.join(sig, "id", "left").select("id", "block", F.coalesce("sig", F.array().cast("array<bigint>")).alias("sig"))
        names = named.groupBy("block", "sig").agg(F.min("id").alias("b"))
        return named.join(names, ["block", "sig"]).select("id", F.col("b").alias("block"))

    def changed(a: DataFrame, b: DataFrame) -> bool:
        return a.select("block").distinct().count() != b.select("block").distinct().count()

    first = graph.V.agg(F.min("id")).head()[0]
    if first is None:
        return graph.V.select(F.col("id").alias("block"), "id")
    out, _, _ = fixpoint(graph.V.select("id", F.lit(first).cast("bigint").alias("block")), step, changed)
    return out.select("block", "id")


# --- matrices ----------------------------------------------------------------------------------


def adjacency_matrix(graph: Graph, weight: Weight = None, default: float = 1.0, null_value: float = 0.0, parallel_edge: str = "sum", node_list: list[int] | None = None) -> DataFrame:
    """i, j, value of the cells that are not ``null_value``; i and j are dense positions in id order (or in ``node_list``).

    Parallel edges are folded by sum, min, max or avg. An undirected self-loop's further parallel edges count twice in sums.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
    if parallel_edge not in fold:
        raise ValueError("parallel_edge is one of sum, min, max, avg")
    if node_list is not None:
        pos = graph.spark.createDataFrame([(int(v), i) for i, v in enumerate(node_list)], "id bigint, r bigint")
        if pos.count() and pos.join(graph.V, "id", "left_semi").count() != len(node_list):
            raise ValueError("a listed node does not exist")
    else:
        pos = number(graph.V.select("id").withColumn("r", F.lit(0)), "r", ["id"])
    arcs = graph.weighted(weight, default)
    if not graph.directed and parallel_edge == "sum":
        loops = arcs.where("src = dst")
        first = loops.groupBy("src").agg(F.min("eid").alias("eid"))
        arcs = arcs.union(loops.join(first, ["src", "eid"], "left_anti").select("eid", "src", "dst", "w"))
    cells = arcs.groupBy("src", "dst").agg(fold[parallel_edge]("w").alias("value"))
    cells = cells.join(pos.select(F.col("id").alias("src"), F.col("r").alias("i")), "src").join(pos.select(F.col("id").alias("dst"), F.col("r").alias("j")), "dst")
    return cells.where(F.col("value") != null_value).select("i", "j", "value")


def to_numpy(cells: DataFrame, n: int, null_value: float = 0.0):
    """The dense matrix of a COO frame; only for graphs whose n*n cells fit here."""
    import numpy as np

    out = np.full((n, n), null_value)
    for r in cells.toPandas().itertuples():
        out[r.i, r.j] = r.value
    return out


def from_adjacency_matrix(spark, matrix, null_value: float = 0.0, directed: bool = True) -> Graph:
    """Edges for the cells that are not ``null_value``, in row order; undirected takes the upper triangle. Complex cells become struct<re,im>."""
    import numpy as np

    m = np.asarray(matrix)
    i, j = np.nonzero(~np.isnan(m) if isinstance(null_value, float) and np.isnan(null_value) else m != null_value)
    if not directed:
        i, j = i[i <= j], j[i <= j]
    complex_ = np.iscomplexobj(m)
    rows = [(k, int(a), int(b), (float(m[a, b].real), float(m[a, b].imag)) if complex_ else float(m[a, b])) for k, (a, b) in enumerate(zip(i, j, strict=True))]
    E = spark.createDataFrame(rows, f"eid bigint, src bigint, dst bigint, payload {'struct<re:double,im:double>' if complex_ else 'double'}")
    return Graph.from_edges(E, spark.range(m.shape[0]).select("id", F.col("id").cast("string").alias("payload")), directed)


from_complex_adjacency_matrix = from_adjacency_matrix
