"""Connectivity: components by label propagation with pointer jumping, strong components by colouring, and the DFS family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import InvalidNode, NullGraph
from weftgraph.graph import Graph, Weight, number
from weftgraph.operators import biconnectivity, local, shallow
from weftgraph.operators import kernels as K
from weftgraph.operators.local import as_whole, by_component, by_size, within
from weftgraph.plans import fixpoint as fix
from weftgraph.plans.fixpoint import checkpoint, fixpoint, handy, hot_keys, meet, written


def labels(graph: Graph) -> DataFrame:
    """id, component: the least id of each weakly connected part. Label propagation with pointer jumping: O(log n) rounds on chains.

    Of graphs of more than HOT vertices and edges, what is found near some edge becomes one vertex and the rest is contracted
    instead, so that a round reads what the last one has left.
    """
    if not within(fix.HOT, graph.V, graph.E):
        return _flooded(graph)
    arcs = checkpoint(graph.E.select("src", "dst").union(graph.E.select("dst", "src")).where("src != dst").distinct())

    def step(s: DataFrame, _: int) -> DataFrame:
        near = arcs.join(s.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        new = s.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = new.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        return new.join(up, "c").select("id", "old", F.least("c", "cc").alias("component"))

    start = checkpoint(graph.V.select("id", F.col("id").alias("component")).withColumn("old", F.col("component")))
    out, _, _ = fixpoint(start, step, lambda _, new: not new.where("component < old").isEmpty())
    return out.select("id", "component")


#: Levels around an edge that are searched before a large graph is contracted.
NEAR = 10


def _flooded(graph: Graph) -> DataFrame:
    """Most edges of most graphs lie in one part, and few levels away from each other. What NEAR levels find stands as its least vertex
    when the others' edges are contracted."""
    ends = shallow.pairs(graph.E)
    start = ends.select(F.col("a").alias("id")).limit(1)
    levels, _ = shallow.flood(ends, start, graph.V.count(), NEAR)
    found = written(shallow.joined(levels).select("id"))
    least = found.agg(F.min("id")).head()[0]
    if least is None:
        return graph.V.select("id", F.col("id").alias("component"))
    out = written(graph.V.select("id").join(found, "id", "left_anti"))
    one = F.lit(least).cast("bigint")
    if out.isEmpty():
        return found.select("id", one.alias("component"))
    # an edge of which one end was found has the other in the last level's reach
    mark = out.withColumn("out", F.lit(True))
    mark = fix.lent(mark, out.count(), ends, fix.IDS)
    rest = ends
    for c in "ab":
        rest = rest.join(mark.withColumnsRenamed({"id": c, "out": f"out_{c}"}), c, "left")
    rest = rest.where("out_a OR out_b").select(*(F.when(F.col(f"out_{c}"), F.col(c)).otherwise(one).alias(d) for c, d in zip("ab", ("src", "dst"), strict=True)))
    V = out.union(graph.spark.range(1).select(one.alias("id")))
    named = written(_contracted(Graph(V.withColumn("payload", F.lit(None).cast("string")), rest.select(F.lit(0).cast("bigint").alias("eid"), "src", "dst", F.lit(None).cast("string").alias("payload")))))
    name = named.where(F.col("id") == one).head().component
    return named.where(F.col("id") != one).union(found.select("id", F.lit(name).cast("bigint")))


def _contracted(graph: Graph) -> DataFrame:
    """Each vertex joins its least neighbour; of two that choose each other the lesser is a root, and other circles of choices
    cannot be. What hangs together becomes one vertex under its least id, so vertices that have an edge halve at least.

    Hubs (rows of edges) and names of giant parts (rows of the state) are hot keys, which :func:`meet` keeps apart.
    """
    from weftgraph.operators.trees import _double, _rooted

    pairs, named = written(graph.E.where("src != dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))), graph.V.select("id", F.col("id").alias("component"))
    while not pairs.isEmpty():
        best = checkpoint(pairs.union(pairs.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")))
        root, _, _ = fixpoint(_rooted(best), _double, lambda _, new: not new.where("up != old").isEmpty())
        least = root.groupBy("up").agg(F.min("id").alias("least"))
        root = checkpoint(meet(root, least, "up").select("id", F.col("least").alias("to")))
        named = named.join(handy(root.withColumnRenamed("id", "component"), root.count()), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        named, hubs = checkpoint(named), {c: hot_keys(pairs, c) for c in "ab"}
        for c in "ab":
            pairs = meet(pairs, root.withColumnRenamed("id", c), c, hubs[c]).withColumn(c, F.col("to")).select("a", "b")
        pairs = checkpoint(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return named


def connected_components(graph: Graph) -> DataFrame:
    return labels(graph)


weakly_connected_components = connected_components


def number_connected_components(graph: Graph) -> int:
    return labels(graph).where("id = component").count()


number_weakly_connected_components = number_connected_components


def is_connected(graph: Graph) -> bool:
    if graph.V.isEmpty():
        raise NullGraph("the graph has no nodes")
    return number_connected_components(graph) == 1


is_weakly_connected = is_connected


def node_connected_component(graph: Graph, node: int) -> DataFrame:
    """The ids that a node reaches, direction aside; only its own part is walked."""
    from weftgraph.operators.traversal import reach

    if not graph.has_node(node):
        raise InvalidNode(f"no node {node}")
    return reach(graph.with_(directed=False), graph.node_frame([node]))


def strongly_connected_components(graph: Graph) -> DataFrame:
    """id, component: the least id of each strong component.

    Parts of up to PART_ROWS vertices and arcs are solved in a task each. Larger ones are split: vertices get a
    random rank, and each takes the least rank that reaches it and the least that it reaches. Whatever shares a strong
    component shares both; where both are the same vertex, that is its component. The part's least rank
    is a pivot for all others, and every other rank one among those that see no lesser, so parts fall apart
    like ranges in a quicksort. See :func:`extremes` for why a round per step of a path is not needed.
    """
    arcs = checkpoint(graph.E.select("src", "dst").where("src != dst").distinct())
    if within(local.PART_ROWS, graph.V, arcs):
        return as_whole(graph.with_(E=graph.E.where("src != dst"), directed=True), K.strong_components, "id bigint, component bigint")
    rank = checkpoint(number(graph.V.select("id").withColumns({"rank": F.lit(0), "h": F.xxhash64("id")}), "rank", ["h", "id"]).select("id", "rank"))
    arcs = meet(meet(arcs, rank.select(F.col("id").alias("src"), F.col("rank").alias("a")), "src"), rank.select(F.col("id").alias("dst"), F.col("rank").alias("b")), "dst")
    arcs = checkpoint(arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).cast("bigint").alias("part")))
    rest = checkpoint(rank.select(F.col("rank").alias("id"), F.lit(0).cast("bigint").alias("part")))
    found = []
    while not rest.isEmpty():
        sizes = rest.select("part").union(arcs.select("part")).groupBy("part").count()
        large = checkpoint(sizes.where(F.col("count") > local.PART_ROWS).select("part"))  # at most rows / PART_ROWS
        of = F.broadcast(large)
        found.append(checkpoint(_small_parts(rest.join(of, "part", "left_anti"), arcs.join(of, "part", "left_anti"))))
        rest, arcs = checkpoint(rest.join(of, "part", "left_semi")), checkpoint(arcs.join(of, "part", "left_semi"))
        if rest.isEmpty():
            break
        seen = checkpoint(extremes(rest.select("id"), arcs).join(rest, "id"))
        found.append(seen.where("f = b").select("id", F.col("f").alias("component")))
        rest = checkpoint(seen.where("f != b").select("id", F.xxhash64("part", "f", "b").alias("part")))
        arcs = meet(meet(arcs.select("src", "dst"), rest.select(F.col("id").alias("src"), "part"), "src"), rest.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst")
        arcs = checkpoint(arcs.where("part = to").select("src", "dst", "part"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return _least_names(checkpoint(meet(every.withColumnRenamed("id", "rank"), rank, "rank").select("id", "component")))


def _small_parts(rest: DataFrame, arcs: DataFrame) -> DataFrame:
    one = F.lit(None).cast("string")
    g = Graph(rest.select("id", one.alias("payload")), arcs.select(F.lit(0).cast("bigint").alias("eid"), "src", "dst", one.alias("payload")), True)
    return by_component(g, K.strong_components, "id bigint, component bigint", parts=rest.select("id", F.col("part").alias("component")))


def extremes(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, f, b: the least id that reaches each vertex and the least that it reaches, itself included.

    Besides passing values along arcs, a vertex takes over what the vertex it names has found: who reaches that one
    reaches it too. With ids in random order the span over which a value is the least grows by a
    factor each round instead of a step, so long paths and layers take about log n rounds.
    """
    ins, outs = hot_keys(arcs, "src"), hot_keys(arcs, "dst")
    big = not within(fix.HOT, vertices)

    def step(s: DataFrame, _: int) -> DataFrame:
        down = meet(arcs, s.select(F.col("id").alias("src"), "f"), "src", ins).select(F.col("dst").alias("id"), F.col("f").alias("mf"), F.lit(None).cast("bigint").alias("mb"))
        back = meet(arcs, s.select(F.col("id").alias("dst"), "b"), "dst", outs).select(F.col("src").alias("id"), F.lit(None).cast("bigint").alias("mf"), F.col("b").alias("mb"))
        near = down.union(back).groupBy("id").agg(F.min("mf").alias("mf"), F.min("mb").alias("mb"))
        new = checkpoint(s.select("id", F.col("f").alias("of"), F.col("b").alias("ob")).join(near, "id", "left").select("id", "of", "ob", F.least("of", "mf").alias("f"), F.least("ob", "mb").alias("b")))
        for name in "fb":
            up = new.select(F.col("id").alias(name), F.col(name).alias("x"))
            new = (meet(new, up, name) if big else new.join(up, name)).withColumn(name, F.least(name, "x")).select("id", "of", "ob", "f", "b")
        return new

    start = vertices.select("id", *(F.col("id").alias(c) for c in ("of", "ob", "f", "b")))
    out, _, _ = fixpoint(start, step, lambda _, new: not new.where("f < of OR b < ob").isEmpty())
    return out.select("id", "f", "b")


def _least_names(found: DataFrame) -> DataFrame:
    names = found.groupBy("component").agg(F.min("id").alias("least"))
    return found.join(names, "component").select("id", F.col("least").alias("component"))


def number_strongly_connected_components(graph: Graph) -> int:
    return strongly_connected_components(graph).select("component").distinct().count()


def is_strongly_connected(graph: Graph) -> bool:
    """Some vertex reaches all and is reached by all."""
    from weftgraph.operators.traversal import reach

    head = graph.V.agg(F.min("id"), F.count("*")).head()
    if not head[1]:
        raise NullGraph("the graph has no nodes")
    start = graph.node_frame([head[0]])
    return reach(graph, start).count() == head[1] == reach(graph.reverse(), start).count()


def condensation(graph: Graph, sccs: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The quotient graph by components and (id, block). Payloads: the members' payloads in id order.

    Directed: one edge per pair of blocks, the last payload, none inside. Undirected: all edges
    stay, those inside as self-loops.
    """
    from weftgraph.graph import number

    comp = sccs if sccs is not None else strongly_connected_components(graph) if graph.directed else labels(graph)
    comp = checkpoint(comp)
    names = number(comp.select("component").distinct().withColumn("block", F.lit(0)), "block", ["component"])
    m = checkpoint(comp.join(names, "component").select("id", "block"))
    V = graph.V.join(m, "id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "payload"))).alias("p"))
    V = V.select(F.col("block").alias("id"), F.col("p.payload").alias("payload"))
    E = graph.E.join(m.select(F.col("id").alias("src"), F.col("block").alias("s")), "src").join(m.select(F.col("id").alias("dst"), F.col("block").alias("t")), "dst").select("eid", F.col("s").alias("src"), F.col("t").alias("dst"), "payload")
    if graph.directed:
        E = E.where("src != dst").groupBy("src", "dst").agg(F.max("eid").alias("eid"), F.max_by("payload", "eid").alias("payload")).select("eid", "src", "dst", "payload")
    return graph.with_(V, E), m


def is_semi_connected(graph: Graph) -> bool:
    """Of every two vertices one reaches the other: the condensation's longest path visits all its nodes."""
    from weftgraph.operators.dag import dag_longest_path_length

    if graph.V.isEmpty():
        raise NullGraph("the graph has no nodes")
    quotient, _ = condensation(graph)
    return dag_longest_path_length(quotient) == quotient.num_nodes() - 1


def isolates(graph: Graph) -> DataFrame:
    ends = graph.E.select(F.col("src").alias("id")).union(graph.E.select("dst"))
    return graph.V.select("id").join(ends, "id", "left_anti")


def _sized(graph: Graph, kernel, schema: str, far) -> DataFrame:
    """``kernel`` for small components, each in a task, and ``far`` (a function of the graph) for large ones."""
    small, large = by_size(graph)
    near = None if small is None else by_component(graph, kernel, schema, parts=small)
    if large is None:
        return near
    return far(large) if near is None else near.union(far(large))


def articulation_points(graph: Graph) -> DataFrame:
    """id of every vertex whose removal parts its component: those that lie in two blocks or more."""

    def far(g: Graph) -> DataFrame:
        tree = biconnectivity.blocks(g)[0]
        at = tree.select("id", "block").union(tree.select("parent", "block")).distinct()
        return at.groupBy("id").count().where("count > 1").select("id")

    return _sized(graph.with_(directed=False), K.articulation, "id bigint", far)


def bridges(graph: Graph) -> DataFrame:
    """src, dst of every edge whose removal parts its component, as the edge is given."""
    return _sized(graph.with_(directed=False), K.bridges, "src bigint, dst bigint", biconnectivity.bridges)


def biconnected_components(graph: Graph) -> DataFrame:
    """src, dst, comp; comp is the least edge id of the component. Self-loops belong to none."""

    def far(g: Graph) -> DataFrame:
        edges = biconnectivity.blocks(g)[1]()
        names = edges.groupBy("block").agg(F.min("eid").alias("comp"))
        return meet(edges, names, "block").select("src", "dst", "comp")

    return _sized(graph.with_(directed=False), K.biconnected, "src bigint, dst bigint, comp bigint", far)


def chain_decomposition(graph: Graph, source: int | None = None) -> DataFrame:
    """Vertices of one edge to a lesser vertex lie on no chain and are no root of a search: of a large graph they go, as long as each round takes a share of it."""
    g = graph.with_(directed=False)
    if not within(local.PART_ROWS, g.V, g.E):
        g = _without_twigs(g, source)
    return as_whole(g, lambda part: K.chains(part, source), "chain bigint, pos bigint, src bigint, dst bigint")


def _without_twigs(graph: Graph, keep: int | None) -> Graph:
    """Without loops, and without vertices whose one edge leads to a lesser vertex, until a round takes fewer than one in twenty; ``keep`` stays."""
    E = written(graph.E.where("src != dst"))
    gone, n = None, E.count()
    while n:
        ends = E.select(F.greatest("src", "dst").alias("id"), F.lit(1).alias("up")).union(E.select(F.least("src", "dst"), F.lit(0)))
        twigs = ends.groupBy("id").agg(F.count("*").alias("n"), F.sum("up").alias("up")).where("n = 1 AND up = 1").select("id")
        twigs = checkpoint(twigs if keep is None else twigs.where(F.col("id") != keep))
        E = written(E.withColumn("id", F.greatest("src", "dst")).join(twigs, "id", "left_anti").drop("id"))
        gone = twigs if gone is None else gone.union(twigs)
        left = E.count()
        if n - left < n // 20 + 1:
            break
        n = left
    return graph.with_(graph.V if gone is None else graph.V.join(gone, "id", "left_anti"), E)


def cycle_basis(graph: Graph, root: int | None = None) -> DataFrame:
    """cycle: a basis of cycles, those that edges outside a spanning forest close (of the root's component, if given)."""
    from weftgraph.operators.cycles import fundamental_cycles

    g, schema = graph.with_(directed=False), "cycle array<bigint>"
    if within(local.PART_ROWS, g.V, g.E):
        return as_whole(g, lambda part: K.cycle_basis(part, root), schema)
    small, large = by_size(g)
    far = None if large is None else fundamental_cycles(large, root)
    if small is None:
        return far
    near = by_component(g, lambda part: K.cycle_basis(part, root) if root is None or root in part.out else [], schema, parts=small)
    return near if far is None else near.union(far)


def simple_cycles(graph: Graph) -> DataFrame:
    """All elementary cycles of a directed graph; each starts at its least id. Parts run in parallel."""
    return by_component(graph, K.simple_cycles, "cycle array<bigint>")


def digraph_find_cycle(graph: Graph, source: int | None = None) -> DataFrame:
    return as_whole(graph, lambda g: K.find_cycle(g, source), "pos bigint, src bigint, dst bigint")


def is_planar(graph: Graph) -> bool:
    """Vertices of one neighbour change nothing: of a large graph they go, as long as each round takes a share of it."""
    g = graph.with_(directed=False)
    if not within(local.PART_ROWS, g.V, g.E):
        g = _without_leaves(g)
    found = by_component(g, lambda part: [(K.planar(part),)], "planar boolean")
    return found.where("NOT planar").isEmpty()


def _without_leaves(graph: Graph) -> Graph:
    """Without parallel edges and loops, and without vertices of at most one neighbour, until a round takes fewer than one in twenty."""
    E = graph.E.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "eid", "payload")
    E = checkpoint(E.groupBy("src", "dst").agg(F.min("eid").alias("eid"), F.min_by("payload", "eid").alias("payload")).select("eid", "src", "dst", "payload"))
    n = E.count()
    while n:
        ends = E.select(F.col("src").alias("id")).union(E.select("dst")).groupBy("id").count().where("count > 1").select("id")
        keep = checkpoint(ends)
        E = checkpoint(E.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("eid", "src", "dst", "payload"))
        left = E.count()
        if n - left < n // 20 + 1:
            break
        n = left
    return graph.with_(E.select(F.col("src").alias("id")).union(E.select("dst")).distinct().withColumn("payload", F.lit(None).cast("string")), E)


def stoer_wagner_min_cut(graph: Graph, weight: Weight = None) -> tuple[float, list[int]] | None:
    """Weight of a lightest cut and one side. Graphs of more than ``cuts.SMALL`` vertices are contracted first; ``cuts.minimum_cut`` leaves the side in a table."""
    from weftgraph.operators import cuts

    if within(cuts.SMALL, graph.V) and within(local.TASK_ROWS, graph.E):
        row = as_whole(graph.with_(directed=False), K.min_cut, "value double, side array<bigint>", weight).head()
        return None if row is None else (row[0], list(row[1]))
    found = cuts.minimum_cut(graph, weight)
    return None if found is None else (found[0], sorted(r.id for r in found[1].collect()))


def connected_subgraphs(graph: Graph, k: int) -> DataFrame:
    """All vertex sets of size k that induce a connected subgraph: sets grow by a neighbour per round and are made distinct."""
    if k > graph.num_nodes():
        raise ValueError("k exceeds the number of nodes")
    if k <= 0:
        return graph.V.limit(0).select(F.array("id").alias("nodes"))
    arcs = checkpoint(graph.arcs(True).select("src", "dst").where("src != dst").distinct())
    sets = graph.V.select(F.array("id").alias("nodes"))
    for _ in range(k - 1):
        more = sets.select("nodes", F.explode("nodes").alias("src")).join(arcs, "src").where(~F.array_contains("nodes", F.col("dst")))
        sets = checkpoint(more.select(F.array_sort(F.array_append("nodes", F.col("dst"))).alias("nodes")).distinct())
    return sets


def complement(graph: Graph) -> Graph:
    """Every missing edge between different vertices; the payload is null. The output is quadratic by nature."""
    from weftgraph.graph import number

    a, b = graph.V.select(F.col("id").alias("src")), graph.V.select(F.col("id").alias("dst"))
    pairs = a.join(b, F.col("src") != F.col("dst") if graph.directed or not graph.is_multigraph else F.col("src") < F.col("dst"))
    new = pairs.join(graph.arcs().select("src", "dst"), ["src", "dst"], "left_anti")
    kind = graph.E.schema["payload"].dataType
    E = number(new.withColumn("eid", F.lit(0)), "eid", ["src", "dst"]).select("eid", "src", "dst", F.lit(None).cast(kind).alias("payload"))
    return graph.with_(E=E)


def local_complement(graph: Graph, node: int) -> Graph:
    """Edges among the neighbours of a node are toggled."""
    from weftgraph.graph import number

    if graph.is_multigraph:
        raise ValueError("local complementation needs a graph without parallel edges")
    if not graph.has_node(node):
        raise InvalidNode(f"no node {node}")
    near = checkpoint(graph.neighbors(node).where(F.col("id") != node))
    pairs = near.select(F.col("id").alias("src")).join(near.select(F.col("id").alias("dst")), F.col("src") < F.col("dst"))
    ends = graph.E.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "eid")
    hit = pairs.join(ends, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left")
    kind = graph.E.schema["payload"].dataType
    new = number(hit.where("eid IS NULL").select("src", "dst").withColumn("eid", F.lit(0)), "eid", ["src", "dst"])
    at = graph._next(graph.E, "eid")
    new = new.select((F.col("eid") + at).alias("eid"), "src", "dst", F.lit(None).cast(kind).alias("payload"))
    return graph.with_(E=graph.E.join(hit.where("eid IS NOT NULL").select("eid"), "eid", "left_anti").unionByName(new))


def is_bipartite(graph: Graph) -> bool:
    from weftgraph.operators.coloring import two_color

    return two_color(graph) is not None
