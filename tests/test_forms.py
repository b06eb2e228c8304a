"""The join forms beyond the broadcast bound give what the small forms give; size checks; restarts of the edge stream."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import centrality as C
from weftgraph.operators import coloring as Col
from weftgraph.operators import components as Co
from weftgraph.operators import dag as D
from weftgraph.operators import kernels as K
from weftgraph.operators import levels, local
from weftgraph.operators import paths as P
from weftgraph.operators import trees as Tr
from weftgraph.operators.local import Local
from weftgraph.plans import fixpoint
from weftgraph.sources import generators as G
from weftgraph.streaming.incremental import StreamingComponents


def make(spark, edges, n, directed=False, payloads=None):
    V = spark.createDataFrame([(i, payloads[i] if payloads else str(i)) for i in range(n)], "id bigint, payload string")
    return Graph(V, spark.createDataFrame([(i, a, b, float(w)) for i, (a, b, w) in enumerate(edges)], "eid bigint, src bigint, dst bigint, payload double"), directed)


def both(monkeypatch, run):
    small = run()
    monkeypatch.setattr(local, "BROADCAST_EDGES", 2)
    monkeypatch.setattr(levels, "SOURCES", 4)
    large = run()
    monkeypatch.undo()
    assert small and small == large
    return small


def shown(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*cols).collect())


GRAPH = [(0, 1, 3), (1, 2, 4), (2, 0, 5), (2, 3, 2), (3, 4, 7), (3, 4, 9), (1, 4, 8), (5, 5, 1), (4, 6, 3), (6, 0, 2)]


@pytest.mark.parametrize("measure", [
    lambda g: shown(C.betweenness_centrality(g, endpoints=True), "id", "score"),
    lambda g: shown(C.edge_betweenness_centrality(g), "eid", "score"),
    lambda g: shown(C.closeness_centrality(g), "id", "score") + shown(C.newman_weighted_closeness_centrality(g, "payload"), "id", "score"),
    lambda g: [C.group_betweenness_centrality(g, [1, 3])],
    lambda g: shown(P.distance_matrix(g), "src", "dst", "dist") + [P.unweighted_average_shortest_path_length(g, disconnected=True)],
    lambda g: shown(P.all_pairs_dijkstra_path_lengths(g, "payload"), "src", "dst", "dist"),
    lambda g: shown(P.all_pairs_dijkstra_shortest_paths(g, "payload + eid * 0.001"), "src", "dst", "path"),
])
def test_measures_do_not_change_beyond_the_broadcast_bound(spark, monkeypatch, measure):
    g = make(spark, GRAPH, 8, True).cached()
    both(monkeypatch, lambda: measure(g))


def test_runs_orders_and_searches_do_not_change_beyond_the_broadcast_bound(spark, monkeypatch):
    g = make(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 2), (2, 4, 2), (3, 5, 1), (4, 5, 1)], 6, True, ["a", "b", "a", "a", "z", "a"]).cached()
    assert both(monkeypatch, lambda: sorted(tuple(r.run) for r in D.collect_runs(g, "payload = 'a'").collect())) == [(0,), (2,), (3, 5)]
    assert both(monkeypatch, lambda: shown(D.lexicographical_topological_sort(g, F.col("payload")), "pos", "id"))[-1] == (5, 5)
    assert both(monkeypatch, lambda: P.astar_shortest_path(g, 0, "id = 5", "payload")) in ([0, 1, 2, 3, 5], [0, 1, 2, 4, 5])
    wires = make(spark, [(0, 2, 0), (1, 2, 1), (2, 3, 0), (2, 3, 1), (3, 4, 0), (3, 5, 1)], 6, True).cached()
    assert both(monkeypatch, lambda: sorted(tuple(r.run) for r in D.collect_bicolor_runs(wires, "id IN (2, 3)", "cast(payload AS bigint)").collect())) == [(2, 3)]


def test_sequential_kernels_refuse_what_a_task_cannot_hold(spark, monkeypatch):
    g = make(spark, GRAPH, 8)
    monkeypatch.setattr(local, "TASK_ROWS", 5)
    with pytest.raises(ValueError, match="sequential"):
        P.floyd_warshall(g)


def test_negative_cycles(spark):
    ring = [(i, (i + 1) % 12, 1) for i in range(12)]
    assert not P.negative_edge_cycle(make(spark, [*ring[:-1], (11, 0, -11)], 12, True), "payload")
    assert P.negative_edge_cycle(make(spark, [*ring[:-1], (11, 0, -12)], 12, True), "payload")
    assert P.negative_edge_cycle(make(spark, [(0, 1, -1)], 2), "payload") and not P.negative_edge_cycle(make(spark, [(0, 1, -1)], 2, True), "payload")


def test_transitive_reduction_of_random_graphs(spark):
    rng = random.Random(4)
    for n in (7, 12):
        edges = sorted({(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4})
        reach = {a: {b for x, b in edges if x == a} for a in range(n)}
        for a in reversed(range(n)):
            reach[a] |= {c for b in reach[a] for c in reach[b]}
        want = {(a, b) for a, b in edges if not any(b in reach[m] for x, m in edges if x == a and m != b)}
        g, _ = D.transitive_reduction(make(spark, [(a, b, 1) for a, b in edges], n, True))
        assert {(r.src, r.dst) for r in g.E.collect()} == want


def test_token_swaps_always_end():
    rng = random.Random(2)
    for turn in range(40):
        n = rng.randint(2, 9)
        g = Local(range(n), [(i, rng.randrange(i), i, 1.0) for i in range(1, n)], False)
        ids = rng.sample(range(n), rng.randint(1, n))
        mapping = dict(zip(ids, rng.sample(range(n), len(ids)), strict=True))
        for swaps in (K._tree_swaps(g, mapping), [s[1:] for s in K.token_swaps(g, mapping, seed=turn)]):
            tok = dict(mapping)
            for a, b in swaps:
                assert b in g.neighbors(a)
                x, y = tok.pop(a, None), tok.pop(b, None)
                tok |= ({b: x} if x is not None else {}) | ({a: y} if y is not None else {})
            assert all(v == t for v, t in tok.items())


def test_barabasi_albert_looks_at_its_first_graph(spark):
    one = G.path_graph(spark, 2)
    with pytest.raises(ValueError, match="at least m nodes"):
        G.barabasi_albert_graph(spark, 6, 3, seed=1, initial_graph=one)
    g = G.barabasi_albert_graph(spark, 8, 3, seed=1, initial_graph=G.empty_graph(spark, 4))
    assert (g.num_nodes(), g.num_edges()) == (8, 12) and not g.has_parallel_edges()


def test_components_of_a_stream_survive_restart_and_redelivery(spark, tmp_path):
    path, rng = f"{tmp_path}/labels", random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(48)]

    def want(es):
        root = {v: v for e in es for v in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in es:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {v: find(v) for v in root}

    for k in range(6):
        batch = spark.createDataFrame(edges[8 * k : 8 * k + 8], "src bigint, dst bigint")
        for _ in range(2 if k in (2, 5) else 1):  # delivered again, each time by a new object
            StreamingComponents(spark, path, compact=3).update(batch, k)
        got = StreamingComponents(spark, path).labels().collect()
        assert len(got) == len({r.id for r in got}) and {r.id: r.component for r in got} == want(edges[: 8 * k + 8])
    assert len(list((tmp_path / "labels").glob("delta-*"))) <= 6


def _strong(n, arcs):
    """Reachability both ways, by brute force: the least id of each vertex's strong component."""
    reach = []
    for v in range(n):
        seen, todo = {v}, [v]
        while todo:
            x = todo.pop()
            for a, b, _ in arcs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach.append(seen)
    return {v: min(x for x in range(n) if x in reach[v] and v in reach[x]) for v in range(n)}


@pytest.mark.parametrize("hot, parts, chain", [(500_000, 40, 40), (3, 12, 9)])
def test_components_and_forests_of_many_random_graphs(spark, monkeypatch, hot, parts, chain):
    monkeypatch.setattr(fixpoint, "HOT", hot)
    rng, edges, strong, base = random.Random(hot), [], {}, 0
    for _ in range(parts):
        n = rng.randint(1, 9)
        part = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 3)) for _ in range(rng.randint(0, 2 * n))]
        strong |= {base + v: base + c for v, c in _strong(n, part).items()}
        edges += [(base + a, base + b, w) for a, b, w in part]
        base += n
    for n, closed in ((chain, False), (chain, True)):  # a chain and a ring
        edges += [(base + i, base + i + 1, 1) for i in range(n - 1)] + [(base + n - 1, base, 1)] * closed
        strong |= {base + i: base + (0 if closed else i) for i in range(n)}
        base += n
    g = make(spark, edges, base, True).cached()
    assert {r.id: r.component for r in Co.strongly_connected_components(g).collect()} == strong

    up = list(range(base))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    forest = []
    for i, (a, b, _) in sorted(enumerate(edges), key=lambda e: (e[1][2], e[0])):
        if root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
            forest.append(i)
    assert sorted(r.eid for r in Tr.minimum_spanning_edges(g, "payload").collect()) == sorted(forest)
    assert {r.id: r.component for r in Co.connected_components(g).collect()} == {v: root(v) for v in range(base)}


def test_a_long_chain_takes_few_rounds_of_strong_components(spark, monkeypatch):
    rounds, n = [], 300
    real = Co.checkpoint
    monkeypatch.setattr(Co, "checkpoint", lambda df: rounds.append(1) or real(df))
    g = make(spark, [(i, i + 1, 1) for i in range(n - 1)], n, True)
    assert Co.number_strongly_connected_components(g) == n and len(rounds) < 60


def test_matchings_prove_themselves():
    rng = random.Random(3)
    for n, m in ((40, 90), (120, 400), (300, 900)):
        for top in (1, 5, 1000):
            e = [(i, *sorted(rng.sample(range(n), 2)), float(rng.randint(-1, top))) for i in range(m)]
            for card in (False, True):
                got = K.max_weight_matching(Local(range(n), e, False), card, verify_optimum=True)
                assert len({x for p in got for x in p}) == 2 * len(got)
    m = K._Matching(3, [(0, 1, 5), (1, 2, 3)], False)
    m.solve()
    m.mate = [-1, 2, 1]
    with pytest.raises(AssertionError):
        m.check()
