"""Steps that failed, or grew faster than their input, on larger copies of the tables."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_operators import make
from weftgraph.operators import components as Co
from weftgraph.operators import kernels as K
from weftgraph.operators import paths as P
from weftgraph.operators import traversal as T
from weftgraph.operators import trees as Tr
from weftgraph.operators.local import Local
from weftgraph.sources import generators as G


def test_metric_closure_joins_no_pairs(spark):
    """The pairs were taken for a small table and broadcast through the driver."""
    g = make(spark, [(0, 1), (1, 2), (1, 3)], 4).with_(directed=False)
    got = Tr.metric_closure(g)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.src, r.dst, r.dist, r.path) for r in got.collect()) == [(0, 1, 1.0, [0, 1]), (0, 2, 2.0, [0, 1, 2]), (0, 3, 2.0, [0, 1, 3]), (1, 2, 1.0, [1, 2]), (1, 3, 1.0, [1, 3]), (2, 3, 2.0, [2, 1, 3])]
    with pytest.raises(ValueError):
        Tr.metric_closure(make(spark, [(0, 1)], 3).with_(directed=False))


@pytest.mark.parametrize("directed", [False, True])
def test_steps_to_a_target_are_those_of_the_walks(directed):
    rng = random.Random(directed)
    for _ in range(40):
        n = rng.randint(1, 25)
        edges = [(i, rng.randrange(n), rng.randrange(n), 1.0) for i in range(rng.randint(0, 2 * n))]
        g, pos = Local(range(n), edges, directed), {v: [rng.choice([rng.gauss(0, 3), rng.randint(-2, 2)]) for _ in range(2)] for v in range(n)}
        steps = P._Steps(g, pos)
        for t in range(n):
            assert steps.arriving(t) == sum(P._greedy(g, pos, s, t) is not None for s in range(n) if s != t)


def test_colours_of_edges_at_a_hub_take_time_in_proportion():
    n = 40_000
    start = time.time()
    got = K.bipartite_edges(Local(range(n + 1), [(i, 0, i + 1, 1.0) for i in range(n)], False), None)
    assert time.time() - start < 10 and sorted(c for _, c in got) == list(range(n))
    rng = random.Random(2)
    for _ in range(100):
        n = rng.randint(1, 12)
        edges = [(i, rng.randrange(n), n + rng.randrange(n), 1.0) for i in range(rng.randint(0, 5 * n))]
        got = dict(K.bipartite_edges(Local(range(2 * n), edges, False), None))
        ends = [(x, got[e]) for e, u, v, _ in edges for x in (u, v)]
        assert len(ends) == len(set(ends)) and len(set(got.values())) <= max((sum(x in (u, v) for _, u, v, _ in edges) for x in range(2 * n)), default=0)


def test_planarity_does_not_hang_on_leaves(spark, monkeypatch):
    monkeypatch.setattr(Co.local, "PART_ROWS", 0)
    five = [(i, j) for i in range(5) for j in range(i)]
    twigs = [(i % 5, 5 + i) for i in range(30)] + [(5 + i, 35 + i) for i in range(30)] + [(0, 1), (2, 2)]
    assert Co._without_leaves(make(spark, five[1:] + twigs)).V.count() == 5
    assert Co._without_leaves(make(spark, twigs)).V.isEmpty()
    assert not Co.is_planar(make(spark, five + twigs)) and Co.is_planar(make(spark, five[2:] + twigs)) and Co.is_planar(make(spark, twigs))


@pytest.mark.parametrize("directed", [False, True])
def test_searches_take_only_what_they_reach(spark, monkeypatch, directed):
    rng = random.Random(3)
    g = make(spark, [(rng.randrange(12), rng.randrange(12)) for _ in range(14)] + [(20, 21), (21, 22), (22, 3)], 25, directed)
    searches = [lambda s, f=f: [tuple(r) for r in f(g, s).orderBy("pos").collect()] for f in (T.bfs_search, T.dfs_search)]
    want = [f(s) for f in searches for s in ([1], [4, 21])]
    monkeypatch.setattr(T, "PART_ROWS", 0)
    assert [f(s) for f in searches for s in ([1], [4, 21])] == want
    assert T._reached(g, [20]).V.count() < 25


def test_metric_closure_searches_no_leaves(spark, monkeypatch):
    """Every leaf was the source of a search."""
    rng = random.Random(5)
    star = [(i, 0, i) for i in range(1, 9)]
    twigs = [(0, 1, 2), (1, 2, 2), (2, 0, 5), (2, 2, 1), (5, 2, 1)] + [(i, i % 3, rng.randint(1, 9)) for i in range(3, 14)] + [(i + 11, i, 4) for i in range(3, 14)]
    searched, fan_out = [], Tr.fan_out
    monkeypatch.setattr(Tr, "fan_out", lambda graph, *a: searched.append(graph.num_nodes()) or fan_out(graph, *a))
    monkeypatch.setattr(Tr, "STRIP", 2)
    for edges in (star, twigs):
        g = make(spark, rng.sample(edges, len(edges)))
        want, got = (monkeypatch.setattr(Tr, "SEARCHED", n) or sorted(tuple(r) for r in Tr.metric_closure(g, "payload").collect()) for n in (500, 0))
        assert got == want
    assert searched == [9, 1, 25, 3]
    assert Tr._leaves(make(spark, [(0, 1)]).weighted()).collect() == [(1, 0, 1.0)]


@pytest.mark.parametrize("directed", [False, True])
def test_depth_first_edges_of_a_large_graph_take_no_twigs(spark, monkeypatch, directed):
    """All vertices and edges went to one task, which refuses more than TASK_ROWS."""
    rng = random.Random(11 + directed)
    core = [(i, (i + 1) % 6) for i in range(6)] + [(0, 3), (3, 1), (0, 3), (2, 2)]
    twigs = [(i % 6, i) for i in range(6, 18)] + [(i - 12, i) for i in range(18, 24)] + [(18, 24), (7, 19)]
    edges = core + twigs + ([(20, 8)] if directed else [])
    g = make(spark, rng.sample(edges, len(edges)), 26, directed)
    shown = lambda s: [tuple(r) for r in T.dfs_edges(g, s).orderBy("pos").collect()]
    want = [shown(s) for s in (0, 4, None)]
    taken, as_whole = [], T.as_whole
    monkeypatch.setattr(T, "as_whole", lambda part, *a: taken.append(part.V.count()) or as_whole(part, *a))
    monkeypatch.setattr(T, "PART_ROWS", 0)
    assert [shown(s) for s in (0, 4, None)] == want
    assert max(taken[:2]) <= 9 and taken[2] <= 11, taken


def test_parallel_edges_of_a_dense_drawn_graph_are_seen_from_bits(spark, monkeypatch):
    """Every edge was written out and sent to a grouping by its ends."""
    general = G.Graph.has_parallel_edges
    monkeypatch.delattr(G.Graph, "has_parallel_edges")
    monkeypatch.setattr(G, "STRIP", 8)
    for directed in (True, False):
        g = G.gnp_random_graph(spark, 50, 0.3, 1, directed)
        ends, n = g.edge_list(), g.num_edges()
        assert not g.has_parallel_edges() and g.num_edges() == n == ends.distinct().count()
        for more in (ends.limit(1), ends.orderBy("src").limit(1).select(F.col("dst").alias("src"), F.col("src").alias("dst"))):
            both = ends.union(more).localCheckpoint()
            h = G._Unnumbered(g.V, both, directed, 50)
            assert h.has_parallel_edges() == general(g.with_(E=both)) and h.num_edges() == n + 1
    assert not G.gnp_random_graph(spark, 1, 0.3, 1).has_parallel_edges()


def test_steps_far_out_are_right_and_few():
    """The product of norms lost the digits that tell near points apart, and vertices of almost equal distance were compared one by one."""
    n = 3000
    line, pos = Local(range(n), [(i, i, i + 1, 1.0) for i in range(n - 1)], False), {i: [600 + 0.0016 * i, 0.0] for i in range(n)}
    steps = P._Steps(line, pos)
    start = time.time()
    assert {steps.arriving(t) for t in range(0, n, 50)} == {n - 1} and time.time() - start < 10
    assert P._greedy(line, pos, 10, 400) == list(range(10, 401))
    assert math.isclose(P._apart([600.0, 0.0], [600.0016, 0.0]), 0.0016**2 / (2 * (1 + 600**2)), rel_tol=1e-5)
    assert math.isclose(P._apart([3.0, -1.0], [-2.0, 0.5]), math.sqrt(11 * 5.25) + 6.5 - 1)


def test_ordered_pairs_hold_no_strips(spark, monkeypatch):
    """A task held a strip of copied rows before it passed them on."""
    monkeypatch.setattr(G, "STRIP", 8)
    for n in (0, 1, 7, 8, 21):
        pairs = G.directed_mesh_graph(spark, n).edge_list()
        assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in pairs.collect()) == [(i, j) for i in range(n) for j in range(n) if i != j]
