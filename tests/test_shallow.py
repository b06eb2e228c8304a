"""Breadth-first forests with paths, the contraction of large graphs, and generators that shuffle nothing."""

import math
import random
from collections import Counter

import pytest

from tests.test_operators import make
from weftgraph.operators import biconnectivity, components as Co, shallow
from weftgraph.operators import kernels as K
from weftgraph.operators.local import Local
from weftgraph.sources import generators as G


def random_edges(seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return edges + [rng.choice(edges) for _ in range(m // 5)] + [(3, n), (n, n + 1), (n + 2, n + 3)]


def local(edges, n):
    return Local(range(n), [(i, a, b, 1.0) for i, (a, b) in enumerate(edges)], False)


def partition(labelled):
    groups = {}
    for key, label in labelled:
        groups.setdefault(label, set()).add(key)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_and_cycles_of_shallow_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(Co.local, "PART_ROWS", 0)
    for name in ("rooted", "lifted"):  # neither Euler tours nor ancestor tables are built
        for module in (biconnectivity, __import__("weftgraph.operators.cycles", fromlist=["x"])):
            monkeypatch.setattr(module, name, None, raising=False)
    n = 25
    edges = random_edges(seed, n - 4, 34)
    g, one = make(spark, edges, n), local(edges, n)
    assert sorted(tuple(r) for r in Co.bridges(g).collect()) == sorted(K.bridges(one))
    assert sorted(r.id for r in Co.articulation_points(g).collect()) == [v for v, in K.articulation(one)]
    assert sorted(tuple(r) for r in Co.biconnected_components(g).collect()) == sorted(K.biconnected(one))
    got = [r.cycle for r in Co.cycle_basis(g).collect()]
    ends = {frozenset(e) for e in edges}
    assert len(got) == len(K.cycle_basis(one)) and all(len(set(c)) == len(c) and all(frozenset((a, b)) in ends for a, b in zip(c, c[1:] + c[:1], strict=True)) for c in got)
    assert len({frozenset(c) if len(c) == 1 else frozenset(map(frozenset, zip(c, c[1:] + c[:1], strict=True))) for c in got}) == len(got)


def test_deep_graphs_have_no_shallow_forest(spark, monkeypatch):
    g = make(spark, [(i, i + 1) for i in range(6)], 7)
    roots = g.V.where("id = 0").select("id")
    monkeypatch.setattr(shallow, "DEEP", 6)
    assert {r.id: r.path for r in shallow.forest(g.E, roots, 7).collect()} == {i: list(range(i + 1)) for i in range(7)}
    monkeypatch.setattr(shallow, "DEEP", 5)
    assert shallow.forest(g.E, roots, 7) is None


def test_contraction_names_parts_by_their_least_vertex(spark, monkeypatch):
    monkeypatch.setattr(Co.fix, "HOT", 3)
    monkeypatch.setattr(Co.fix, "STATE", 2)
    rng = random.Random(5)
    ids = rng.sample(range(60), 60)
    edges = [(ids[i], ids[i + 1]) for i in range(20)] + [(ids[30], x) for x in ids[31:45]] + [(ids[50], ids[51]), (ids[52], ids[52])]
    want = {i: i for i in range(60)}
    for _ in range(60):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.id: r.component for r in Co.labels(make(spark, edges, 60)).collect()} == want and max(Counter(want.values()).values()) == 21


def test_generators_make_pairs_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(G, "STRIP", 3)
    for n in (0, 1, 2, 3, 7):
        for directed in (False, True):
            g = G.complete_graph(spark, n, directed=directed)
            want = [(a, b) for a in range(n) for b in range(n) if a != b and (directed or a < b)]
            assert [tuple(r) for r in g.E.orderBy("eid").select("eid", "src", "dst").collect()] == [(i, *e) for i, e in enumerate(want)]
    graphs = [G.sbm_random_graph(spark, [4, 3], [[1.0, 0.5], [0.5, 0.0]], True, 1), G.sbm_random_graph(spark, [4, 3], [[0.0, 1.0], [0.0, 0.4]], False, 1, True), G.directed_gnp_random_graph(spark, 20, 0.3, 1)]
    for g in graphs:
        plan = g.edge_list()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "NestedLoop" not in plan and "Existing" not in plan
        ends = sorted(tuple(r) for r in g.edge_list().collect())
        assert [tuple(r) for r in g.E.orderBy("eid").select("eid", "src", "dst").collect()] == [(i, *e) for i, e in enumerate(ends)] and g.num_edges() == len(ends) == len(set(ends))
        assert not g.has_parallel_edges() and g.cached().num_edges() == len(ends)
    want = [(a, b) for a in range(4) for b in range(a, 4)]
    assert [e for e in sorted(tuple(r) for r in graphs[0].edge_list().collect()) if e[1] < 4] == want
    assert {tuple(r) for r in graphs[1].edge_list().collect()} >= {(a, b) for a in range(4) for b in range(4, 7)}


def test_geometric_graphs_number_no_edges_for_a_list(spark):
    g = G.random_geometric_graph(spark, 60, 0.3, 3, seed=2)
    pos = {r.id: r.payload.pos for r in g.V.collect()}
    want = sorted((a, b) for a in pos for b in pos if a < b and math.dist(pos[a], pos[b]) < 0.3)
    assert "Existing" not in g.edge_list()._jdf.queryExecution().executedPlan().toString() and sorted(tuple(r) for r in g.edge_list().collect()) == want


@pytest.mark.parametrize("source", [None, 2, 40])
def test_chains_do_not_hang_on_twigs(spark, monkeypatch, source):
    edges = random_edges(4, 12, 16) + [(a % 12, 20 + a) for a in range(12)] + [(20 + a, 32 + a) for a in range(12)] + [(1, 50), (1, 50)]
    g = make(spark, edges, 52)
    want = sorted(K.chains(local(edges, 52), source))
    monkeypatch.setattr(Co.local, "PART_ROWS", 0)
    assert sorted(tuple(r) for r in Co.chain_decomposition(g, source).collect()) == want and want
    assert Co._without_twigs(g, source).V.count() < 35 and Co._without_twigs(make(spark, edges[-26:-2], 44), None).E.isEmpty()
