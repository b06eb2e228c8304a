"""The forms for components that no task holds against kernels and brute force, with the bound lowered."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import centrality as C
from weftgraph.operators import coloring as Col
from weftgraph.operators import components as Co
from weftgraph.operators import dag as D
from weftgraph.operators import cuts, euler, local, tiles
from weftgraph.operators import kernels as K
from weftgraph.operators import paths as P
from weftgraph.operators import products as Pr
from weftgraph.sources import generators as G


def make(spark, edges, n, directed=False):
    V = spark.createDataFrame([(i, str(i)) for i in range(n)], "id bigint, payload string")
    return Graph(V, spark.createDataFrame([(i, a, b, float(1 + (a * 7 + b) % 5)) for i, (a, b) in enumerate(edges)], "eid bigint, src bigint, dst bigint, payload double"), directed).cached()


def shown(df):
    return sorted(map(tuple, df.collect()))


def tangle(seed):
    """A tree with extra edges, parallel ones, loops, rings and lone vertices; a part below the bound."""
    rng = random.Random(seed)
    e = [(i, rng.randrange(max(0, i - 3), i)) for i in range(1, 40)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(9)]
    return e + [(45, 46), (46, 47), (47, 45), (47, 48), (50, 50), (51, 52), (51, 52)], 56


def test_blocks_bridges_and_cut_vertices(spark, monkeypatch):
    g = make(spark, *tangle(3))
    measures = (Co.articulation_points, Co.bridges, Co.biconnected_components)
    want = [shown(f(g)) for f in measures]
    monkeypatch.setattr(local, "PART_ROWS", 8)
    assert all(want) and [shown(f(g)) for f in measures] == want


def test_forest_numbers(spark):
    tree = [(0, 1), (1, 2), (1, 3), (3, 4), (0, 5), (10, 11), (11, 12)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(tree)], "eid bigint, src bigint, dst bigint")
    f = {r.id: r for r in euler.rooted(df, spark.createDataFrame([(0,), (11,), (20,)], "id bigint")).collect()}
    assert {i: r.parent for i, r in f.items()} == {0: None, 1: 0, 2: 1, 3: 1, 4: 3, 5: 0, 11: None, 10: 11, 12: 11, 20: None}
    assert {i: (r.depth, r.size) for i, r in f.items()} == {0: (0, 6), 1: (1, 4), 2: (2, 1), 3: (2, 2), 4: (3, 1), 5: (1, 1), 11: (0, 3), 10: (1, 1), 12: (1, 1), 20: (0, 1)}
    assert sorted(r.pre for r in f.values()) == list(range(10)) and all(f[r.parent].pre < r.pre < f[r.parent].pre + f[r.parent].size for r in f.values() if r.parent is not None)
    forest = spark.createDataFrame(list(f.values()))
    tables = euler.lifted(forest)
    pairs = spark.createDataFrame([(2, 4), (4, 5), (1, 4), (10, 12), (11, 12)], "u bigint, w bigint")
    assert shown(euler.lowest_common_ancestors(pairs, forest, tables)) == [(1, 4, 1), (2, 4, 1), (4, 5, 0), (10, 12, 11), (11, 12, 11)]


def test_range_extremes(spark):
    rng = random.Random(4)
    x = [(i, rng.randrange(1000), rng.randrange(1000)) for i in range(150)]
    spans = [(k, a := rng.randrange(150), rng.randint(1, 150 - a)) for k in range(120)] + [(120, 0, 150), (121, 149, 1)]
    got = shown(euler.range_extremes(spark.createDataFrame(x, "pos bigint, lo bigint, hi bigint"), spark.createDataFrame(spans, "id bigint, start bigint, size bigint"), 150))
    assert got == [(k, min(v[1] for v in x[a : a + n]), max(v[2] for v in x[a : a + n])) for k, a, n in sorted(spans)]


def brute_strong(edges, n):
    adj = {i: set() for i in range(n)}
    for a, b in edges:
        adj[a].add(b)

    def reach(s):
        seen, todo = {s}, [s]
        while todo:
            for x in adj[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return seen

    r = [reach(i) for i in range(n)]
    return [(i, min(j for j in range(n) if j in r[i] and i in r[j])) for i in range(n)]


@pytest.mark.parametrize("bound", [40_000, 3])
def test_strong_components(spark, monkeypatch, bound):
    monkeypatch.setattr(local, "PART_ROWS", bound)
    rng = random.Random(3)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(i, i + 1) for i in range(60, 80)] + [(75, 70), (80, 80)]
    assert shown(Co.strongly_connected_components(make(spark, e, 83, True))) == brute_strong(e, 83)


def test_greedy_colors_in_rounds(spark, monkeypatch):
    g = make(spark, *tangle(5))
    want = [shown(Col.greedy_color(g, p)) for p in (None, {3: 2, 46: 4})]
    monkeypatch.setattr(local, "PART_ROWS", 8)
    assert [shown(Col.greedy_color(g, p)) for p in (None, {3: 2, 46: 4})] == want


def test_cycle_bases(spark, monkeypatch):
    edges, n = tangle(6)
    g = make(spark, edges, n)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in edges})
    at = {p: i for i, p in enumerate(pairs)}
    size = len(Co.cycle_basis(g).collect())
    monkeypatch.setattr(local, "PART_ROWS", 8)
    found, basis = [list(r.cycle) for r in Co.cycle_basis(g).collect()], []
    assert len(found) == size
    for c in found:
        steps = [(min(a, b), max(a, b)) for a, b in zip(c, c[1:] + c[:1], strict=True)]
        v = sum(1 << at[p] for p in steps)
        assert len(set(c)) == len(c) and len(set(steps)) == len(steps)
        for b in basis:
            v = min(v, v ^ b)
        assert v  # independent of those before
        basis.append(v)
    assert {x for r in Co.cycle_basis(g, 46).collect() for x in r.cycle} == {45, 46, 47}


def test_longest_paths_and_ranks(spark):
    rng = random.Random(2)
    e = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(22)})
    g = make(spark, e, 31, True)
    w, best = {(a, b): 1 + (a * 7 + b) % 5 for a, b in e}, {}
    for v in range(31):
        best[v] = max([best[a] + w[a, b] for a, b in e if b == v], default=0)
    path = D.dag_longest_path(g, "payload")
    assert sum(w[p] for p in zip(path, path[1:], strict=False)) == max(best.values()) == D.dag_longest_path_length(g, "payload")
    ranks = C.pagerank(make(spark, [(0, 1), (1, 2), (2, 0), (3, 0)], 5, True), personalization={0: 1.0, 3: 1.0}, tol=1e-4)
    assert sum(r.score for r in ranks.collect()) == pytest.approx(1)


def test_strong_kernel():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 9)
        e = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 16))]
        got = K.strong_components(local.Local(range(n), [(i, a, b, 1.0) for i, (a, b) in enumerate(e)], True))
        assert sorted(got) == brute_strong(e, n)


def test_recursive_generator_grows_by_a_step_a_round(spark):
    g = G.dorogovtsev_goltsev_mendes_graph(spark, 6)
    assert g.num_edges() == 3**6 and g.E.select("eid").distinct().count() == 3**6
    assert g.E.agg(F.max(F.greatest("src", "dst"))).head()[0] == (3**6 + 3) // 2 - 1


def test_tiles_and_k_best_lists(spark, monkeypatch):
    rng = random.Random(7)
    g = make(spark, [(rng.randrange(22), rng.randrange(22)) for _ in range(60)] + [(3, 4), (3, 4), (5, 5)], 24, True)
    want = [shown(f(g, "payload")) for f in (P.floyd_warshall, P.floyd_warshall_successor_and_distance)] + [shown(P.k_shortest_path_lengths(g, 0, 3, "payload"))]
    monkeypatch.setattr(P, "DENSE", 5)
    monkeypatch.setattr(tiles, "SIDE", 10)
    monkeypatch.setattr(local, "PART_ROWS", 5)
    assert shown(P.floyd_warshall(g, "payload")) == want[0]
    assert shown(P.k_shortest_path_lengths(g, 0, 3, "payload")) == want[2]
    got = {(a, b): (d, x) for a, b, d, x in shown(P.floyd_warshall_successor_and_distance(g, "payload"))}
    assert {k: d for k, (d, _) in got.items()} == {(a, b): d for a, b, d, _ in want[1]}
    w = {}
    for r in g.E.collect():
        w[r.src, r.dst] = min(w.get((r.src, r.dst), r.payload), r.payload)
    for (a, b), (d, x) in got.items():  # the next vertex is a step of a shortest path
        if a != b:
            assert (x == b and d == float("inf")) or d == w[a, x] + got[x, b][0]


def runs_by_walking(edges, n, passes):
    """One chain after another from the least (generation, id) that is in none."""
    out, into = {i: set() for i in range(n)}, {i: set() for i in range(n)}
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)
    gen = {}

    def depth(v):
        gen[v] = gen[v] if v in gen else 1 + max(map(depth, into[v]), default=-1)
        return gen[v]

    taken, found = set(), []
    for v in sorted(range(n), key=lambda v: (depth(v), v)):
        run = []
        while v is not None and v not in taken and passes(v):
            run.append(v)
            taken.add(v)
            v = next(iter(out[v])) if len(out[v]) == 1 else None
        if run:
            found.append(tuple(run))
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(i, rng.randrange(i + 1, min(n, i + 4))) for i in range(n - 1)] + [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.006]
    g = make(spark, edges, n, True)
    got = sorted(tuple(r.run) for r in D.collect_runs(g, "id % 7 != 3").collect())
    assert got == runs_by_walking(edges, n, lambda v: v % 7 != 3)
    long = make(spark, [(i, i + 1) for i in range(20)] * 2, 22, True)
    assert sorted(tuple(r.run) for r in D.collect_runs(long, "true").collect()) == [tuple(range(21)), (21,)]
    assert D.collect_runs(long, "CAST(NULL AS BOOLEAN)").isEmpty()


def least_cut(edges, n, w):
    total = lambda side: sum(w(a, b) for a, b in edges if (a in side) != (b in side))
    return min(total({v for v in range(n) if m >> v & 1}) for m in range(1, 2 ** (n - 1)))


@pytest.mark.parametrize("seed", [3])
def test_minimum_cut(spark, monkeypatch, seed):
    rng = random.Random(seed)
    n = 10
    halves = [(a, b) for a in range(n) for b in range(a) if (a < 5) == (b < 5) and rng.random() < 0.8]
    edges = halves + [(4, 5), (0, 9), (0, 9), (3, 3)]
    weight = lambda a, b: float(1 + (a * 7 + b) % 5)  # noqa: E731  (what make gives)
    g = make(spark, edges, n)
    monkeypatch.setattr(cuts, "SMALL", 3)
    value, side = Co.stoer_wagner_min_cut(g, "payload")
    assert value == least_cut([e for e in edges if e != (3, 3)], n, weight)
    assert 0 < len(side) < n and value == sum(weight(a, b) for a, b in edges if (a in side) != (b in side))
    monkeypatch.setattr(cuts, "SMALL", 1_000)
    apart = make(spark, [(0, 1), (1, 2), (2, 0), (3, 4)], 5)
    value, side = Co.stoer_wagner_min_cut(apart)
    monkeypatch.setattr(cuts, "SMALL", 0)
    assert (value, Co.stoer_wagner_min_cut(apart)) == (0.0, (0.0, [0, 1, 2])) and Co.stoer_wagner_min_cut(make(spark, [], 1)) is None
    with pytest.raises(ValueError):
        Co.stoer_wagner_min_cut(apart, "-payload")
    # each vertex of a ring leans on a neighbour; in a complete graph of equal edges nothing can be contracted below n forests
    ring = make(spark, [(i, (i + 1) % 9) for i in range(9)], 9)
    monkeypatch.setattr(cuts, "SMALL", 2)
    assert Co.stoer_wagner_min_cut(ring, "1.0 + src / 100.0D")[0] == pytest.approx(2.01)
    monkeypatch.setattr(cuts, "SMALL", 0)
    monkeypatch.setattr(cuts, "MOST", 5)
    with pytest.raises(ValueError):
        Co.stoer_wagner_min_cut(make(spark, [(a, b) for a in range(6) for b in range(a)], 6), "IF((src + dst) % 5 = 0, 1.2, 1.0)")


def relabelled(edges, n, seed):
    to = list(range(n))
    random.Random(seed).shuffle(to)
    return [(to[a], to[b]) for a, b in edges]


@pytest.mark.parametrize("directed", [False, True])
def test_isomorphism_by_refinement(spark, directed):
    rng = random.Random(5)
    ring = [(i, (i + 1) % 6) for i in range(6)]
    rays = [(0, 6), (0, 7), (0, 8), (3, 9), (3, 10), (3, 11)]
    mixed = [(rng.randrange(14), rng.randrange(14)) for _ in range(20)] + [(2, 2), (1, 4), (1, 4)]
    for edges, n in ((ring, 6), (ring + rays, 13), (mixed, 14)):
        g, h = make(spark, edges, n, directed), make(spark, relabelled(edges, n, 3), n, directed)
        to = {r.id: r.other for r in Pr.isomorphism(g, h).collect()}
        ends = (lambda e: e) if directed else (lambda e: tuple(sorted(e)))
        assert sorted(ends((to[a], to[b])) for a, b in edges) == sorted(map(ends, relabelled(edges, n, 3))) and sorted(to) == list(range(n))
    # colours cannot tell two triangles from a ring of six; an edge more or less is seen at once
    two = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]
    assert Pr.isomorphism(make(spark, ring, 6, directed), make(spark, two, 6, directed)) is None
    assert Pr.isomorphism(make(spark, ring, 6, directed), make(spark, ring + [(0, 3)], 6, directed)) is None
    assert Pr.isomorphism(make(spark, [], 0, directed), make(spark, [], 0, directed)).isEmpty()


def test_isomorphism_with_keys_and_beyond_the_bound(spark, monkeypatch):
    path, turned = make(spark, [(0, 1), (1, 2)], 3), make(spark, [(1, 2), (2, 0)], 3)
    assert Pr.isomorphism(path, turned, node_key="payload") is None
    names = turned.with_(turned.V.select("id", F.expr("CAST((id + 2) % 3 AS STRING)").alias("payload")))
    assert sorted(map(tuple, Pr.isomorphism(path, names, node_key="payload").collect())) == [(0, 1), (1, 2), (2, 0)]
    assert Pr.isomorphism(path, turned, edge_key="CAST(payload AS STRING)") is None or path.E.select("payload").exceptAll(turned.E.select("payload")).isEmpty()
    monkeypatch.setattr(local, "PART_ROWS", 0)
    triangle = make(spark, [(0, 1), (1, 2), (2, 0)], 3)
    assert Pr.is_isomorphic(path, turned) and not Pr.is_isomorphic(path, triangle)
    assert Pr.is_subgraph_isomorphic(triangle, path, induced=False) and not Pr.is_subgraph_isomorphic(triangle, path)


@pytest.mark.parametrize(("dim", "r", "scale"), [(1, 0.7, 5.0), (2, 1.5, 6.0), (2, 5.0, 40.0), (2, 0.3, 0.5), (3, 2.0, 8.0)])
def test_hyperbolic_bands_lose_no_pair(spark, monkeypatch, dim, r, scale):
    rng = random.Random(dim)
    monkeypatch.setattr(G, "SLICE", 2)
    pos = [[0.0] * dim, [0.0] * dim] + [[rng.gauss(0, 1) * scale ** rng.random() for _ in range(dim)] for _ in range(150)]

    def distance(x, y):
        lift = lambda p: math.sqrt(1 + sum(v * v for v in p))
        return math.acosh(max(1.0, lift(x) * lift(y) - sum(a * b for a, b in zip(x, y, strict=True))))

    want = [(i, j) for i in range(len(pos)) for j in range(i + 1, len(pos)) if distance(pos[i], pos[j]) < r]
    g = G.hyperbolic_random_graph(spark, pos, r)
    assert want and sorted((e.src, e.dst) for e in g.E.collect()) == want and g.num_nodes() == len(pos)
