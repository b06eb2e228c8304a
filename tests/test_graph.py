"""The graph value, generators, files, distances and the stateful operators."""

import math

import pytest
from pyspark.sql import functions as F

from weftgraph import errors as X
from weftgraph.functions import distances as Di
from weftgraph.graph import DiGraph, Graph, number
from weftgraph.operators import components as Co
from weftgraph.operators import products as Pr
from weftgraph.sources import files as Fi
from weftgraph.sources import generators as G
from weftgraph.streaming.incremental import StreamingComponents, TopologicalSorter
from tests.test_operators import make


def pairs(g):
    return sorted((r.src, r.dst) for r in g.E.collect())


def test_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = sorted((r.k, r.n) for r in number(df.withColumn("n", F.lit(0)), "n", ["k"]).collect())
    assert [n for _, n in got] == list(range(1000))


def test_lookups(spark):
    g = make(spark, [(0, 1, 5), (0, 1, 6), (1, 2, 7), (2, 2, 8)], 4, True)
    assert (g.num_nodes(), len(g), g.num_edges()) == (4, 4, 4) and g.has_parallel_edges() and g.multigraph
    assert g.get_edge_data(0, 1) == 6.0 and g.get_edge_data_by_index(2) == 7.0 and g.get_edge_endpoints_by_index(2) == (1, 2) and g[3] == "D"
    for call, err in ((lambda: g.get_edge_data(1, 0), X.NoEdgeBetweenNodes), (lambda: g.get_node_data(9), IndexError), (lambda: g.get_edge_data_by_index(9), IndexError), (lambda: g.get_all_edge_data(3, 0), X.NoEdgeBetweenNodes), (lambda: g.find_successor_node_by_edge(3, "true"), X.NoSuitableNeighbors)):
        with pytest.raises(err):
            call()
    assert g.get_all_edge_data(0, 1).count() == 2 and g.has_edge(0, 1) and not g.has_edge(1, 0) and g.has_node(3) and not g.has_node(4)
    assert [r.payload for r in g.nodes().collect()] == ["A", "B", "C", "D"] and [r.payload for r in g.edges().collect()] == [5, 6, 7, 8]
    assert g.find_node_by_weight("C") == 2 and g.find_node_by_weight("zz") is None
    assert [r.id for r in g.neighbors(0).collect()] == [1] and {r.id for r in g.neighbors_undirected(2).collect()} == {1, 2}
    assert [r.payload for r in g.successors(1).collect()] == ["C"] and [r.payload for r in g.predecessors(1).collect()] == ["A"]
    assert {r.id: r.payload for r in g.adj(1).collect()} == {0: 6.0, 2: 7.0} and {r.id for r in g.adj_direction(1, True).collect()} == {0}
    assert g.in_edges(1).count() == 2 and g.out_edges(1).count() == 1 and g.incident_edges(1).count() == 1 and g.incident_edges(1, True).count() == 3
    assert (g.in_degree(2), g.out_degree(2), g.degree(2)) == (2, 1, 3) and g.in_edge_indices(1).count() == 2 and g.out_edge_indices(0).count() == 2
    assert {r.id: r.degree for r in g.degrees().collect()} == {0: 2, 1: 3, 2: 3, 3: 0}
    assert g.find_successor_node_by_edge(0, "payload > 5") == "B" and g.find_predecessor_node_by_edge(2, lambda p: p == 7.0) == "B"
    assert {r.id for r in g.filter_nodes("payload < 'C'").collect()} == {0, 1} and {r.eid for r in g.filter_edges(lambda p: p > 6).collect()} == {2, 3}
    assert g.edge_indices_from_endpoints(0, 1).count() == 2 and g.weighted_edge_list().count() == g.edge_index_map().count() == 4
    u = make(spark, [(0, 1), (1, 1)])
    assert u.degree(1) == 3 and u.has_edge(1, 0) and u.neighbors(1).count() == 2


def test_changes(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 2)], directed=True)
    g2, i = g.add_node("Z")
    g3, e = g2.add_edge(i, 0, 9.0)
    assert (i, e) == (3, 2) and g3.has_edge(3, 0) and g.num_nodes() == 3
    with pytest.raises(IndexError):
        g.add_edge(0, 9, 1.0)
    assert pairs(g3.remove_node(0)) == [(1, 2)] and g3.without(0).num_nodes() == 3
    with pytest.raises(IndexError):
        g.without(9)
    assert pairs(g.remove_edge(0, 1)) == [(1, 2)] and g.remove_edge_from_index(1).num_edges() == 1
    with pytest.raises(X.NoEdgeBetweenNodes):
        g.remove_edges_from([(0, 1), (0, 1)])
    assert g.update_edge(0, 1, 4.0).get_edge_data(0, 1) == 4.0 and g.set_node_data(0, "Q")[0] == "Q"
    s = g.with_(multigraph=False)
    s2, ids = s.add_edges_from([(0, 1, 7.0), (2, 0, 3.0), (2, 0, 4.0)])
    assert ids == [0, 2, 2] and s2.get_edge_data(0, 1) == 7.0 and s2.get_edge_data(2, 0) == 4.0 and s2.num_edges() == 3
    with pytest.raises(X.DAGWouldCycle):
        g.with_(check_cycle=True).add_edge(2, 0, 1.0)
    assert g.extend_from_edge_list([(4, 5)]).num_nodes() == 6
    c, k = g.add_child(2, "kid", 1.0)
    assert c.has_edge(2, k) and g.add_parent(0, "up", 1.0)[0].has_edge(3, 0)
    same = g.set_node_data(2, "A")
    assert pairs(same.merge_nodes(2, 0)) == [(0, 1), (1, 0)] and pairs(g.merge_nodes(2, 0)) == pairs(g)
    assert pairs(g2.insert_node_on_in_edges(3, 1)) == [(0, 3), (1, 2), (3, 1)] and pairs(g2.insert_node_on_out_edges(3, 0)) == [(0, 3), (1, 2), (3, 1)]
    x = make(spark, [(0, 2, 1), (1, 2, 2), (2, 3, 1), (2, 4, 2)], directed=True)
    assert pairs(x.remove_node_retain_edges(2)) == [(0, 3), (0, 4), (1, 3), (1, 4)]
    assert pairs(x.remove_node_retain_edges(2, condition_="in_payload = out_payload")) == pairs(x.remove_node_retain_edges_by_id(2)) == [(0, 3), (1, 4)]
    assert pairs(g.make_symmetric()) == [(0, 1), (1, 0), (1, 2), (2, 1)] and g.make_symmetric().is_symmetric() and not g.is_symmetric()
    assert g.clear().num_nodes() == 0 and g.clear_edges().num_nodes() == 3 and pairs(g.copy().reverse()) == [(1, 0), (2, 1)]


def test_transforms(spark, tmp_path):
    g = make(spark, [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 0, 4), (1, 3, 5)], directed=True)
    s, m = g.subgraph_with_nodemap([1, 3, 2, 77])
    assert pairs(s) == [(0, 1), (0, 2), (1, 2)] and {r.new_id: r.old_id for r in m.collect()} == {0: 1, 1: 2, 2: 3}
    assert pairs(g.edge_subgraph([(0, 1), (9, 9)])) == [(0, 1)]
    c, m = g.compose(make(spark, [(0, 1, 8)], directed=True), {2: (0, 6.0)})
    assert pairs(c) == sorted([*pairs(g), (2, 4), (4, 5)]) and m.count() == 2
    sub, m = g.substitute_node_with_subgraph(1, make(spark, [(0, 1, 8)], directed=True), lambda s, t, p: 0 if t == 1 else 1)
    assert pairs(sub) == [(0, 4), (2, 3), (3, 0), (4, 5), (5, 2), (5, 3)]
    k, new = g.contract_nodes([1, 2], "M")
    assert new == 4 and pairs(k) == [(0, 4), (3, 0), (4, 3), (4, 3)]
    k, _ = g.contract_nodes([1, 2], "M", "sum(payload)")
    assert {r.payload for r in k.E.where("src = 4").collect()} == {8.0}
    chain = make(spark, [(0, 1), (1, 2)], directed=True)
    assert not chain.can_contract_without_cycle([0, 2]) and chain.can_contract_without_cycle([0, 1])
    with pytest.raises(X.DAGWouldCycle):
        chain.contract_nodes([0, 2], "M", check_cycle=True)
    two = make(spark, [(0, 1, 1), (1, 0, 2)], directed=True)
    assert two.to_undirected(False).num_edges() == 1 and two.to_undirected(False, "sum(payload)").get_edge_data(0, 1) == 3.0 and two.to_undirected().num_edges() == 2
    assert pairs(make(spark, [(0, 1), (1, 1)]).to_directed()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    g.save(f"{tmp_path}/g")
    assert pairs(Graph.load(spark, f"{tmp_path}/g")) == pairs(g) and DiGraph(g.V, g.E).directed


def test_deterministic_generators(spark):
    def size(g):
        return g.num_nodes(), g.num_edges()

    assert pairs(G.path_graph(spark, 4)) == [(0, 1), (1, 2), (2, 3)] and pairs(G.cycle_graph(spark, 3)) == [(0, 1), (1, 2), (2, 0)]
    assert size(G.directed_cycle_graph(spark, 4, bidirectional=True)) == (4, 8) and pairs(G.star_graph(spark, 4)) == [(0, 1), (0, 2), (0, 3)]
    assert pairs(G.directed_star_graph(spark, 3, inward=True)) == [(1, 0), (2, 0)]
    for n in (0, 1, 2, 7, 40):
        assert pairs(G.complete_graph(spark, n)) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert pairs(G.directed_mesh_graph(spark, 4)) == [(a, b) for a in range(4) for b in range(4) if a != b]
    assert size(G.grid_graph(spark, 3, 4)) == (12, 17) and size(G.directed_grid_graph(spark, 3, 4, bidirectional=True)) == (12, 34)
    assert [r.payload for r in G.grid_graph(spark, weights=["x", "y"]).nodes().collect()] == ["x", "y"]
    assert pairs(G.binomial_tree_graph(spark, 3)) == [(0, 1), (0, 2), (0, 4), (1, 3), (1, 5), (2, 6), (3, 7)]
    assert pairs(G.full_rary_tree(spark, 2, 6)) == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)]
    for d in (1, 3, 5):
        assert size(G.heavy_square_graph(spark, d)) == (3 * d * d - 2 * d, 2 * d * (d - 1) + 2 * d * (d - 1))
        assert size(G.heavy_hex_graph(spark, d)) == ((5 * d * d - 2 * d - 1) // 2, 2 * d * (d - 1) + (d - 1) * (d + 1))
        assert Co.is_connected(G.heavy_hex_graph(spark, d)) and Co.is_connected(G.heavy_square_graph(spark, d))
    with pytest.raises(ValueError):
        G.heavy_hex_graph(spark, 4)
    for r, c in ((1, 1), (2, 3), (3, 2)):
        h = G.hexagonal_lattice_graph(spark, r, c, with_positions=True)
        assert size(h) == ((2 * r + 2) * (c + 1) - 2, 3 * r * c + 2 * (r + c) - 1)
        at = {v.id: (v.payload.x, v.payload.y) for v in h.V.collect()}
        assert all(abs(math.dist(at[a], at[b]) - 1) < 1e-9 for a, b in pairs(h))
    assert size(G.hexagonal_lattice_graph(spark, 2, 4, periodic=True)) == (16, 24)
    assert size(G.lollipop_graph(spark, 4, 3)) == (7, 9) and size(G.barbell_graph(spark, 4, 1)) == (9, 14)
    assert size(G.generalized_petersen_graph(spark, 5, 2)) == (10, 15) and size(G.empty_graph(spark, 3)) == (3, 0)
    for n in (0, 1, 3):
        assert size(G.dorogovtsev_goltsev_mendes_graph(spark, n)) == ((3**n + 3) // 2, 3**n)
    k = G.karate_club_graph(spark)
    assert size(k) == (34, 78) and k.E.agg(F.sum("payload")).head()[0] == 231.0 and k.degree(33) == 17 and k.V.where("payload = 'Officer'").count() == 17


def test_random_generators(spark):
    a = G.undirected_gnp_random_graph(spark, 300, 0.05, 7)
    n = a.num_edges()
    assert pairs(a) == pairs(G.undirected_gnp_random_graph(spark, 300, 0.05, 7)) and abs(n - 0.05 * 300 * 299 / 2) < 5 * math.sqrt(300 * 299 / 2 * 0.05) and len(set(pairs(a))) == n
    assert abs(G.directed_gnp_random_graph(spark, 200, 0.1, 1).num_edges() - 3980) < 350 and G.undirected_gnp_random_graph(spark, 5, 1.0).num_edges() == 10
    with pytest.raises(ValueError):
        G.undirected_gnp_random_graph(spark, 5, 1.5)
    for m in (0, 10, 40, 99):
        g = G.undirected_gnm_random_graph(spark, 10, m, 3)
        assert g.num_edges() == len(set(pairs(g))) == min(m, 45)
    assert G.directed_gnm_random_graph(spark, 10, 33, 3).num_edges() == 33
    s = G.undirected_sbm_random_graph(spark, [5, 5], [[1.0, 0.0], [0.0, 1.0]], False, 1)
    assert s.num_edges() == 20 and G.directed_sbm_random_graph(spark, [3], [[1.0]], True, 1).num_edges() == 9
    assert G.undirected_random_bipartite_graph(spark, 3, 4, 1.0).num_edges() == 12
    r = G.random_regular_graph(spark, 10, 3, 5)
    assert {x.degree for x in r.degrees().collect()} == {3}
    pos = [(0.1, 0.1), (0.15, 0.1), (0.9, 0.9), (0.1, 0.2), (0.95, 0.9)]
    assert pairs(G.random_geometric_graph(spark, 5, 0.101, pos=pos)) == [(0, 1), (0, 3), (2, 4)]
    geo = G.random_geometric_graph(spark, 60, 0.3, 3, seed=2)
    at = {v.id: v.payload.pos for v in geo.V.collect()}
    assert pairs(geo) == [(i, j) for i in range(60) for j in range(i + 1, 60) if math.dist(at[i], at[j]) < 0.3]
    assert pairs(G.hyperbolic_random_graph(spark, [(0.0, 0.0), (0.5, 0.0), (9.0, 0.0)], 1.0)) == [(0, 1)]
    b = G.barabasi_albert_graph(spark, 30, 2, 1)
    assert (b.num_nodes(), b.num_edges()) == (30, 1 + 28 * 2)  # a star of 2 nodes, then 28 arrivals


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    r = df.select(Di.euclidean_distance(x, y), Di.lp_distance(x, y, 1), Di.maximum_distance(x, y), Di.hyperboloid_hyperbolic_distance(x, y), Di.angular_distance(F.array(F.lit(0.5)), F.array(F.lit(1.5))), Di.polar_hyperbolic_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))).head()
    assert [round(v, 9) for v in r] == [5.0, 7.0, 4.0, round(math.acosh(math.sqrt(10) * math.sqrt(17)), 9), 1.0, 1.0]


def test_files(spark, tmp_path):
    text = tmp_path / "e.txt"
    text.write_text("# c\na b 1 x\nb c\n\nc c # loop\n")
    g = Fi.read_edge_list(spark, str(text), comment="#", labels=True)
    assert pairs(g) == [(0, 1), (1, 2), (2, 2)] and [r.payload for r in g.edges().collect()] == ["1 x", None, None] and g[0] == "a"
    assert Fi.read_edge_list(spark, str(text), comment="#", labels=True, allow_self_loops=False).num_edges() == 2
    text.write_text("0,1\n1,3\n")
    assert Fi.read_edge_list(spark, str(text), deliminator=",", directed=True).num_nodes() == 4
    Fi.write_edge_list(g, f"{tmp_path}/out", ",", "payload")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["0,1,1 x", "1,2", "2,2"]
    mm = "%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 2\n2 1 5.0\n3 3 1\n"
    g = Fi.read_matrix_market(spark, mm)
    assert not g.directed and pairs(g) == [(1, 0), (2, 2)] and g.num_nodes() == 3
    assert pairs(Fi.read_matrix_market(spark, Fi.write_matrix_market(g))) == pairs(g)
    w = make(spark, [(0, 1, 2), (1, 2, 3)], directed=True)
    js = Fi.node_link_json(w, None, {"k": "v"}, "map('name', payload)", "map('w', cast(payload AS string))")
    back = Fi.parse_node_link_json(spark, js)
    assert pairs(back) == pairs(w) and back.directed and back.attrs == {"k": "v"} and back[1] == {"name": "B"} and back.get_edge_data(1, 2) == {"w": "3.0"}
    Fi.node_link_json(w, f"{tmp_path}/g.json")
    assert pairs(Fi.from_node_link_json_file(spark, f"{tmp_path}/g.json")) == pairs(w)
    for bad in ("{", '{"nodes": [{"id": 1}, {}], "links": []}'):
        with pytest.raises(X.JSONDeserializationError):
            Fi.parse_node_link_json(spark, bad)
    for name in ("g.graphml", "g.graphml.gz"):
        Fi.write_graphml(back, f"{tmp_path}/{name}")
        (h,) = Fi.read_graphml(spark, f"{tmp_path}/{name}")
        assert pairs(h) == pairs(w) and h[0] == {"name": "A", "id": "n0"} and h.get_edge_data(0, 1) == {"w": "2.0"} and h.directed
    dot = Fi.from_dot(spark, 'digraph "x" { node [shape=box]; a [label="q\\"t"]; a -> b -> c [w=1]; subgraph s { d } // c\n }')
    assert pairs(dot) == [(0, 1), (1, 2)] and dot[0]["label"] == 'q"t' and dot[3]["shape"] == "box" and dot.get_edge_data(1, 2) == {"w": "1"}
    with pytest.raises(ValueError):
        Fi.from_dot(spark, "graph { a -> b }")
    shown = Fi.to_dot(w, "map('label', payload)", None, {"rankdir": "LR"})
    again = Fi.from_dot(spark, shown)
    assert pairs(again) == pairs(w) and "rankdir=LR" in shown and 'label="A"' in shown


def test_online_sorter(spark):
    s = TopologicalSorter(make(spark, [(0, 2), (1, 2), (2, 3)], directed=True))
    assert s.is_active() and s.get_ready() == [0, 1] and s.get_ready() == []
    with pytest.raises(ValueError):
        s.done([3])
    s.done([0])
    assert s.get_ready() == []
    s.done(1)
    assert s.get_ready() == [2]
    s.done([2])
    assert s.get_ready() == [3]
    s.done([3])
    assert not s.is_active()
    with pytest.raises(X.DAGHasCycle):
        TopologicalSorter(make(spark, [(0, 1), (1, 0)], directed=True))


def test_streaming_components(spark, tmp_path):
    src = f"{tmp_path}/edges"
    spark.createDataFrame([(1, 2), (3, 4)], "src bigint, dst bigint").write.parquet(src)
    comp = StreamingComponents(spark, f"{tmp_path}/labels")

    def run():
        q = spark.readStream.schema("src bigint, dst bigint").parquet(src).writeStream.foreachBatch(comp.update).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.id: r.component for r in comp.labels().collect()}

    assert run() == {1: 1, 2: 1, 3: 3, 4: 3}
    spark.createDataFrame([(4, 2), (9, 8)], "src bigint, dst bigint").write.mode("append").parquet(src)
    assert run() == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_isomorphic_generators(spark):
    assert Pr.is_isomorphic(G.cycle_graph(spark, 5), G.generalized_petersen_graph(spark, 5, 1).subgraph(range(5)))
