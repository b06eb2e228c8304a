"""Registered queries of lookups, changes, further path, connectivity, acyclic, colouring and generator operators.

The graphs and their SQL are those of :mod:`weftgraph.plans.queries`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.errors import NoPathFound
from weftgraph.functions import distances as Di
from weftgraph.operators import coloring as Col
from weftgraph.operators import components as Co
from weftgraph.operators import dag as D
from weftgraph.operators import paths as P
from weftgraph.operators import products as Pr
from weftgraph.operators import traversal as T
from weftgraph.operators import trees as Tr
from weftgraph.plans.queries import CHAINS, GROWN, HOPS, RELAX, SUPPLY, TRADE, TREE, _found, _row, chains, grown, query, read, supply, trade, tree
from weftgraph.sources import files as Fi
from weftgraph.sources import generators as G


def _path(df, *keys):
    """Paths as text, so that both engines show them alike."""
    return df.select(*keys, F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


#: Vertices that a vertex reaches when direction is left aside; the graph's strong components; weighted shortest paths (sums of quantities, so ties do not occur).
AROUND = ", u AS (SELECT min(id) AS id FROM v UNION SELECT a.dst FROM u JOIN a ON a.src = u.id)"
STRONG = ", c AS (SELECT x.s AS id, min(x.t) AS c FROM dist x JOIN dist y ON x.s = y.t AND x.t = y.s GROUP BY x.s)"
ROUTES = RELAX + """, p AS (SELECT id AS s, id AS t, [id] AS path FROM v UNION ALL SELECT p.s, e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.t
JOIN wd x ON x.s = p.s AND x.t = p.t JOIN wd y ON y.s = p.s AND y.t = e.dst WHERE y.d = x.d + e.w AND e.dst <> p.s)"""
DEPTH = ", r AS (SELECT id, 0::BIGINT AS g FROM v WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, g + 1 FROM r JOIN e ON e.src = r.id)"


# --- lookups -----------------------------------------------------------------------------------


@query(TRADE + " SELECT (SELECT count(*) FROM v)::BIGINT AS nodes, (SELECT count(*) FROM e)::BIGINT AS edges")
def num_nodes(spark, d):
    g = trade(spark, d)
    return _row(spark, nodes=g.num_nodes(), edges=g.num_edges())


@query(SUPPLY + " SELECT count(*)::BIGINT AS edges FROM e")
def num_edges(spark, d):
    return _row(spark, edges=supply(spark, d).num_edges())


@query(TRADE + " SELECT count(*) > 0 AS found FROM e WHERE src = 0 AND dst = 7")
def has_edge(spark, d):
    return _row(spark, found=trade(spark, d).has_edge(0, 7))


@query(TREE + " SELECT count(*) > 0 AS found FROM v WHERE id = 1000000001")
def has_node(spark, d):
    return _row(spark, found=tree(spark, d).has_node(10**9 + 1))


@query(TRADE + " SELECT payload FROM v")
def nodes(spark, d):
    return trade(spark, d).nodes()


@query(TRADE + " SELECT w AS payload FROM e")
def edges(spark, d):
    return trade(spark, d).edges()


@query(TREE + " SELECT id FROM v")
def node_indices(spark, d):
    return tree(spark, d).node_indices()


@query(TREE + " SELECT dst AS eid FROM e")
def edge_indices(spark, d):
    return tree(spark, d).edge_indices()


@query(SUPPLY + " SELECT src, dst FROM e")
def edge_list(spark, d):
    return supply(spark, d).edge_list()


@query(TRADE + " SELECT src, dst, w AS payload FROM e")
def weighted_edge_list(spark, d):
    return trade(spark, d).weighted_edge_list()


@query(TRADE + " SELECT eid, src, dst, w AS payload FROM e")
def edge_index_map(spark, d):
    return trade(spark, d).edge_index_map()


@query(TRADE + " SELECT eid FROM e WHERE src = 0 AND dst = 3")
def edge_indices_from_endpoints(spark, d):
    return trade(spark, d).edge_indices_from_endpoints(0, 3)


@query(TRADE + " SELECT src, dst FROM e WHERE eid = 5")
def get_edge_endpoints_by_index(spark, d):
    return _found(spark, "src bigint, dst bigint", lambda: trade(spark, d).get_edge_endpoints_by_index(5), IndexError)


@query(TRADE + " SELECT w AS payload FROM e WHERE eid = 5")
def get_edge_data_by_index(spark, d):
    return _found(spark, "payload bigint", lambda: (trade(spark, d).get_edge_data_by_index(5),), IndexError)


@query(TRADE + " SELECT payload FROM v WHERE id = 7")
def get_node_data(spark, d):
    return _row(spark, payload=trade(spark, d).get_node_data(7))


@query("SELECT min(n_nationkey)::BIGINT AS id FROM nation WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 7)")
def find_node_by_weight(spark, d):
    g = trade(spark, d)
    return _row(spark, id=g.find_node_by_weight(g.get_node_data(7)))


@query(TRADE + " SELECT src, dst, w AS payload FROM e WHERE src = 2")
def out_edges(spark, d):
    return trade(spark, d).out_edges(2)


@query(TRADE + " SELECT src, dst, w AS payload FROM e WHERE dst = 2")
def in_edges(spark, d):
    return trade(spark, d).in_edges(2)


@query(TRADE + " SELECT eid FROM e WHERE src = 2 OR dst = 2")
def incident_edges(spark, d):
    return trade(spark, d).incident_edges(2, all_edges=True)


@query(TRADE + " SELECT eid, src, dst, w AS payload FROM e WHERE src = 2 OR dst = 2")
def incident_edge_index_map(spark, d):
    return trade(spark, d).incident_edge_index_map(2, all_edges=True)


@query(TRADE + " SELECT eid FROM e WHERE dst = 2")
def in_edge_indices(spark, d):
    return trade(spark, d).in_edge_indices(2)


@query(TRADE + " SELECT eid FROM e WHERE src = 2")
def out_edge_indices(spark, d):
    return trade(spark, d).out_edge_indices(2)


@query(TRADE + " SELECT dst AS id FROM e WHERE src = 2")
def successor_indices(spark, d):
    return trade(spark, d).successor_indices(2)


@query(TRADE + " SELECT src AS id FROM e WHERE dst = 2")
def predecessor_indices(spark, d):
    return trade(spark, d).predecessor_indices(2)


@query(TRADE + " SELECT id, payload FROM v WHERE id IN (SELECT dst FROM e WHERE src = 2)")
def successors(spark, d):
    return trade(spark, d).successors(2)


@query(TRADE + " SELECT id, payload FROM v WHERE id IN (SELECT src FROM e WHERE dst = 2)")
def predecessors(spark, d):
    return trade(spark, d).predecessors(2)


@query(TRADE + " SELECT DISTINCT dst AS id FROM a WHERE src = 2")
def neighbors_undirected(spark, d):
    return trade(spark, d).neighbors_undirected(2)


@query(TRADE + " SELECT src AS id, w AS payload FROM e WHERE dst = 2")
def adj_direction(spark, d):
    return trade(spark, d).adj_direction(2, True)


@query(TRADE + " SELECT x AS id, arg_max(w, eid) AS payload FROM (SELECT dst AS x, w, eid FROM e WHERE src = 2 UNION ALL SELECT src, w, eid FROM e WHERE dst = 2) GROUP BY x")
def adj(spark, d):
    return trade(spark, d).adj(2)


@query(TRADE + " SELECT count(*) FILTER (dst = 2)::BIGINT AS in_degree, count(*) FILTER (src = 2)::BIGINT AS out_degree, count(*) FILTER (src = 2 OR dst = 2)::BIGINT AS degree FROM e")
def degree(spark, d):
    g = trade(spark, d)
    return _row(spark, in_degree=g.in_degree(2), out_degree=g.out_degree(2), degree=g.degree(2))


@query(TRADE + " SELECT id, payload FROM v WHERE id IN (SELECT dst FROM e WHERE src = 2 AND w > 500)")
def find_successors_by_edge(spark, d):
    return trade(spark, d).find_successors_by_edge(2, "payload > 500")


@query(TRADE + " SELECT id, payload FROM v WHERE id IN (SELECT src FROM e WHERE dst = 2 AND w > 500)")
def find_predecessors_by_edge(spark, d):
    return trade(spark, d).find_predecessors_by_edge(2, "payload > 500")


@query("SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_name LIKE '%1%'")
def filter_nodes(spark, d):
    return trade(spark, d).filter_nodes("payload LIKE '%1%'")


@query(TRADE + " SELECT count(*) > 0 AS parallel FROM (SELECT 1 FROM e GROUP BY least(src, dst), greatest(src, dst) HAVING count(*) > 1)")
def has_parallel_edges(spark, d):
    return _row(spark, parallel=trade(spark, d, False).has_parallel_edges())


@query(TRADE + " SELECT count(*) = 0 AS symmetric FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.src = x.dst AND y.dst = x.src)")
def is_symmetric(spark, d):
    return _row(spark, symmetric=trade(spark, d).is_symmetric())


# --- changes -----------------------------------------------------------------------------------


@query(TRADE + " SELECT src, dst, w AS payload FROM e UNION ALL SELECT 3, 25, 77")
def add_child(spark, d):
    return trade(spark, d).add_child(3, "new", 77)[0].weighted_edge_list()


@query(TRADE + " SELECT src, dst, w AS payload FROM e UNION ALL SELECT 25, 3, 77")
def add_parent(spark, d):
    return trade(spark, d).add_parent(3, "new", 77)[0].weighted_edge_list()


@query(TRADE + " SELECT eid, src, dst, w AS payload FROM e UNION ALL SELECT (SELECT count(*) FROM e) + k, 0, 1 + k, 10 + k FROM range(2) t(k)")
def add_edges_from(spark, d):
    return trade(spark, d).add_edges_from([(0, 1, 10), (0, 2, 11)])[0].edge_index_map()


@query("SELECT n_nationkey::BIGINT AS id, n_name AS payload FROM nation UNION ALL VALUES (25, 'x'), (26, 'y')")
def add_nodes_from(spark, d):
    return trade(spark, d).add_nodes_from(["x", "y"])[0].V.select("id", "payload")


@query(TRADE + " SELECT src, dst FROM e WHERE src <> 4 AND dst <> 4")
def remove_node(spark, d):
    return trade(spark, d).remove_node(4).edge_list()


@query(TRADE + " SELECT eid FROM e WHERE eid <> 5")
def remove_edge_from_index(spark, d):
    return trade(spark, d).remove_edge_from_index(5).edge_indices()


@query(TRADE + " SELECT eid, CASE eid WHEN 5 THEN 1 ELSE w END AS payload FROM e")
def update_edge_by_index(spark, d):
    g = trade(spark, d)
    try:
        g = g.update_edge_by_index(5, 1)
    except IndexError:  # trade has fewer edges
        pass
    return g.edge_index_map().select("eid", "payload")


@query(TRADE + " SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def to_directed(spark, d):
    return trade(spark, d, False).to_directed().edge_list()


@query(TRADE + ", m AS (SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM v WHERE id % 3 = 0) SELECT new_id, old_id FROM m")
def subgraph_with_nodemap(spark, d):
    g = trade(spark, d)
    return g.subgraph_with_nodemap(g.V.where("id % 3 = 0"))[1].select("new_id", "old_id")


@query("SELECT 25::BIGINT AS nodes, 0::BIGINT AS edges")
def clear_edges(spark, d):
    g = trade(spark, d).clear_edges()
    return _row(spark, nodes=g.num_nodes(), edges=g.num_edges())


# --- traversal and paths -----------------------------------------------------------------------


@query(TRADE + HOPS + " SELECT t AS id, count(DISTINCT dst)::BIGINT AS n FROM dist JOIN e ON e.src = t WHERE s = 0 GROUP BY t")
def bfs_successors(spark, d):
    return T.bfs_successors(trade(spark, d), 0).select("id", F.size("children").cast("bigint").alias("n"))


@query(TREE + ", r AS (SELECT src, dst FROM e WHERE src = 1 UNION ALL SELECT e.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r")
def dfs_edges(spark, d):
    return T.dfs_edges(tree(spark, d), 1).select("src", "dst")


@query(TRADE + HOPS + ", p AS (SELECT [0::BIGINT] AS path, 0::BIGINT AS t UNION ALL SELECT list_append(path, e.dst), e.dst FROM p JOIN e ON p.t = e.src JOIN dist ON dist.s = 0 AND dist.t = e.dst AND dist.d = len(path)) SELECT t AS dst, array_to_string(path, '-') AS path FROM p")
def single_source_all_shortest_paths(spark, d):
    return _path(P.single_source_all_shortest_paths(trade(spark, d), 0), "dst")


@query(TRADE + ROUTES + " SELECT s AS src, t AS dst, array_to_string(path, '-') AS path FROM p WHERE s <> t")
def all_pairs_dijkstra_shortest_paths(spark, d):
    return _path(P.all_pairs_dijkstra_shortest_paths(trade(spark, d), "payload"), "src", "dst")


@query(TRADE + ROUTES + " SELECT s AS src, t AS dst, array_to_string(path, '-') AS path FROM p WHERE s <> t")
def all_pairs_bellman_ford_shortest_paths(spark, d):
    return _path(P.all_pairs_bellman_ford_shortest_paths(trade(spark, d), "payload"), "src", "dst")


@query(TRADE + ROUTES + " SELECT t AS dst, array_to_string(path, '-') AS path FROM p WHERE s = 0 AND t <> 0")
def bellman_ford_shortest_paths(spark, d):
    return _path(P.bellman_ford_shortest_paths(trade(spark, d), 0, None, "payload"), "dst").where("dst != 0")


@query(TRADE + ROUTES + " SELECT array_to_string(path, '-') AS path FROM p WHERE s = 0 AND t = 3")
def astar_shortest_path(spark, d):
    return _found(spark, "path string", lambda: ("-".join(map(str, P.astar_shortest_path(trade(spark, d), 0, F.col("id") == 3, "payload"))),), NoPathFound)


@query("SELECT false AS negative")
def negative_edge_cycle(spark, d):
    return _row(spark, negative=P.negative_edge_cycle(trade(spark, d), "payload"))


@query(TRADE + RELAX + " SELECT i.id AS src, j.id AS dst, coalesce(d, 'inf'::DOUBLE)::DOUBLE AS dist FROM v i CROSS JOIN v j LEFT JOIN wd ON s = i.id AND t = j.id")
def floyd_warshall_successor_and_distance(spark, d):
    return P.floyd_warshall_successor_and_distance(trade(spark, d), "payload").select("src", "dst", "dist")


@query(TRADE + ", p AS (SELECT src AS s, [src, dst] AS path, dst AS t FROM e UNION ALL SELECT s, list_append(path, e.dst), e.dst FROM p JOIN e ON p.t = e.src WHERE len(path) < 3 AND NOT list_contains(path, e.dst)) SELECT array_to_string(path, '-') AS path FROM p")
def all_pairs_all_simple_paths(spark, d):
    return _path(P.all_pairs_all_simple_paths(trade(spark, d), cutoff=3))


# --- connectivity ------------------------------------------------------------------------------


@query(TREE + " SELECT count(*)::BIGINT AS n FROM v WHERE id NOT IN (SELECT dst FROM e)")
def number_connected_components(spark, d):
    return _row(spark, n=Co.number_connected_components(tree(spark, d).with_(directed=False)))


@query(TRADE + AROUND + " SELECT (SELECT count(*) FROM u) = (SELECT count(*) FROM v) AS connected")
def is_connected(spark, d):
    return _row(spark, connected=Co.is_connected(trade(spark, d, False)))


@query(TREE + ", a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT 1::BIGINT AS id UNION SELECT a.dst FROM r JOIN a ON a.src = r.id) SELECT id FROM r")
def node_connected_component(spark, d):
    return Co.node_connected_component(tree(spark, d).with_(directed=False), 1)


@query(TRADE + HOPS + STRONG + " SELECT count(DISTINCT c)::BIGINT AS n FROM c")
def number_strongly_connected_components(spark, d):
    return _row(spark, n=Co.number_strongly_connected_components(trade(spark, d)))


@query(TRADE + HOPS + STRONG + " SELECT count(DISTINCT c) = 1 AS strong FROM c")
def is_strongly_connected(spark, d):
    return _row(spark, strong=Co.is_strongly_connected(trade(spark, d)))


@query(TRADE + HOPS + " SELECT count(*) = 0 AS semi FROM v i JOIN v j ON i.id < j.id WHERE NOT EXISTS (SELECT 1 FROM dist WHERE (s = i.id AND t = j.id) OR (s = j.id AND t = i.id))")
def is_semi_connected(spark, d):
    return _row(spark, semi=Co.is_semi_connected(trade(spark, d)))


@query(TREE + " SELECT least(src, dst) AS src, greatest(src, dst) AS dst, dst AS comp FROM e")
def biconnected_components(spark, d):
    return Co.biconnected_components(tree(spark, d)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "comp")


@query(TRADE + " SELECT DISTINCT least(src, dst) || '-' || greatest(src, dst) AS nodes FROM e")
def connected_subgraphs(spark, d):
    return Co.connected_subgraphs(trade(spark, d, False), 2).select(F.array_join(F.col("nodes").cast("array<string>"), "-").alias("nodes"))


@query("SELECT 0::BIGINT AS n")
def chain_decomposition(spark, d):
    return _row(spark, n=Co.chain_decomposition(tree(spark, d)).count())


@query("SELECT 0::BIGINT AS n")
def simple_cycles(spark, d):
    return _row(spark, n=Co.simple_cycles(chains(spark, d)).count())


# --- acyclic graphs ----------------------------------------------------------------------------


@query(CHAINS + " SELECT row_number() OVER (ORDER BY id::VARCHAR COLLATE C) - 1 AS pos, id FROM v")  # keys are text; that order has every turn after the one before
def lexicographical_topological_sort(spark, d):
    return D.lexicographical_topological_sort(chains(spark, d), F.col("id"))


@query(TREE + DEPTH + " SELECT g AS layer, id FROM r")
def layers(spark, d):
    g = tree(spark, d)
    return D.layers(g, [r.id for r in g.V.where("id < 100").collect()])  # the regions


@query(TREE + " SELECT src, dst FROM e")
def transitive_reduction(spark, d):
    g, ids = D.transitive_reduction(tree(spark, d))
    back = ids.select(F.col("new_id").alias("src"), F.col("old_id").alias("a")), ids.select(F.col("new_id").alias("dst"), F.col("old_id").alias("b"))
    return g.E.join(back[0], "src").join(back[1], "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query(TREE + ", r AS (SELECT 1::BIGINT AS id UNION SELECT e.dst FROM r JOIN e ON r.id = e.src) SELECT id, 0::BIGINT AS n FROM r")
def dominance_frontiers(spark, d):
    return D.dominance_frontiers(tree(spark, d), 1).select("id", F.size("frontier").cast("bigint").alias("n"))


@query(CHAINS + DEPTH + " SELECT max(g) + 1 AS n FROM r")
def dag_longest_path(spark, d):
    return _row(spark, n=len(D.dag_longest_path(chains(spark, d))))


@query(TREE + DEPTH + " SELECT max(g)::DOUBLE AS length FROM r")
def dag_weighted_longest_path_length(spark, d):
    return _row(spark, length=float(D.dag_weighted_longest_path_length(tree(spark, d), "payload")))


# --- trees, matching, colouring, products ------------------------------------------------------


@query(TREE + """, h AS (SELECT dst, src FROM e WHERE src >= 100 AND src IN (SELECT dst FROM e WHERE src = 1) UNION ALL SELECT dst, src FROM e WHERE src = 1), up AS (SELECT id, id AS top, 0 AS k FROM (SELECT dst AS id FROM h UNION SELECT src FROM h) UNION ALL SELECT up.id, h.src, k + 1 FROM up JOIN h ON h.dst = up.top)
SELECT x.id AS src, y.id AS dst, min(x.k + y.k)::DOUBLE AS dist FROM up x JOIN up y ON x.top = y.top AND x.id < y.id GROUP BY 1, 2""")
def metric_closure(spark, d):
    g = tree(spark, d).cached()  # the tree of region 1, for the whole is not connected
    V = T.descendants(g, 1).union(g.node_frame([1]))
    E = g.E.join(V.withColumnRenamed("id", "src"), "src", "left_semi").select("eid", "src", "dst", "payload")
    return Tr.metric_closure(g.with_(g.V.join(V, "id", "left_semi"), E, directed=False).cached()).select("src", "dst", "dist")


@query("SELECT true AS matching, true AS maximal")
def is_maximal_matching(spark, d):
    g = trade(spark, d, False)
    m = Col.max_weight_matching(g, max_cardinality=True)
    return _row(spark, matching=Col.is_matching(g, m), maximal=Col.is_maximal_matching(g, m))


def _proper(g, colors):
    """No two edges that share a vertex have one colour."""
    at = g.E.join(colors, "eid")
    ends = at.select(F.col("src").alias("id"), "color").union(at.select("dst", "color"))
    return at.count() == g.num_edges() and ends.groupBy("id", "color").count().where("count > 1").isEmpty()


@query("SELECT true AS proper")
def greedy_edge_color(spark, d):
    g = trade(spark, d, False)
    return _row(spark, proper=_proper(g, Col.greedy_edge_color(g)))


@query(TREE + ", n AS (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) SELECT true AS proper, max(c)::BIGINT AS colors FROM (SELECT count(*) AS c FROM n GROUP BY x)")
def bipartite_edge_color(spark, d):
    g = tree(spark, d).with_(directed=False)
    got = Col.bipartite_edge_color(g)
    return _row(spark, proper=_proper(g, got), colors=got.select("color").distinct().count())


@query("SELECT true AS isomorphic")
def is_isomorphic(spark, d):
    g = trade(spark, d)
    return _row(spark, isomorphic=Pr.is_isomorphic(g, g.subgraph(g.V)))


@query(TRADE + " SELECT count(*) > 0 AS found FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src <> y.dst")
def is_subgraph_isomorphic(spark, d):
    return _row(spark, found=Pr.is_subgraph_isomorphic(trade(spark, d), G.directed_cycle_graph(spark, 3), induced=False))


# --- generators, files, distances --------------------------------------------------------------


def _sizes(spark, g):
    return _row(spark, nodes=g.num_nodes(), edges=g.num_edges())


@query(GROWN + " SELECT i AS src, j AS dst FROM a JOIN b ON i <> j")
def directed_complete_graph(spark, d):
    return G.directed_complete_graph(spark, grown(spark, d)).edge_list()


@query(GROWN + " SELECT i AS src, i + 1 AS dst FROM a, n WHERE i + 1 < n UNION ALL SELECT i + 1, i FROM a, n WHERE i + 1 < n")
def directed_path_graph(spark, d):
    return G.directed_path_graph(spark, grown(spark, d), bidirectional=True).edge_list()


@query(GROWN + " SELECT i AS src, (i + 1) % n AS dst FROM a, n")
def directed_cycle_graph(spark, d):
    return G.directed_cycle_graph(spark, grown(spark, d)).edge_list()


@query(GROWN + " SELECT i AS src, 0::BIGINT AS dst FROM a WHERE i > 0")
def directed_star_graph(spark, d):
    return G.directed_star_graph(spark, grown(spark, d), inward=True).edge_list()


@query(GROWN + " SELECT n AS nodes, 0::BIGINT AS edges FROM n")
def empty_graph(spark, d):
    return _sizes(spark, G.empty_graph(spark, grown(spark, d)))


@query(GROWN + " SELECT i AS src, j AS dst FROM a JOIN b ON i < j UNION ALL SELECT n - 1 + k, n + k FROM n, (SELECT unnest(range(25)) AS k)")
def lollipop_graph(spark, d):
    return G.lollipop_graph(spark, grown(spark, d), 25).edge_list().select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


@query(GROWN + " SELECT 2 * n + 3 AS nodes, n * (n - 1) + 3 + 1 AS edges FROM n")
def barbell_graph(spark, d):
    return _sizes(spark, G.barbell_graph(spark, grown(spark, d), 3))


@query(GROWN + ", k AS (SELECT 2 * (n // 20) + 3 AS k FROM n) SELECT 3 * k * k - 2 * k AS nodes, 4 * k * (k - 1) AS edges FROM k")
def heavy_square_graph(spark, d):
    return _sizes(spark, G.heavy_square_graph(spark, 2 * (grown(spark, d) // 20) + 3))


@query(GROWN + ", k AS (SELECT 2 * (n // 20) + 3 AS k FROM n) SELECT (5 * k * k - 2 * k - 1) // 2 AS nodes FROM k")
def heavy_hex_graph(spark, d):
    return _row(spark, nodes=G.heavy_hex_graph(spark, 2 * (grown(spark, d) // 20) + 3).num_nodes())


@query(GROWN + " SELECT 2 * (4 + 1) * (n + 1) - 2 AS nodes, 3 * 4 * n + 2 * (4 + n) - 1 AS edges FROM n")
def hexagonal_lattice_graph(spark, d):
    return _sizes(spark, G.hexagonal_lattice_graph(spark, 4, grown(spark, d)))


@query(GROWN + " SELECT (3 ** k + 3)::BIGINT // 2 AS nodes, (3 ** k)::BIGINT AS edges FROM (SELECT floor(log2(n))::INT + 1 AS k FROM n)")
def dorogovtsev_goltsev_mendes_graph(spark, d):
    return _sizes(spark, G.dorogovtsev_goltsev_mendes_graph(spark, grown(spark, d).bit_length()))


@query(GROWN + " SELECT n AS nodes, 3 * n AS edges FROM n")
def undirected_gnm_random_graph(spark, d):
    n = grown(spark, d)
    return _sizes(spark, G.undirected_gnm_random_graph(spark, n, 3 * n, seed=3))


@query(GROWN + " SELECT n AS nodes, 3 * n AS edges FROM n")
def directed_gnm_random_graph(spark, d):
    n = grown(spark, d)
    return _sizes(spark, G.directed_gnm_random_graph(spark, n, 3 * n, seed=3))


@query(GROWN + " SELECT i AS id, 4::BIGINT AS degree FROM a")
def random_regular_graph(spark, d):
    return G.random_regular_graph(spark, grown(spark, d), 4, seed=3).degrees().select("id", "degree")


@query(GROWN + " SELECT n AS nodes, (n - 3) * 3 + 2 AS edges FROM n")
def barabasi_albert_graph(spark, d):
    return _sizes(spark, G.barabasi_albert_graph(spark, grown(spark, d), 3, seed=3))


@query("SELECT round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dist, a.vec_id AS id FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def euclidean_distance(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    one = rows.where("vec_id = 0").select(F.col("x").alias("y"))  # one row
    return rows.join(F.broadcast(one)).select(F.col("vec_id").alias("id"), F.round(Di.euclidean_distance(F.col("x"), F.col("y")), 4).alias("dist"))
