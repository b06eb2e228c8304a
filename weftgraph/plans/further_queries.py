"""Registered queries of files, changes, searches, layouts, random graphs and the remaining operators.

The graphs and their SQL are those of :mod:`weftgraph.plans.queries`; small fixed graphs stand where
the result on the tables is not unique (orders, colourings, layouts), and properties where only those are.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from weftgraph.errors import NoSuitableNeighbors
from weftgraph.functions import distances as Di
from weftgraph.graph import DAG, Graph
from weftgraph.operators import centrality as C
from weftgraph.operators import coloring as Col
from weftgraph.operators import components as Co
from weftgraph.operators import dag as D
from weftgraph.operators import layouts as L
from weftgraph.operators import paths as P
from weftgraph.operators import products as Pr
from weftgraph.operators import traversal as T
from weftgraph.operators import trees as Tr
from weftgraph.operators.visitors import BFSVisitor, DFSVisitor, DijkstraVisitor, StopSearch
from weftgraph.plans.fixpoint import spot
from weftgraph.plans.more_queries import AROUND, ROUTES, _path, _proper, _sizes
from weftgraph.plans.queries import CHAINS, GROWN, HOPS, RELAX, SIGMA, SUPPLY, TRADE, TREE, _found, _row, chains, grown, query, read, supply, trade, tree
from weftgraph.sources import files as Fi
from weftgraph.sources import generators as G
from weftgraph.streaming.incremental import TopologicalSorter


def small(spark, edges, n=None, directed=True, names=None, kind="double"):
    """A fixed graph of edges (src, dst[, payload])."""
    n = max(max(e[:2]) for e in edges) + 1 if n is None else n
    V = spark.createDataFrame([(i, names[i] if names else f"v{i}") for i in range(n)], "id bigint, payload string")
    rows = [(i, e[0], e[1], e[2] if len(e) > 2 else 1.0) for i, e in enumerate(edges)]
    return Graph(V, spark.createDataFrame(rows, f"eid bigint, src bigint, dst bigint, payload {kind}"), directed)


def strings(spark, column, values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def ends(g):
    return g.E.select("src", "dst", "payload")


# --- files -------------------------------------------------------------------------------------


def _typed(spark, d):
    """trade with payloads of named fields."""
    g = trade(spark, d)
    return g.with_(g.V.select("id", F.struct(F.col("payload").alias("name")).alias("payload")), g.E.select("eid", "src", "dst", F.struct(F.col("payload").alias("w")).alias("payload")))


@query(TRADE + " SELECT id, payload AS name FROM v")
def write_graphml(spark, d):
    at = f"{spot(spark)}/g.graphml"
    Fi.write_graphml(_typed(spark, d), at)
    return Fi.read_graphml(spark, at)[0].V.select("id", F.col("payload")["name"].alias("name"))


@query(TRADE + " SELECT src, dst, w FROM e")
def read_graphml(spark, d):
    at = f"{spot(spark)}/g.graphml.gz"
    keys = [Fi.GraphMLKey("k0", Fi.GraphMLDomain.Edge, "w", Fi.GraphMLType.Long)]
    Fi.write_graphml(_typed(spark, d), at, keys, compression="gzip")
    return Fi.read_graphml(spark, at, compression="gzip")[0].E.select("src", "dst", F.col("payload")["w"].cast("bigint").alias("w"))


@query(TRADE + " SELECT id, payload AS name FROM v")
def node_link_json(spark, d):
    text = Fi.node_link_json(trade(spark, d), node_attrs="map('name', payload)")
    return Fi.parse_node_link_json(spark, text).V.select("id", F.col("payload")["name"].alias("name"))


@query(TRADE + " SELECT eid, src, dst, w FROM e")
def parse_node_link_json(spark, d):
    text = Fi.node_link_json(trade(spark, d), edge_attrs="map('w', cast(payload AS string))")
    return Fi.parse_node_link_json(spark, text, edge_attrs="payload['w']").E.select("eid", "src", "dst", F.col("payload").cast("bigint").alias("w"))


@query(TRADE + " SELECT eid, src, dst FROM e")
def from_node_link_json_file(spark, d):
    at = f"{spot(spark)}/g.json"
    Fi.node_link_json(trade(spark, d), at)
    return Fi.from_node_link_json_file(spark, at).E.select("eid", "src", "dst")


@query(TRADE + " SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, w::VARCHAR AS w FROM e")
def from_dot(spark, d):
    lines = [f'{r.src} -> "{r.dst}" [w={r.payload}];' for r in trade(spark, d).E.collect()]
    g = Fi.from_dot(spark, "digraph { edge [w=1]; " + " ".join(lines) + " /* done */ }")
    name = g.V.select("id", F.col("payload")["label"].alias("n"))
    e = g.E.join(name.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(name.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("payload")["w"].alias("w"))


@query(TRADE + " SELECT id || ' [label=\"' || payload || '\"] ;' AS line FROM v UNION ALL SELECT src || ' -> ' || dst || ' ;' FROM e UNION ALL VALUES ('digraph {'), ('}')")
def to_dot(spark, d):
    return strings(spark, "line", Fi.to_dot(trade(spark, d), "map('label', payload)").splitlines())


@query(TRADE + " SELECT src, dst FROM e")
def read_matrix_market(spark, d):
    rows = trade(spark, d).E.collect()
    lines = [f"{r.src + 1} {r.dst + 1} {r.payload}" for r in rows]
    return Fi.read_matrix_market(spark, "%%MatrixMarket matrix coordinate real general\n% a remark\n" + f"25 25 {len(rows)}\n" + "\n".join(lines) + "\n").edge_list()


@query(TRADE + " SELECT src, dst FROM e")
def read_matrix_market_file(spark, d):
    at = f"{spot(spark)}/g.mtx"
    Fi.write_matrix_market(trade(spark, d), at, "payload")
    return Fi.read_matrix_market_file(spark, at).edge_list()


@query(TRADE + " SELECT (src + 1) || ' ' || (dst + 1) || ' ' || w || '.0' AS line FROM e UNION ALL SELECT '%%MatrixMarket matrix coordinate real general' UNION ALL SELECT '25 25 ' || count(*) FROM e")
def write_matrix_market(spark, d):
    return strings(spark, "line", Fi.write_matrix_market(trade(spark, d), weight="payload").splitlines())


@query(SUPPLY + " SELECT src || ';' || dst AS line FROM e")
def write_edge_list(spark, d):
    at = f"{spot(spark)}/edges"
    Fi.write_edge_list(supply(spark, d), at, ";")
    return spark.read.text(at).select(F.col("value").alias("line"))


@query(TRADE + " SELECT src, dst, w::VARCHAR AS payload FROM e")
def read_edge_list(spark, d):
    at = f"{spot(spark)}/edges"
    Fi.write_edge_list(trade(spark, d), at, weight="payload")
    return ends(Fi.read_edge_list(spark, at, directed=True))


class _Views:
    """What the converter needs of a graph with networkx's views."""

    def __init__(self, names, edges):
        self.nodes, self._edges = {n: {} for n in names}, edges

    def edges(self, data):
        return self._edges

    def is_directed(self):
        return True

    def is_multigraph(self):
        return False


@query(TRADE + " SELECT src, dst, w::VARCHAR AS w FROM e")
def networkx_converter(spark, d):
    g = trade(spark, d)
    views = _Views([r.id for r in g.V.orderBy("id").collect()], [(r.src, r.dst, {"w": r.payload}) for r in g.E.collect()])
    return Fi.networkx_converter(spark, views, True).E.select("src", "dst", F.col("payload")["w"].alias("w"))


@query(TRADE + " SELECT src, dst, w::DOUBLE AS payload FROM e")
def from_adjacency_matrix(spark, d):
    return ends(Pr.from_adjacency_matrix(spark, Pr.to_numpy(Pr.adjacency_matrix(trade(spark, d), "payload"), 25)))


@query(TRADE + " SELECT src, dst, w::DOUBLE AS re, -w::DOUBLE AS im FROM e")
def from_complex_adjacency_matrix(spark, d):
    m = [[0j] * 25 for _ in range(25)]
    for r in trade(spark, d).E.collect():
        m[r.src][r.dst] = complex(r.payload, -r.payload)
    return Pr.from_complex_adjacency_matrix(spark, m).E.select("src", "dst", "payload.*")


# --- searches and paths ------------------------------------------------------------------------

BELOW = ", r AS (SELECT 1::BIGINT AS id UNION SELECT e.dst FROM r JOIN e ON r.id = e.src)"


def _events(df):
    return df.groupBy("event").agg(F.count("*").alias("n"))


@query(TREE + BELOW + " SELECT event, (SELECT count(*) FROM r) - less AS n FROM (VALUES ('discover_vertex', 0), ('tree_edge', 1), ('finish_vertex', 0)) t(event, less)")
def bfs_search(spark, d):
    return _events(T.bfs_search(tree(spark, d), [1], BFSVisitor()))


@query(TREE + BELOW + " SELECT event, (SELECT count(*) FROM r) - less AS n FROM (VALUES ('discover_vertex', 0), ('tree_edge', 1), ('finish_vertex', 0)) t(event, less)")
def dfs_search(spark, d):
    return _events(T.dfs_search(tree(spark, d), [1], DFSVisitor()))


@query(TRADE + RELAX + " SELECT t AS id, d::DOUBLE AS w FROM wd WHERE s = 0")
def dijkstra_search(spark, d):
    return T.dijkstra_search(trade(spark, d), [0], "payload", DijkstraVisitor()).where("event = 'discover_vertex'").select("id", "w")


class _Upto(DijkstraVisitor):
    def finish_vertex(self, node, *at):
        if node == 7:
            raise StopSearch


@query(TRADE + RELAX + " SELECT t AS id FROM wd WHERE s = 0 AND d <= coalesce((SELECT d FROM wd WHERE s = 0 AND t = 7), 1000000000)")
def dijkstra_visitor(spark, d):
    return T.dijkstra_search(trade(spark, d), [0], "payload", _Upto()).where("event = 'discover_vertex'").select("id")


class _UptoB(BFSVisitor):
    def discover_vertex(self, node, *at):
        if node >= 10**9:
            raise StopSearch


class _UptoD(DFSVisitor):
    def discover_vertex(self, node, *at):
        if node >= 10**9:
            raise StopSearch


@query(TREE + " SELECT 1::BIGINT AS id UNION ALL SELECT dst FROM e WHERE src = 1 UNION ALL (SELECT dst FROM e WHERE src IN (SELECT dst FROM e WHERE src = 1) ORDER BY src, dst LIMIT 1)")
def bfs_visitor(spark, d):
    return T.bfs_search(tree(spark, d), [1], _UptoB()).where("event = 'discover_vertex'").select("id")


@query(TREE + " SELECT 1::BIGINT AS id UNION ALL (SELECT unnest([src, dst]) FROM (SELECT src, dst FROM e WHERE src IN (SELECT dst FROM e WHERE src = 1) ORDER BY src, dst LIMIT 1))")
def dfs_visitor(spark, d):
    return T.dfs_search(tree(spark, d), [1], _UptoD()).where("event = 'discover_vertex'").select("id")


@query(TREE + ", r AS (SELECT 1000000001::BIGINT AS id UNION SELECT e.src FROM r JOIN e ON r.id = e.dst) SELECT DISTINCT r.id, 1::BIGINT AS n FROM r JOIN e ON e.dst = r.id")
def bfs_predecessors(spark, d):
    return T.bfs_predecessors(tree(spark, d), 10**9 + 1).select("id", F.size("parents").cast("bigint").alias("n"))


@query(TREE + " SELECT count(DISTINCT a.src)::BIGINT AS starts, true AS along FROM e a WHERE a.src = 1")
def generate_random_path(spark, d):
    g = tree(spark, d)
    path = T.generate_random_path(g, 1, 2, 3)
    steps = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "src bigint, dst bigint")
    return _row(spark, starts=int(path[0] == 1), along=len(path) == 3 and steps.join(g.E, ["src", "dst"], "left_anti").isEmpty())


@query(TRADE + ROUTES + " SELECT t AS dst, array_to_string(path, '-') AS path FROM p WHERE s = 0 AND t <> 0")
def dijkstra_shortest_paths(spark, d):
    return _path(P.dijkstra_shortest_paths(trade(spark, d), 0, None, "payload"), "dst").where("dst != 0")


@query(TRADE + HOPS + ", p AS (SELECT [0::BIGINT] AS path, 0::BIGINT AS t UNION ALL SELECT list_append(path, e.dst), e.dst FROM p JOIN e ON p.t = e.src JOIN dist ON dist.s = 0 AND dist.t = e.dst AND dist.d = len(path)) SELECT array_to_string(path, '-') AS path FROM p WHERE t = 7")
def all_shortest_paths(spark, d):
    return _path(P.all_shortest_paths(trade(spark, d), 0, 7))


#: A directed grid of 3 x 4 with weights of the ends.
GRID = """WITH RECURSIVE c AS (SELECT i * 4 + j AS src, i * 4 + j + 1 AS dst FROM range(3) a(i), range(3) b(j) UNION ALL SELECT i * 4 + j, (i + 1) * 4 + j FROM range(2) a(i), range(4) b(j)),
e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, (src * 7 + dst * dst) % 23 + 1 AS w FROM c)"""


def grid(spark, directed=True):
    g = G.directed_grid_graph(spark, 3, 4) if directed else G.grid_graph(spark, 3, 4)
    return g.with_(E=g.E.withColumn("payload", ((F.col("src") * 7 + F.col("dst") * F.col("dst")) % 23 + 1).cast("double")))


@query(TRADE + ", up AS (SELECT * FROM e WHERE src < dst), p AS (SELECT 0::BIGINT AS t, 0::BIGINT AS d UNION ALL SELECT up.dst, d + up.w FROM p JOIN up ON up.src = p.t) SELECT t AS id, d::DOUBLE AS dist FROM (SELECT t, d, row_number() OVER (PARTITION BY t ORDER BY d) AS k FROM p) WHERE k = 3")
def k_shortest_path_lengths(spark, d):
    return P.k_shortest_path_lengths(upward(spark, d), 0, 3, "payload")


@query(TRADE + HOPS + " SELECT count(*) > 0 AS closed, true AS negative FROM dist JOIN e ON dist.s = e.dst AND dist.t = e.src")
def find_negative_cycle(spark, d):
    """A graph without a cycle has none of another sign either."""
    g = trade(spark, d)
    try:
        round_ = P.find_negative_cycle(g, "-payload")
    except ValueError:
        return _row(spark, closed=False, negative=True)
    steps = spark.createDataFrame(list(zip(round_, round_[1:], strict=False)), "src bigint, dst bigint")
    at = steps.join(g.E, ["src", "dst"])
    return _row(spark, closed=round_[0] == round_[-1] and at.count() == len(round_) - 1, negative=at.agg(F.sum(-F.col("payload"))).head()[0] < 0)


@query(TRADE + ", up AS (SELECT * FROM e WHERE src < dst), p AS (SELECT id AS t, 1::BIGINT AS n FROM v UNION ALL SELECT up.dst, n + 1 FROM p JOIN up ON up.src = p.t) SELECT max(n) AS length FROM p")
def longest_simple_path(spark, d):
    return _row(spark, length=len(P.longest_simple_path(upward(spark, d))))


def _along(spark, d):
    """Points on a line, one per embedding: the farther on, the greater the sum of the lengths so far."""
    rows = read(spark, d, "embeddings").select("vec_id", F.expr("0.001D + 0.01D * abs(embedding[0])").alias("step")).orderBy("vec_id").toPandas()
    return {i: [at, 0.0] for i, at in zip(rows["vec_id"].tolist(), rows["step"].cumsum().tolist(), strict=True)}


@query("SELECT string_agg(vec_id::VARCHAR, '-' ORDER BY vec_id) AS path, count(*) AS steps FROM embeddings")
def hyperbolic_greedy_routing(spark, d):
    at = _along(spark, d)
    path = P.hyperbolic_greedy_routing(G.path_graph(spark, len(at)), at, 0, len(at) - 1)
    return _row(spark, path="-".join(map(str, path)), steps=len(path))


@query("SELECT (count(*) / count(*))::DOUBLE AS rate, count(*) AS nodes FROM supplier")
def hyperbolic_greedy_success_rate(spark, d):
    n = grown(spark, d)
    at = {i: x for i, x in _along(spark, d).items() if i < n}
    return _row(spark, rate=float(P.hyperbolic_greedy_success_rate(G.path_graph(spark, len(at)), at)), nodes=n)


@query(TRADE + RELAX + " SELECT i.id AS src, j.id AS dst, coalesce(d, 'inf'::DOUBLE)::DOUBLE AS dist FROM v i CROSS JOIN v j LEFT JOIN wd ON s = i.id AND t = j.id")
def floyd_warshall_numpy(spark, d):
    m = P.floyd_warshall_numpy(trade(spark, d), "payload")
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(m) for j, x in enumerate(row)], "src bigint, dst bigint, dist double")


# --- centrality --------------------------------------------------------------------------------


@query(TRADE + """, n AS (SELECT src AS u, dst AS t, 1 / w::DOUBLE AS w FROM e), r2 AS (SELECT 0 AS k, id AS s, id AS t, 0::DOUBLE AS d FROM v UNION ALL SELECT k + 1, s, t, min(d) FROM (SELECT k, s, t, d FROM r2 UNION ALL SELECT k, s, n.t, d + n.w FROM r2 JOIN n ON r2.t = n.u) WHERE k < 25 GROUP BY k, s, t)
SELECT t AS id, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / 24 ELSE 0 END, 4) AS score FROM r2 WHERE k = 25 GROUP BY t""")
def newman_weighted_closeness_centrality(spark, d):
    return C.newman_weighted_closeness_centrality(trade(spark, d), "payload").select("id", F.round("score", 4).alias("score"))


@query(TRADE + SIGMA + """, cl AS (SELECT 0 AS k, id AS s, id AS t, 1::DOUBLE AS c FROM v WHERE id NOT IN (1, 2) UNION ALL SELECT k + 1, cl.s, e.dst, sum(c) FROM cl JOIN e ON cl.t = e.src JOIN dist ON dist.s = cl.s AND dist.t = e.dst AND dist.d = k + 1 WHERE k < 25 AND e.dst NOT IN (1, 2) GROUP BY k, cl.s, e.dst)
SELECT round(coalesce(sum(1 - coalesce(cl.c, 0) / sg.c), 0) / (23 * 22), 6) AS score FROM sg LEFT JOIN cl ON cl.s = sg.s AND cl.t = sg.t WHERE sg.s <> sg.t AND sg.s NOT IN (1, 2) AND sg.t NOT IN (1, 2)""")
def group_betweenness_centrality(spark, d):
    return _row(spark, score=round(C.group_betweenness_centrality(trade(spark, d), [1, 2]), 6))


@query(TRADE + """, x AS (SELECT 0 AS k, id, 1::DOUBLE AS x FROM v UNION ALL SELECT k + 1, id, y / sqrt(sum(y * y) OVER ()) FROM (SELECT k, id, sum(x) AS y FROM (SELECT k, id, x FROM x WHERE k < 250 UNION ALL SELECT x.k, a.dst, x.x FROM x JOIN a ON a.src = x.id WHERE x.k < 250) GROUP BY k, id))
SELECT id, round(x, 4) AS score FROM x WHERE k = 250""")
def eigenvector_centrality(spark, d):
    return C.eigenvector_centrality(trade(spark, d, False), max_iter=500, tol=1e-8).select("id", F.round("score", 4).alias("score"))


@query(SUPPLY + """, a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
r AS (SELECT 0 AS k, src AS id, count(*) AS c FROM a GROUP BY src UNION ALL SELECT k + 1, id, max(least(c, n)) FROM (SELECT r.k, a.src AS id, r.c, row_number() OVER (PARTITION BY a.src ORDER BY r.c DESC) AS n FROM r JOIN a ON a.dst = r.id WHERE r.k < 80) GROUP BY k, id)
SELECT id, c::BIGINT AS core FROM r WHERE k = 80""")
def core_number(spark, d):
    return C.core_number(supply(spark, d))


# --- connectivity, acyclic graphs, trees -------------------------------------------------------


@query(TREE + ", r AS (SELECT id, id AS c FROM v WHERE id < 100 UNION ALL SELECT e.dst, r.c FROM r JOIN e ON e.src = r.id) SELECT id, c AS component FROM r")
def weakly_connected_components(spark, d):
    return Co.weakly_connected_components(tree(spark, d))


@query(TRADE + AROUND + " SELECT (SELECT count(*) FROM u) = (SELECT count(*) FROM v) AS connected")
def is_weakly_connected(spark, d):
    return _row(spark, connected=Co.is_weakly_connected(trade(spark, d)))


@query(TRADE + ", q AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), z AS (SELECT id, id AS c FROM v UNION SELECT a.dst, z.c FROM z JOIN a ON a.src = z.id) SELECT (SELECT count(*) FROM q) - (SELECT count(*) FROM v) + (SELECT count(*) FROM (SELECT id FROM z GROUP BY id HAVING min(c) = id)) AS n, true AS simple")
def cycle_basis(spark, d):
    got = Co.cycle_basis(simple_trade(spark, d))
    return _row(spark, n=got.count(), simple=got.where("size(array_distinct(cycle)) < size(cycle)").isEmpty())


@query(TRADE + HOPS + " SELECT count(*) > 0 AS found, true AS closed FROM dist JOIN e ON dist.s = e.dst AND dist.t = e.src")
def digraph_find_cycle(spark, d):
    g = trade(spark, d)
    got = Co.digraph_find_cycle(g).select("src", "dst").cache()
    ends_ = got.select(F.col("src").alias("x"), F.lit(1).alias("n")).union(got.select("dst", F.lit(-1))).groupBy("x").agg(F.sum("n").alias("n"))
    return _row(spark, found=not got.isEmpty(), closed=ends_.where("n != 0").isEmpty() and got.join(g.E, ["src", "dst"], "left_anti").isEmpty())


@query(TRADE + ", q AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), m AS (SELECT dst AS id FROM a WHERE src = 0 AND dst <> 0 GROUP BY dst), w AS (SELECT x.id AS a, y.id AS b FROM m x JOIN m y ON x.id < y.id) SELECT a, b FROM (SELECT a, b FROM q EXCEPT SELECT a, b FROM w) UNION ALL SELECT a, b FROM (SELECT a, b FROM w EXCEPT SELECT a, b FROM q)")
def local_complement(spark, d):
    return Co.local_complement(simple_trade(spark, d), 0).E.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


@query(TRADE + ", up AS (SELECT * FROM e WHERE src < dst), p AS (SELECT id AS v, 0::BIGINT AS u FROM v UNION SELECT up.dst, u + up.w FROM p JOIN up ON up.src = p.v) SELECT max(u)::DOUBLE AS length FROM p")
def dag_weighted_longest_path(spark, d):
    g = upward(spark, d)
    path = D.dag_weighted_longest_path(g, "payload")
    steps = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "src bigint, dst bigint")
    return g.E.join(steps, ["src", "dst"]).agg(F.coalesce(F.sum("payload"), F.lit(0)).cast("double").alias("length"))  # a path of one vertex weighs nothing


@query("SELECT '2-3' AS run")
def collect_bicolor_runs(spark, d):
    g = small(spark, [(0, 2, 0.0), (1, 2, 1.0), (2, 3, 0.0), (2, 3, 1.0), (3, 4, 0.0), (3, 5, 1.0)])
    return D.collect_bicolor_runs(g, "id IN (2, 3)", "cast(payload AS bigint)").select(F.array_join(F.col("run").cast("array<string>"), "-").alias("run"))


@query(TRADE + """, u AS (SELECT *, row_number() OVER (ORDER BY w, eid) AS k FROM e),
f AS (SELECT 0 AS k, id, id AS c FROM v UNION ALL SELECT f.k + 1, f.id, CASE WHEN f.c = greatest(x.c, y.c) THEN least(x.c, y.c) ELSE f.c END FROM f JOIN u ON u.k = f.k + 1 JOIN f x ON x.id = u.src JOIN f y ON y.id = u.dst)
SELECT u.eid, u.w AS payload FROM u JOIN f x ON x.k = u.k - 1 AND x.id = u.src JOIN f y ON y.k = u.k - 1 AND y.id = u.dst WHERE x.c <> y.c""")
def minimum_spanning_tree(spark, d):
    return Tr.minimum_spanning_tree(trade(spark, d, False), "payload").E.select("eid", "payload")


@query("WITH t AS (SELECT n_nationkey, min(c_custkey) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1) SELECT 1::BIGINT AS src, 100 + n_nationkey::BIGINT AS dst FROM t UNION ALL SELECT 100 + n_nationkey, 1000000000 + c FROM t")
def steiner_tree(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    ends_ = c.groupBy("n_nationkey").agg((F.min("c_custkey") + 10**9).alias("c"))
    return Tr.steiner_tree(tree(spark, d).with_(directed=False).cached(), [r.c for r in ends_.collect()]).E.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def regions(spark, d):
    """Regions and the quantity that they ship each other (undirected)."""
    li, o = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    at = read(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("r"))
    s = read(spark, d, "supplier").join(at, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r").alias("a"))
    c = read(spark, d, "customer").join(at, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r").alias("b"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).where("a != b")
    E = rows.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("l_quantity").cast("bigint").alias("payload"))
    return Graph.from_edges(E.select((F.col("src") * 10 + F.col("dst")).alias("eid"), "src", "dst", "payload")).cached()


REGIONS = """WITH e AS (SELECT least(s.n_regionkey, c.n_regionkey)::BIGINT AS src, greatest(s.n_regionkey, c.n_regionkey)::BIGINT AS dst, sum(l_quantity)::BIGINT AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation c ON c.n_nationkey = c_nationkey WHERE s.n_regionkey <> c.n_regionkey GROUP BY 1, 2)"""


@query(REGIONS + " SELECT min(c)::DOUBLE AS value FROM (SELECT m, sum(w) FILTER (((m >> src::INT) & 1) <> ((m >> dst::INT) & 1)) AS c FROM e, range(1, 31) s(m) GROUP BY m)")
def stoer_wagner_min_cut(spark, d):
    return _row(spark, value=float(Co.stoer_wagner_min_cut(regions(spark, d), "payload")[0]))


# --- matching, colouring, swapping, isomorphism ------------------------------------------------


@query("""WITH RECURSIVE x AS (SELECT conv_id, turn, (turn * 7 + conv_id * 3) % 10 + 1 AS w, EXISTS (SELECT 1 FROM conversations y WHERE y.conv_id = c.conv_id AND y.turn = c.turn - 1) AS linked FROM conversations c),
b AS (SELECT conv_id, turn, 0::BIGINT AS here, 0::BIGINT AS before FROM x WHERE NOT linked UNION ALL SELECT x.conv_id, x.turn, greatest(b.here, b.before + x.w), b.here FROM b JOIN x ON x.conv_id = b.conv_id AND x.turn = b.turn + 1)
SELECT sum(here)::BIGINT AS weight FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.conv_id = b.conv_id AND x.turn = b.turn + 1)""")
def max_weight_matching(spark, d):
    g = chains(spark, d)
    weight = F.expr("((dst % 1000) * 7 + (dst div 1000) * 3) % 10 + 1").cast("double")
    g = g.with_(E=g.E.withColumn("payload", weight), directed=False).cached()
    got = Col.max_weight_matching(g, weight="payload")
    both = g.E.join(got.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), ["src", "dst"])
    return both.agg(F.sum("payload").cast("bigint").alias("weight"))


@query(CHAINS + " SELECT true AS yes, count(*) = 0 AS shared, false AS missing FROM e x JOIN e y ON x.dst = y.src")
def is_matching(spark, d):
    g = chains(spark, d).with_(directed=False).cached()
    every = g.E.select("src", "dst")
    return _row(spark, yes=Col.is_matching(g, every.where("src % 2 = 0")), shared=Col.is_matching(g, every), missing=Col.is_matching(g, every.select("src", (F.col("dst") + 1).alias("dst")).where("src % 1000 = 0")))


@query(TRADE + ", q AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), g AS (SELECT a AS id FROM q UNION ALL SELECT b FROM q) SELECT true AS proper, true AS few, (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM g GROUP BY id)) AS degree")
def misra_gries_edge_color(spark, d):
    g = simple_trade(spark, d)
    got, top = Col.misra_gries_edge_color(g), g.degrees().agg(F.max("degree")).head()[0]
    return _row(spark, proper=_proper(g, got), few=got.select("color").distinct().count() <= top + 1, degree=top)


def _apart(g, colors):
    """No edge joins two vertices of one colour."""
    a, b = colors.select(F.col("id").alias("src"), F.col("color").alias("a")), colors.select(F.col("id").alias("dst"), F.col("color").alias("b"))
    return g.E.where("src != dst").join(a, "src").join(b, "dst").where("a = b").isEmpty()


@query(TRADE + """, nb AS (SELECT DISTINCT src, dst FROM a WHERE src <> dst), o AS (SELECT id, row_number() OVER (ORDER BY (SELECT count(*) FROM nb WHERE src = id) DESC, id) AS k FROM v),
low AS (SELECT x.k, list(y.k) FILTER (y.k < x.k) AS ks FROM o x LEFT JOIN nb ON nb.src = x.id LEFT JOIN o y ON y.id = nb.dst GROUP BY x.k),
g AS (SELECT 0 AS k, []::BIGINT[] AS cs UNION ALL SELECT g.k + 1, list_append(cs, list_min(list_filter(range(0, 30), lambda c: NOT list_contains(list_transform(coalesce(ks, []::BIGINT[]), lambda j: cs[j]), c)))) FROM g JOIN low ON low.k = g.k + 1)
SELECT o.id, (SELECT cs FROM g ORDER BY k DESC LIMIT 1)[o.k] AS color FROM o""")
def greedy_color(spark, d):
    return Col.greedy_color(trade(spark, d, False))


@query(TRADE + """, nb AS (SELECT DISTINCT src, dst FROM a WHERE src <> dst), o AS (SELECT id, row_number() OVER (ORDER BY id <> 0, (SELECT count(*) FROM nb WHERE src = id) DESC, id) AS k FROM v),
low AS (SELECT x.k, list(y.k) FILTER (y.k < x.k) AS ks FROM o x LEFT JOIN nb ON nb.src = x.id LEFT JOIN o y ON y.id = nb.dst GROUP BY x.k),
g AS (SELECT 0 AS k, []::BIGINT[] AS cs UNION ALL SELECT g.k + 1, list_append(cs, CASE WHEN low.k = 1 THEN 3 ELSE list_min(list_filter(range(0, 30), lambda c: NOT list_contains(list_transform(coalesce(ks, []::BIGINT[]), lambda j: cs[j]), c))) END) FROM g JOIN low ON low.k = g.k + 1)
SELECT o.id, (SELECT cs FROM g ORDER BY k DESC LIMIT 1)[o.k] AS color FROM o""")
def greedy_node_color_with_preset_colors(spark, d):
    return Col.greedy_color(trade(spark, d, False), {0: 3})


@query("SELECT count(*) > 0 AS home, max(turn) + 1 AS tokens FROM conversations WHERE conv_id = (SELECT conv_id FROM conversations ORDER BY turn DESC, conv_id LIMIT 1)")
def token_swapper(spark, d):
    g = chains(spark, d).with_(directed=False).cached()
    last = read(spark, d, "conversations").orderBy(F.desc("turn"), "conv_id").head()  # the longest chain, turned round
    n, at0 = last.turn + 1, last.conv_id * 1000
    want = {at0 + i: at0 + n - 1 - i for i in range(n)}
    at = dict(want)
    for r in Col.token_swapper(g, want, seed=1).orderBy("pos").collect():
        a, b = at.pop(r.src, None), at.pop(r.dst, None)
        at |= ({r.dst: a} if a is not None else {}) | ({r.src: b} if b is not None else {})
    return _row(spark, home=all(v == t for v, t in at.items()), tokens=n)


@query(TRADE + " SELECT count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src")
def vf2_mapping(spark, d):
    return _row(spark, n=sum(1 for _ in Pr.vf2_mapping(trade(spark, d), G.directed_cycle_graph(spark, 3), subgraph=True, induced=False)))


@query("SELECT count(DISTINCT n_name) = count(*) AS same, false AS other FROM nation")
def is_isomorphic_node_match(spark, d):
    g = trade(spark, d)
    turned = g.with_(g.V.select((24 - F.col("id")).alias("id"), "payload"), g.E.select("eid", (24 - F.col("src")).alias("src"), (24 - F.col("dst")).alias("dst"), "payload"))
    renamed = g.with_(g.V.select("id", F.concat("payload", F.lit("?")).alias("payload")))
    eq = lambda x, y: x == y
    return _row(spark, same=Pr.is_isomorphic_node_match(g, turned, eq), other=Pr.is_isomorphic_node_match(g, renamed, eq))


# --- layouts -----------------------------------------------------------------------------------


def _rounded(df):
    return df.select("id", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


def _placed(points: str) -> str:
    """SQL: points(id, x, y) centred on the mean and scaled to the unit box."""
    return f"""WITH p AS ({points}), c AS (SELECT id, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM p), s AS (SELECT max(greatest(abs(x), abs(y))) AS m FROM c)
SELECT id, round(x / m, 5) + 0.0 AS x, round(y / m, 5) + 0.0 AS y FROM c, s"""


@query("SELECT 25::BIGINT AS n, true AS inside, true AS apart")
def random_layout(spark, d):
    at = L.random_layout(trade(spark, d), seed=5).cache()
    return _row(spark, n=at.count(), inside=at.where("x < 0 OR x >= 1 OR y < 0 OR y >= 1").isEmpty(), apart=at.select("x", "y").distinct().count() == 25)


@query(TRADE + " SELECT id, round(CASE WHEN id < 10 THEN 0.5 ELSE 1 END * cos(CASE WHEN id < 10 THEN 2 * pi() * id / 10 + pi() / 2 ELSE 2 * pi() * (id - 10) / 15 + pi() END), 5) + 0.0 AS x, round(CASE WHEN id < 10 THEN 0.5 ELSE 1 END * sin(CASE WHEN id < 10 THEN 2 * pi() * id / 10 + pi() / 2 ELSE 2 * pi() * (id - 10) / 15 + pi() END), 5) + 0.0 AS y FROM v")
def shell_layout(spark, d):
    return _rounded(L.shell_layout(trade(spark, d), [list(range(10)), list(range(10, 25))]))


@query(_placed("SELECT i AS id, i * cos(i * 0.35) AS x, i * sin(i * 0.35) AS y FROM range(25) t(i)"))
def spiral_layout(spark, d):
    return _rounded(L.spiral_layout(trade(spark, d)))


@query(_placed("SELECT i AS id, CASE WHEN i < 10 THEN 0 ELSE 4 / 3 END AS x, CASE WHEN i < 10 THEN i / 9 ELSE (i - 10) / 14 END AS y FROM range(25) t(i)"))
def bipartite_layout(spark, d):
    return _rounded(L.bipartite_layout(trade(spark, d), list(range(10))))


@query("SELECT 25::BIGINT AS n, true AS inside, true AS kept, true AS apart")
def spring_layout(spark, d):
    g = trade(spark, d)
    free = L.spring_layout(g, seed=2).cache()
    held = L.spring_layout(g, pos={0: (0.25, 0.5), 1: (0.75, 0.5)}, fixed=[0, 1], seed=2).where("id < 2")
    kept = sorted((r.id, r.x, r.y) for r in held.collect()) == [(0, 0.25, 0.5), (1, 0.75, 0.5)]
    return _row(spark, n=free.count(), inside=free.where("abs(x) > 1.000001 OR abs(y) > 1.000001").isEmpty(), kept=kept, apart=free.select(F.round("x", 6), F.round("y", 6)).distinct().count() == 25)


@query(TRADE + " SELECT count(*) AS n, true AS inside, true AS apart FROM v")
def kamada_kawai_layout(spark, d):
    at = L.kamada_kawai_layout(simple_trade(spark, d)).cache()
    return _row(spark, n=at.count(), inside=at.where("abs(x) > 1.000001 OR abs(y) > 1.000001").isEmpty(), apart=at.select(F.round("x", 6), F.round("y", 6)).distinct().count() == 25)


# --- generators --------------------------------------------------------------------------------


@query(GROWN + " SELECT i AS src, j AS dst FROM a JOIN b ON i < j")
def mesh_graph(spark, d):
    return G.mesh_graph(spark, grown(spark, d)).edge_list()


@query(GROWN + " SELECT i AS src, j AS dst FROM a JOIN b ON i <> j")
def directed_mesh_graph(spark, d):
    return G.directed_mesh_graph(spark, grown(spark, d)).edge_list()


@query(GROWN + ", r AS (SELECT unnest(range(k)) AS r, k FROM (SELECT count(*) AS k FROM nation)) SELECT r * n + i AS src, (r + 1) * n + i AS dst FROM a, n, r WHERE r + 1 < k UNION ALL SELECT r * n + i, r * n + i + 1 FROM a, n, r WHERE i + 1 < n")
def directed_grid_graph(spark, d):
    return G.directed_grid_graph(spark, grown(spark, d, "nation"), grown(spark, d)).edge_list()


@query(GROWN + " SELECT i - (1 << floor(log2(i))::INT) AS src, i AS dst FROM (SELECT unnest(range(1, 1 << k)) AS i FROM (SELECT floor(log2(n))::INT + 1 AS k FROM n))")
def directed_binomial_tree_graph(spark, d):
    return G.directed_binomial_tree_graph(spark, grown(spark, d).bit_length()).edge_list()


@query(GROWN + " SELECT n AS nodes, 0::BIGINT AS edges FROM n")
def directed_empty_graph(spark, d):
    return _sizes(spark, G.directed_empty_graph(spark, grown(spark, d)))


@query(GROWN + ", k AS (SELECT 2 * (n // 20) + 3 AS k FROM n) SELECT 3 * k * k - 2 * k AS nodes, 4 * k * (k - 1) AS edges FROM k")
def directed_heavy_square_graph(spark, d):
    return _sizes(spark, G.directed_heavy_square_graph(spark, 2 * (grown(spark, d) // 20) + 3))


@query(GROWN + ", k AS (SELECT 2 * (n // 20) + 3 AS k FROM n) SELECT (5 * k * k - 2 * k - 1) // 2 AS nodes FROM k")
def directed_heavy_hex_graph(spark, d):
    return _row(spark, nodes=G.directed_heavy_hex_graph(spark, 2 * (grown(spark, d) // 20) + 3).num_nodes())


@query(GROWN + " SELECT 2 * (4 + 1) * (n + 1) - 2 AS nodes, 3 * 4 * n + 2 * (4 + n) - 1 AS edges FROM n")
def directed_hexagonal_lattice_graph(spark, d):
    return _sizes(spark, G.directed_hexagonal_lattice_graph(spark, 4, grown(spark, d)))


@query(GROWN + " SELECT i AS src, j AS dst FROM a JOIN b ON i < j")
def undirected_gnp_random_graph(spark, d):
    return G.undirected_gnp_random_graph(spark, grown(spark, d), 1.0, seed=1).edge_list()


@query(GROWN + " SELECT n AS nodes, true AS near, true AS simple FROM n")
def directed_gnp_random_graph(spark, d):
    n = grown(spark, d)
    g = G.directed_gnp_random_graph(spark, n, 0.1, seed=4)
    simple = not g.has_parallel_edges() and g.edge_list().where("src = dst").isEmpty()
    mean = n * (n - 1) * 0.1  # five standard deviations
    return _row(spark, nodes=g.num_nodes(), near=abs(g.num_edges() - mean) < 5 * math.sqrt(0.9 * mean), simple=simple)


@query(GROWN + " SELECT i AS src, j AS dst FROM a JOIN b ON i < j, n WHERE (i < n // 2) <> (j < n // 2)")
def undirected_sbm_random_graph(spark, d):
    n = grown(spark, d)
    return G.undirected_sbm_random_graph(spark, [n // 2, n - n // 2], [[0.0, 1.0], [1.0, 0.0]], False, seed=1).edge_list()


@query(GROWN + " SELECT i AS src, j AS dst FROM a, b, n WHERE i < n // 2 AND j >= n // 2")
def directed_sbm_random_graph(spark, d):
    n = grown(spark, d)
    return G.directed_sbm_random_graph(spark, [n // 2, n - n // 2], [[0.0, 1.0], [0.0, 0.0]], True, seed=1).edge_list()


@query(GROWN + " SELECT i AS src, n + k AS dst FROM a, n, (SELECT unnest(range(7)) AS k)")
def undirected_random_bipartite_graph(spark, d):
    return G.undirected_random_bipartite_graph(spark, grown(spark, d), 7, 1.0, seed=1).edge_list()


@query(GROWN + " SELECT i AS src, n + k AS dst FROM a, n, (SELECT unnest(range(7)) AS k)")
def directed_random_bipartite_graph(spark, d):
    return G.directed_random_bipartite_graph(spark, grown(spark, d), 7, 1.0, seed=1).edge_list()


@query(GROWN + " SELECT n AS nodes, (n - 3) * 3 + 2 AS edges FROM n")
def directed_barabasi_albert_graph(spark, d):
    return _sizes(spark, G.directed_barabasi_albert_graph(spark, grown(spark, d), 3, seed=3))


@query("SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE sqrt((a.embedding[1]::DOUBLE - b.embedding[1]) ** 2 + (a.embedding[2]::DOUBLE - b.embedding[2]) ** 2) < 0.05")
def random_geometric_graph(spark, d):
    pos = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 2).alias("pos"))
    return G.random_geometric_graph(spark, 0, 0.05, pos=pos).edge_list()


@query("WITH p AS (SELECT vec_id AS i, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y FROM embeddings) SELECT a.i AS src, b.i AS dst FROM p a JOIN p b ON a.i < b.i WHERE acosh(greatest(1, sqrt(1 + (a.x * a.x + a.y * a.y)) * sqrt(1 + (b.x * b.x + b.y * b.y)) - (a.x * b.x + a.y * b.y))) < 0.7")
def hyperbolic_random_graph(spark, d):
    pos = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double") * 20).alias("pos"))
    return G.hyperbolic_random_graph(spark, pos, 0.7).edge_list()


# --- the graph value ---------------------------------------------------------------------------


@query("SELECT count(*) AS nodes, 0::BIGINT AS edges, true AS directed FROM nation")
def new(spark, d):
    g = Graph.empty(spark, True).add_nodes_from([r.n_name for r in read(spark, d, "nation").select("n_name").collect()])[0]
    return _row(spark, nodes=g.num_nodes(), edges=g.num_edges(), directed=g.directed)


@query(TRADE + " SELECT eid, src, dst, w AS payload FROM e WHERE src <> 3 AND dst <> 3")
def save_and_load(spark, d):
    at = f"{spot(spark)}/g"
    trade(spark, d).remove_node(3).save(at)  # with a hole among the ids
    return Graph.load(spark, at).edge_index_map()


@query(TRADE + " SELECT true AS directed, true AS multigraph, true AS check_cycle, 'x' AS attrs, count(*) AS edges FROM e WHERE src < dst")
def getnewargs_and_state(spark, d):
    at = f"{spot(spark)}/g"
    upward(spark, d).with_(attrs="x", check_cycle=True).save(at)
    g = Graph.load(spark, at)
    return _row(spark, directed=g.directed, multigraph=g.multigraph, check_cycle=g.check_cycle, attrs=g.attrs, edges=g.num_edges())


@query(TRADE + " SELECT false AS before, true AS later, count(*) > 0 AS refused FROM e WHERE src < dst")
def check_cycle(spark, d):
    from weftgraph.errors import DAGWouldCycle

    g = upward(spark, d).cached()
    h, refused, one = g.set_check_cycle(True), False, g.E.orderBy("eid").head()
    if one is not None:
        try:
            h.add_edge(one.dst, one.src, 0)
        except DAGWouldCycle:
            refused = True
    return _row(spark, before=g.check_cycle, later=h.check_cycle, refused=refused)


@query(TRADE + " SELECT 0::BIGINT AS cleared, (SELECT count(*) FROM v) AS copied, (SELECT count(*) FROM v) AS size, true AS multigraph")
def clear_copy_len(spark, d):
    g = trade(spark, d)
    return _row(spark, cleared=g.clear().num_nodes(), copied=g.copy().num_nodes(), size=len(g), multigraph=g.multigraph)


@query("SELECT n_nationkey::BIGINT AS id, CASE n_nationkey WHEN 4 THEN 'new' ELSE n_name END AS payload FROM nation")
def update_node(spark, d):
    return trade(spark, d).update_node(4, "new").V.select("id", "payload")


@query(TRADE + " SELECT payload AS name, true AS missing FROM v WHERE id = 5")
def getitem_and_delitem(spark, d):
    g, missing = trade(spark, d), False
    try:
        g.delete_node(5).delete_node(5)
    except IndexError:
        missing = True
    return _row(spark, name=g[5], missing=missing)


@query(TREE + " SELECT id FROM v")
def node_indexes(spark, d):
    return tree(spark, d).node_indexes()


PAIR = "SELECT src, dst FROM e WHERE eid = 5"


def _pair(g):
    return g.get_edge_endpoints_by_index(5)


def _pairs(g, *eids):
    """The ends of those of the edges that exist."""
    out = []
    for eid in eids:
        try:
            out.append(g.get_edge_endpoints_by_index(eid))
        except IndexError:
            pass
    return out


@query(TRADE + " SELECT w AS payload FROM e WHERE eid = 5")
def get_edge_data(spark, d):
    g = trade(spark, d)
    return _found(spark, "payload bigint", lambda: (g.get_edge_data(*_pair(g)),), IndexError)


@query(TRADE + " SELECT eid, w AS payload FROM e WHERE eid = 5")
def get_all_edge_data(spark, d):
    g = trade(spark, d)
    pairs = _pairs(g, 5)
    return g.get_all_edge_data(*pairs[0]) if pairs else g.E.limit(0).select("eid", "payload")


@query(TRADE + " SELECT count(*)::BIGINT AS n FROM e WHERE dst = 2")
def in_degree(spark, d):
    return _row(spark, n=trade(spark, d).in_degree(2))


@query(TRADE + " SELECT count(*)::BIGINT AS n FROM e WHERE src = 2")
def out_degree(spark, d):
    return _row(spark, n=trade(spark, d).out_degree(2))


def _payload(spark, find):
    """The payload found, or null: the edge that names the vertex may not exist, or no neighbour suit."""
    try:
        value = find()
    except (IndexError, NoSuitableNeighbors):
        value = None
    return spark.createDataFrame([(value,)], "payload string")


@query(TRADE + " SELECT arg_min(payload, v.id) AS payload FROM v JOIN e ON e.dst = v.id WHERE src = (SELECT src FROM e WHERE eid = 5) AND w > 10")
def find_successor_node_by_edge(spark, d):
    g = trade(spark, d)
    return _payload(spark, lambda: g.find_successor_node_by_edge(_pair(g)[0], "payload > 10"))


@query(TRADE + " SELECT arg_min(payload, v.id) AS payload FROM v JOIN e ON e.dst = v.id WHERE src = (SELECT src FROM e WHERE eid = 5) AND w > 10")
def find_adjacent_node_by_edge(spark, d):
    g = trade(spark, d)
    return _payload(spark, lambda: g.find_adjacent_node_by_edge(_pair(g)[0], "payload > 10"))


@query(TRADE + " SELECT arg_min(payload, v.id) AS payload FROM v JOIN e ON e.src = v.id WHERE dst = (SELECT dst FROM e WHERE eid = 5) AND w > 10")
def find_predecessor_node_by_edge(spark, d):
    g = trade(spark, d)
    return _payload(spark, lambda: g.find_predecessor_node_by_edge(_pair(g)[1], "payload > 10"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS payload FROM nation UNION ALL VALUES (25, 'x')")
def add_node(spark, d):
    return trade(spark, d).add_node("x")[0].V.select("id", "payload")


@query(TRADE + " SELECT eid, src, dst, w AS payload FROM e UNION ALL SELECT (SELECT count(*) FROM e), 7, 0, 9")
def add_edge(spark, d):
    return trade(spark, d).add_edge(7, 0, 9)[0].edge_index_map()


@query(TRADE + " SELECT src, dst, w AS payload FROM e UNION ALL VALUES (7, 0, NULL), (8, 0, NULL)")
def add_edges_from_no_data(spark, d):
    return ends(trade(spark, d).add_edges_from_no_data([(7, 0), (8, 0)])[0])


@query(TRADE + " SELECT src, dst, w AS payload FROM e UNION ALL VALUES (7, 26, NULL)")
def extend_from_edge_list(spark, d):
    return ends(trade(spark, d).extend_from_edge_list([(7, 26)]))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS payload FROM nation UNION ALL VALUES (25, NULL), (26, NULL)")
def extend_from_weighted_edge_list(spark, d):
    return trade(spark, d).extend_from_weighted_edge_list([(7, 26, 4), (25, 3, 5)]).V.select("id", "payload")


@query(TRADE + " SELECT eid FROM e WHERE eid <> 5")
def remove_edge(spark, d):
    g = trade(spark, d)
    for pair in _pairs(g, 5):
        g = g.remove_edge(*pair)
    return g.edge_indices()


@query(TRADE + " SELECT eid FROM e WHERE eid NOT IN (5, 6)")
def remove_edges_from(spark, d):
    g = trade(spark, d)
    return g.remove_edges_from(_pairs(g, 5, 6)).edge_indices()


@query(TRADE + " SELECT eid, CASE eid WHEN 5 THEN 1 ELSE w END AS payload FROM e")
def update_edge(spark, d):
    g = trade(spark, d)
    for pair in _pairs(g, 5):
        g = g.update_edge(*pair, 1)
    return g.E.select("eid", "payload")


@query(TRADE + " SELECT CASE src WHEN 3 THEN 4 ELSE src END AS src, CASE dst WHEN 3 THEN 4 ELSE dst END AS dst FROM e")
def merge_nodes(spark, d):
    g = trade(spark, d)
    return g.update_node(3, "same").update_node(4, "same").merge_nodes(3, 4).edge_list()


@query(TRADE + " SELECT src, CASE WHEN dst = 3 THEN 25 ELSE dst END AS dst FROM e UNION ALL SELECT 25, 3 FROM e WHERE dst = 3")
def insert_node_on_in_edges(spark, d):
    g, n = trade(spark, d).add_node("x")
    return g.insert_node_on_in_edges(n, 3).edge_list()


@query(TRADE + " SELECT src, CASE WHEN dst IN (3, 4) THEN 25 ELSE dst END AS dst FROM e UNION ALL SELECT 25, dst FROM e WHERE dst IN (3, 4)")
def insert_node_on_in_edges_multiple(spark, d):
    g, n = trade(spark, d).add_node("x")
    return g.insert_node_on_in_edges_multiple(n, [3, 4]).edge_list()


@query(TRADE + " SELECT CASE WHEN src = 3 THEN 25 ELSE src END AS src, dst FROM e UNION ALL SELECT 3, 25 FROM e WHERE src = 3")
def insert_node_on_out_edges(spark, d):
    g, n = trade(spark, d).add_node("x")
    return g.insert_node_on_out_edges(n, 3).edge_list()


@query(TRADE + " SELECT CASE WHEN src IN (3, 4) THEN 25 ELSE src END AS src, dst FROM e UNION ALL SELECT src, 25 FROM e WHERE src IN (3, 4)")
def insert_node_on_out_edges_multiple(spark, d):
    g, n = trade(spark, d).add_node("x")
    return g.insert_node_on_out_edges_multiple(n, [3, 4]).edge_list()


RETAINED = TREE + " SELECT src, dst FROM e WHERE src <> 102 AND dst <> 102 UNION ALL SELECT i.src, o.dst FROM e i JOIN e o ON i.dst = 102 AND o.src = 102"


def upward(spark, d):
    """The trade graph's edges to greater ids: it has no cycle."""
    g = trade(spark, d)
    return g.with_(E=g.E.where("src < dst"))


def simple_trade(spark, d):
    """Trade without direction and without parallel edges; the payload of a pair is the sum."""
    g = trade(spark, d, False)
    E = g.E.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("eid").alias("eid"), F.sum("payload").cast("bigint").alias("payload"))
    return g.with_(E=E.select("eid", "src", "dst", "payload"), multigraph=False).cached()


@query(RETAINED)
def remove_node_retain_edges_by_key(spark, d):
    return tree(spark, d).remove_node_retain_edges_by_key(102, "payload").edge_list()


@query(RETAINED)
def remove_node_retain_edges_by_id(spark, d):
    return tree(spark, d).remove_node_retain_edges_by_id(102).edge_list()


@query(TRADE + " SELECT eid, src, dst, w AS payload FROM e WHERE eid IN (2, 5)")
def edge_subgraph(spark, d):
    g = trade(spark, d)
    return g.edge_subgraph(_pairs(g, 5, 2)).edge_index_map()


@query(TRADE + " SELECT src, dst, w AS payload FROM e UNION ALL SELECT src + 25, dst + 25, w FROM e UNION ALL VALUES (1, 28, 7)")
def compose(spark, d):
    g = trade(spark, d)
    return ends(g.compose(g, {1: (3, 7)})[0])


@query(TRADE + " SELECT CASE src WHEN 2 THEN 25 ELSE src END AS src, CASE dst WHEN 2 THEN 26 ELSE dst END AS dst FROM e UNION ALL VALUES (25, 26)")
def substitute_node_with_subgraph(spark, d):
    two = G.directed_path_graph(spark, 2)
    two = two.with_(two.V.select("id", F.lit("n").alias("payload")), two.E.select("eid", "src", "dst", F.lit(0).cast("bigint").alias("payload")))
    return trade(spark, d).substitute_node_with_subgraph(2, two, lambda src, dst, payload: 0 if src == 2 else 1)[0].edge_list()


@query(TREE + " SELECT count(*) > 0 AS ends, false AS around FROM e WHERE src = 102")
def can_contract_without_cycle(spark, d):
    g = tree(spark, d)
    low = g.E.where("src = 102").agg(F.min("dst")).head()[0]
    top = g.E.where("dst = 102").head().src
    return _row(spark, ends=g.can_contract_without_cycle([102, low]), around=g.can_contract_without_cycle([top, low]))


@query(TREE + " SELECT 3::BIGINT AS layers, (SELECT count(*) FROM v) AS nodes, false AS active")
def topological_sorter(spark, d):
    s = TopologicalSorter(tree(spark, d))
    layers = nodes_ = 0
    while s.is_active():
        ready = s.get_ready()
        layers, nodes_ = layers + 1, nodes_ + len(ready)
        s.done(ready)
    return _row(spark, layers=layers, nodes=nodes_, active=s.is_active())


@query(TRADE + " SELECT (SELECT count(*) FROM v)::BIGINT AS nodes, true AS directed")
def digraph_class(spark, d):
    g = trade(spark, d)
    g = DAG(g.V, g.E)
    return _row(spark, nodes=g.num_nodes(), directed=g.directed)


# --- distances ---------------------------------------------------------------------------------


def _against_first(spark, d, distance):
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    one = rows.where("vec_id = 0").select(F.col("x").alias("y"))  # one row
    return rows.join(F.broadcast(one)).select(F.col("vec_id").alias("id"), F.round(distance(F.col("x"), F.col("y")), 4).alias("dist"))


def _terms(expr: str) -> str:
    """SQL: the terms of two vectors x and y as a list."""
    return f"list_transform(range(1, len(x) + 1), lambda i: {expr})"


VECTORS = "SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS x, b.y FROM embeddings a, (SELECT embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id = 0) b"


@query(f"WITH p AS ({VECTORS}) SELECT id, round(list_sum({_terms('abs(x[i] - y[i]) ** 3')}) ** (1 / 3), 4) AS dist FROM p")
def lp_distance(spark, d):
    return _against_first(spark, d, lambda x, y: Di.lp_distance(x, y, 3.0))


@query(f"WITH p AS ({VECTORS}) SELECT id, round(list_max({_terms('abs(x[i] - y[i])')}), 4) AS dist FROM p")
def maximum_distance(spark, d):
    return _against_first(spark, d, Di.maximum_distance)


def _points(spark, d):
    """The first two numbers of each embedding, and a fixed point."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 2).alias("x"))
    return rows.withColumn("y", F.array(F.lit(1.0), F.lit(2.0)))


@query("WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT id, round(acos(least(1, greatest(-1, cos(a) * cos(1) + sin(a) * sin(1) * cos(b - 2)))), 5) AS dist FROM p")
def angular_distance(spark, d):
    return _points(spark, d).select("id", F.round(Di.angular_distance(F.col("x"), F.col("y")), 5).alias("dist"))


@query("WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT id, round(acosh(greatest(1, cosh(a) * cosh(1) - sinh(a) * sinh(1) * cos(b - 2))), 5) AS dist FROM p")
def polar_hyperbolic_distance(spark, d):
    return _points(spark, d).select("id", F.round(Di.polar_hyperbolic_distance(F.col("x"), F.col("y")), 5).alias("dist"))


@query("WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT id, round(acosh(greatest(1, sqrt(1 + a * a + b * b) * sqrt(6) - (a + 2 * b))), 5) AS dist FROM p")
def hyperboloid_hyperbolic_distance(spark, d):
    return _points(spark, d).select("id", F.round(Di.hyperboloid_hyperbolic_distance(F.col("x"), F.col("y")), 5).alias("dist"))
