"""Registered graph queries over the star-schema tables, each with the same result in SQL where SQL can say it.

Graphs: ``trade`` (nations; an edge where a supplier nation ships a customer nation a quarter more
than its mean), ``tree`` (region, nation, customer, supplier), ``chains`` (turns of conversations),
``supply`` (parts and suppliers of line items, undirected, bipartite).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.graph import Graph, number
from weftgraph.operators import centrality as C
from weftgraph.operators import coloring as Col
from weftgraph.operators import components as Co
from weftgraph.operators import dag as D
from weftgraph.operators import layouts as L
from weftgraph.operators import paths as P
from weftgraph.operators import products as Pr
from weftgraph.operators import traversal as T
from weftgraph.operators import trees as Tr
from weftgraph.sources import files as Fi
from weftgraph.sources import generators as G

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trade(spark: SparkSession, d: str, directed: bool = True) -> Graph:
    """Only the columns of the joins are read; customers and suppliers are small beside the line items, and AQE picks the join."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("dst"))
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("src"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    e = rows.where("src != dst").groupBy("src", "dst").agg(F.sum("l_quantity").cast("bigint").alias("payload"))
    e = e.withColumn("mean", F.avg("payload").over(W.partitionBy("src"))).where("payload >= 1.25D * mean").drop("mean")
    E = number(e.withColumn("eid", F.lit(0)), "eid", ["src", "dst"]).select("eid", "src", "dst", "payload")
    V = read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("payload"))
    return Graph(V, E, directed).cached()


TRADE = """WITH RECURSIVE t0 AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, sum(l_quantity)::BIGINT AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
t1 AS (SELECT *, avg(w) OVER (PARTITION BY src) AS m FROM t0),
e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, w FROM t1 WHERE w >= 1.25 * m),
v AS (SELECT n_nationkey::BIGINT AS id, n_name AS payload FROM nation),
a AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)"""
#: All-pairs hops along edges, and weighted distances, 25 rounds (there are 25 nations).
HOPS = """, hop AS (SELECT id AS s, id AS t, 0 AS d FROM v UNION SELECT s, dst, d + 1 FROM hop JOIN e ON t = src WHERE d < 25),
dist AS (SELECT s, t, min(d)::BIGINT AS d FROM hop GROUP BY s, t)"""
RELAX = """, r AS (SELECT 0 AS k, id AS s, id AS t, 0::BIGINT AS d FROM v UNION ALL SELECT k + 1, s, t, min(d) FROM (SELECT k, s, t, d FROM r UNION ALL SELECT k, s, dst, d + w FROM r JOIN e ON t = src) WHERE k < 25 GROUP BY k, s, t),
wd AS (SELECT s, t, d FROM r WHERE k = 25)"""


def tree(spark: SparkSession, d: str) -> Graph:
    def part(table, key, parent, at, up):
        return read(spark, d, table).select((F.col(key).cast("bigint") + at).alias("dst"), (F.col(parent).cast("bigint") + up).alias("src"))

    n = part("nation", "n_nationkey", "n_regionkey", 100, 0)
    E = n.unionByName(part("customer", "c_custkey", "c_nationkey", 10**9, 100)).unionByName(part("supplier", "s_suppkey", "s_nationkey", 2 * 10**9, 100))
    E = E.withColumns({"eid": F.col("dst"), "payload": F.lit(1.0)})
    return Graph.from_edges(E, directed=True)


TREE = """WITH RECURSIVE e AS (SELECT n_regionkey::BIGINT AS src, 100 + n_nationkey::BIGINT AS dst FROM nation UNION ALL SELECT 100 + c_nationkey::BIGINT, 1000000000 + c_custkey FROM customer UNION ALL SELECT 100 + s_nationkey::BIGINT, 2000000000 + s_suppkey FROM supplier),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def chains(spark: SparkSession, d: str) -> Graph:
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    V = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("payload"))
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"))
    E = rows.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"))
    E = E.select(F.col("src").alias("eid"), "src", (F.col("src") + 1).alias("dst"), F.lit(1.0).alias("payload"))
    return Graph(V, E, True)


CHAINS = """WITH RECURSIVE v AS (SELECT conv_id * 1000 + turn AS id, role FROM conversations),
e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON b.id = a.id + 1)"""


def supply(spark: SparkSession, d: str) -> Graph:
    E = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10**9).alias("dst")).distinct()
    return Graph.from_edges(E.select((F.col("src") * 10**9 + F.col("dst")).alias("eid"), "src", "dst", F.lit(1.0).alias("payload")))


SUPPLY = """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem)"""


#: Generators make as many vertices as there are suppliers, so that they grow with the tables.
GROWN = "WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), a AS (SELECT unnest(range(n)) AS i FROM n), b AS (SELECT i AS j FROM a)"


def grown(spark: SparkSession, d: str, table: str = "supplier") -> int:
    return read(spark, d, table).count()


def _row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def _found(spark: SparkSession, schema: str, find, *missing: type[Exception]) -> DataFrame:
    """What ``find()`` gives as the one row, and no row where it raises one of ``missing``: the more the tables grow, the more
    evenly the nations ship, until ``trade`` has no edge at all."""
    try:
        rows = [find()]
    except missing:
        rows = []
    return spark.createDataFrame(rows, schema)


# --- degrees and rank --------------------------------------------------------------------------


@query(TRADE + " SELECT id, round((SELECT count(*) FROM e WHERE src = id OR dst = id) / CASE WHEN (SELECT count(*) FROM e WHERE src = id OR dst = id) = 48 THEN 48 ELSE 24 END, 6) AS score FROM v")
def degree_centrality(spark, d):
    return C.degree_centrality(trade(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(TRADE + " SELECT id, round((SELECT count(*) FROM e WHERE dst = id) / 24, 6) AS score FROM v")
def in_degree_centrality(spark, d):
    return C.in_degree_centrality(trade(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(TRADE + " SELECT id, round((SELECT count(*) FROM e WHERE src = id) / 24, 6) AS score FROM v")
def out_degree_centrality(spark, d):
    return C.out_degree_centrality(trade(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(SUPPLY + " SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i + o)::BIGINT AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id")
def degrees(spark, d):
    return supply(spark, d).degrees()


@query()
def pagerank(spark, d):
    return C.pagerank(trade(spark, d), weight="payload", tol=1e-9, max_iter=200).select("id", F.round("score", 6).alias("score"))


ORACLE["pagerank"] = TRADE + """, o AS (SELECT src, sum(w) AS t FROM e GROUP BY src),
m AS (SELECT i.id AS src, j.id AS dst, 0.15 / 25 + 0.85 * CASE WHEN o.t IS NULL THEN 1 / 25 ELSE coalesce(e.w, 0) / o.t END AS p FROM v i CROSS JOIN v j LEFT JOIN o ON o.src = i.id LEFT JOIN e ON e.src = i.id AND e.dst = j.id),
x AS (SELECT 0 AS k, id, 1 / 25::DOUBLE AS x FROM v UNION ALL SELECT k + 1, dst, sum(x * p) FROM x JOIN m ON m.src = x.id WHERE k < 120 GROUP BY k, dst)
SELECT id, round(x, 6) AS score FROM x WHERE k = 120"""


@query(TRADE + """, h AS (SELECT 0 AS k, id, 1::DOUBLE AS x FROM v UNION ALL SELECT k + 1, id, y / max(y) OVER () FROM (SELECT h.k, u.dst AS id, sum(h.x * u.c) AS y FROM h JOIN (SELECT f.src AS dst, g.src AS src, sum(f.w::DOUBLE * g.w) AS c FROM e f JOIN e g ON f.dst = g.dst GROUP BY 1, 2) u ON u.src = h.id WHERE h.k < 300 GROUP BY h.k, u.dst)),
hub AS (SELECT v.id, coalesce(x, 0) AS x FROM v LEFT JOIN (SELECT id, x FROM h WHERE k = 300) USING (id)),
au AS (SELECT v.id, coalesce(sum(hub.x * e.w), 0) AS x FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN hub ON hub.id = e.src GROUP BY v.id)
SELECT id, CASE WHEN (SELECT sum(x) FROM hub) > 0 THEN round(hub.x / (SELECT sum(x) FROM hub), 5) ELSE 0 END AS hub, CASE WHEN (SELECT sum(x) FROM au) > 0 THEN round(au.x / (SELECT sum(x) FROM au), 5) ELSE 0 END AS authority FROM hub JOIN au USING (id)""")
def hits(spark, d):
    return C.hits(trade(spark, d), "payload", tol=1e-9, max_iter=1000).select("id", F.round("hub", 5).alias("hub"), F.round("authority", 5).alias("authority"))


@query(TRADE + """, x AS (SELECT 0 AS k, id, 0::DOUBLE AS x FROM v UNION ALL SELECT k + 1, id, 1 + 0.02 * sum(y) FROM (SELECT x.k, e.dst AS id, x.x AS y FROM x JOIN e ON e.src = x.id WHERE x.k < 100 UNION ALL SELECT k, id, 0 FROM x WHERE k < 100) GROUP BY k, id)
SELECT id, round(x / sqrt((SELECT sum(x * x) FROM x WHERE k = 100)), 6) AS score FROM x WHERE k = 100""")
def katz_centrality(spark, d):
    return C.katz_centrality(trade(spark, d), 0.02, tol=1e-12).select("id", F.round("score", 6).alias("score"))


@query(TRADE + """, s AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM e), n AS (SELECT x AS u, y AS t FROM s UNION ALL SELECT y, x FROM s)
SELECT round(coalesce((SELECT count(*) FROM n p JOIN n q ON p.t = q.u JOIN n r ON q.t = r.u AND r.t = p.u) / (SELECT sum(c * (c - 1)) FROM (SELECT u, count(*) AS c FROM n GROUP BY u)), 0), 6) AS transitivity""")
def transitivity(spark, d):
    return _row(spark, transitivity=round(C.transitivity(trade(spark, d, False)), 6))


@query(TRADE + " SELECT round((SELECT count(DISTINCT dst) FROM e WHERE src IN (1, 2) AND dst NOT IN (1, 2)) / 23, 6) AS score")
def group_degree_centrality(spark, d):
    return _row(spark, score=round(C.group_degree_centrality(trade(spark, d), [1, 2]), 6))


@query(TRADE + ", b AS (SELECT id AS s, id AS t, 0 AS d FROM v WHERE id IN (1, 2) UNION SELECT s, src, d + 1 FROM b JOIN e ON t = dst WHERE d < 25), m AS (SELECT t, min(d) AS d FROM b GROUP BY t) SELECT round(CASE WHEN sum(d) > 0 THEN 23 / sum(d) ELSE 0 END, 6) AS score FROM m")
def group_closeness_centrality(spark, d):
    return _row(spark, score=round(C.group_closeness_centrality(trade(spark, d), [1, 2]), 6))


@query(TRADE + HOPS + " SELECT id, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / 24 ELSE 0 END, 6) AS score FROM v JOIN dist ON t = id GROUP BY id")
def closeness_centrality(spark, d):
    return C.closeness_centrality(trade(spark, d)).select("id", F.round("score", 6).alias("score"))


SIGMA = HOPS + """, sg AS (SELECT 0 AS k, id AS s, id AS t, 1::DOUBLE AS c FROM v UNION ALL SELECT k + 1, sg.s, e.dst, sum(c) FROM sg JOIN e ON sg.t = e.src JOIN dist ON dist.s = sg.s AND dist.t = e.dst AND dist.d = k + 1 WHERE k < 25 GROUP BY k, sg.s, e.dst)"""


@query(TRADE + SIGMA + """ SELECT v.id, round(coalesce(sum(p.c * q.c / r.c), 0) / (24 * 23), 6) AS score FROM v
LEFT JOIN (sg p JOIN sg q ON p.t = q.s JOIN sg r ON r.s = p.s AND r.t = q.t AND r.k = p.k + q.k AND p.k > 0 AND q.k > 0) ON p.t = v.id GROUP BY v.id""")
def betweenness_centrality(spark, d):
    return C.betweenness_centrality(trade(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(TRADE + SIGMA + """ SELECT e.eid, round(coalesce(sum(p.c * q.c / r.c), 0) / (25 * 24), 6) AS score FROM e
LEFT JOIN (sg p JOIN e f ON p.t = f.src JOIN sg q ON q.s = f.dst JOIN sg r ON r.s = p.s AND r.t = q.t AND r.k = p.k + q.k + 1) ON f.eid = e.eid GROUP BY e.eid""")
def edge_betweenness_centrality(spark, d):
    return C.edge_betweenness_centrality(trade(spark, d)).select("eid", F.round("score", 6).alias("score"))


# --- paths -------------------------------------------------------------------------------------


@query(TRADE + RELAX + " SELECT t AS id, d::DOUBLE AS dist FROM wd WHERE s = 0 AND t <> 0")
def dijkstra_shortest_path_lengths(spark, d):
    return P.dijkstra_shortest_path_lengths(trade(spark, d), 0, "payload")


@query(TRADE + RELAX + " SELECT t AS id, d::DOUBLE AS dist FROM wd WHERE s = 0 AND t <> 0")
def bellman_ford_shortest_path_lengths(spark, d):
    return P.bellman_ford_shortest_path_lengths(trade(spark, d), 0, "payload")


@query(TRADE + RELAX + " SELECT s AS src, t AS dst, d::DOUBLE AS dist FROM wd WHERE s <> t")
def all_pairs_dijkstra_path_lengths(spark, d):
    return P.all_pairs_dijkstra_path_lengths(trade(spark, d), "payload")


@query(TRADE + RELAX + " SELECT s AS src, t AS dst, d::DOUBLE AS dist FROM wd WHERE s <> t")
def all_pairs_bellman_ford_path_lengths(spark, d):
    return P.all_pairs_bellman_ford_path_lengths(trade(spark, d), "payload")


@query(TRADE + RELAX + " SELECT s AS src, t AS dst, d::DOUBLE AS dist FROM wd")
def floyd_warshall(spark, d):
    return P.floyd_warshall(trade(spark, d), "payload")


@query(TRADE + HOPS + " SELECT s AS src, t AS dst, d::DOUBLE AS dist FROM dist")
def distance_matrix(spark, d):
    return P.distance_matrix(trade(spark, d))


@query(TRADE + SIGMA + " SELECT t AS id, c::BIGINT AS cnt FROM sg WHERE s = 0 AND t <> 0")
def num_shortest_paths_unweighted(spark, d):
    return P.num_shortest_paths_unweighted(trade(spark, d), 0).select("id", F.col("cnt").cast("bigint").alias("cnt"))


@query(TRADE + HOPS + " SELECT CASE WHEN count(*) = 625 THEN round(sum(d) / 600, 6) ELSE 'inf'::DOUBLE END AS average FROM dist")
def unweighted_average_shortest_path_length(spark, d):
    v = P.unweighted_average_shortest_path_length(trade(spark, d))
    return _row(spark, average=v if math.isinf(v) else round(v, 6))


@query(TRADE + ", p AS (SELECT [src, dst] AS path, dst FROM e WHERE src = 0 UNION ALL SELECT list_append(path, e.dst), e.dst FROM p JOIN e ON p.dst = e.src WHERE len(path) < 3 AND NOT list_contains(path, e.dst)) SELECT array_to_string(path, '-') AS path FROM p WHERE dst = 3")
def all_simple_paths(spark, d):
    return P.all_simple_paths(trade(spark, d), 0, 3, cutoff=3).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@query(TRADE + HOPS + " SELECT t IS NOT NULL AS found FROM (SELECT max(t) AS t FROM dist WHERE s = 0 AND t = 7)")
def has_path(spark, d):
    return _row(spark, found=P.has_path(trade(spark, d), 0, 7))


# --- traversal and connectivity ----------------------------------------------------------------


@query(TRADE + HOPS + " SELECT d AS layer, t AS id FROM dist WHERE s = 0")
def bfs_layers(spark, d):
    return T.bfs_layers(trade(spark, d), [0])


@query(TREE + ", r AS (SELECT dst AS id FROM e WHERE src = 1 UNION SELECT e.dst FROM r JOIN e ON r.id = e.src) SELECT id FROM r")
def descendants(spark, d):
    return T.descendants(tree(spark, d), 1)


@query(TREE + ", r AS (SELECT src AS id FROM e WHERE dst = 1000000001 UNION SELECT e.src FROM r JOIN e ON r.id = e.dst) SELECT id FROM r")
def ancestors(spark, d):
    return T.ancestors(tree(spark, d), 10**9 + 1)


@query(TREE + ", r AS (SELECT id, id AS c FROM v WHERE id < 100 UNION ALL SELECT e.dst, r.c FROM r JOIN e ON e.src = r.id) SELECT id, c AS component FROM r")
def connected_components(spark, d):
    return Co.connected_components(tree(spark, d))


@query(CHAINS + ", s AS (SELECT v.id FROM v WHERE v.id NOT IN (SELECT dst FROM e)) SELECT count(*)::BIGINT AS n FROM s")
def number_weakly_connected_components(spark, d):
    return _row(spark, n=Co.number_weakly_connected_components(chains(spark, d)))


@query(TRADE + HOPS + " SELECT x.s AS id, min(x.t) AS component FROM dist x JOIN dist y ON x.s = y.t AND x.t = y.s GROUP BY x.s")
def strongly_connected_components(spark, d):
    return Co.strongly_connected_components(trade(spark, d))


@query(TRADE + HOPS + ", c AS (SELECT x.s AS id, min(x.t) AS c FROM dist x JOIN dist y ON x.s = y.t AND x.t = y.s GROUP BY x.s), b AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS b FROM (SELECT DISTINCT c FROM c)) SELECT DISTINCT p.b AS src, q.b AS dst FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst JOIN b p ON p.c = x.c JOIN b q ON q.c = y.c WHERE p.b <> q.b")
def condensation(spark, d):
    return Co.condensation(trade(spark, d))[0].edge_list()


@query(CHAINS + " SELECT id FROM v WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")
def isolates(spark, d):
    return Co.isolates(chains(spark, d))


@query(TRADE + " SELECT i.id AS src, j.id AS dst FROM v i JOIN v j ON i.id <> j.id WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = i.id AND dst = j.id)")
def complement(spark, d):
    return Co.complement(trade(spark, d)).edge_list()


@query(SUPPLY + " SELECT true AS bipartite")
def is_bipartite(spark, d):
    return _row(spark, bipartite=Co.is_bipartite(supply(spark, d)))


@query(TREE + " SELECT DISTINCT src AS id FROM e WHERE src >= 100 OR (SELECT count(*) FROM e x WHERE x.src = e.src) > 1")
def articulation_points(spark, d):
    return Co.articulation_points(tree(spark, d))


@query(TREE + " SELECT src, dst FROM e")
def bridges(spark, d):
    return Co.bridges(tree(spark, d))


@query(TREE + " SELECT true AS planar")
def is_planar(spark, d):
    return _row(spark, planar=Co.is_planar(tree(spark, d)))


# --- acyclic graphs ----------------------------------------------------------------------------


@query(CHAINS + ", r AS (SELECT id, 0::BIGINT AS g FROM v WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, g + 1 FROM r JOIN e ON e.src = r.id) SELECT g AS generation, id FROM r")
def topological_generations(spark, d):
    return D.topological_generations(chains(spark, d))


@query(CHAINS + ", r AS (SELECT id, 0::BIGINT AS g FROM v WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, g + 1 FROM r JOIN e ON e.src = r.id) SELECT row_number() OVER (ORDER BY g, id) - 1 AS pos, id FROM r")
def topological_sort(spark, d):
    return D.topological_sort(chains(spark, d))


@query(CHAINS + ", r AS (SELECT id, 0::BIGINT AS g FROM v WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, g + 1 FROM r JOIN e ON e.src = r.id) SELECT max(g) AS n FROM r")
def dag_longest_path_length(spark, d):
    return _row(spark, n=D.dag_longest_path_length(chains(spark, d)))


@query(TREE + " SELECT true AS acyclic")
def is_directed_acyclic_graph(spark, d):
    return _row(spark, acyclic=D.is_directed_acyclic_graph(tree(spark, d)))


@query(TREE + ", c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c")
def transitive_closure(spark, d):
    return D.transitive_closure(tree(spark, d))


@query(TREE + ", r AS (SELECT 1::BIGINT AS id, 1::BIGINT AS idom UNION SELECT e.dst, e.src FROM r JOIN e ON r.id = e.src) SELECT id, idom FROM r")
def immediate_dominators(spark, d):
    return D.immediate_dominators(tree(spark, d), 1)


@query(CHAINS + ", r AS (SELECT id, id AS h, 1::BIGINT AS n FROM v WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, h, n + 1 FROM r JOIN e ON e.src = r.id) SELECT h AS head, max(n) AS n FROM r GROUP BY h")
def collect_runs(spark, d):
    return D.collect_runs(chains(spark, d), "true").select(F.element_at("run", 1).alias("head"), F.size("run").cast("bigint").alias("n"))


# --- trees, matching, colouring ----------------------------------------------------------------


@query(TRADE + """, u AS (SELECT *, row_number() OVER (ORDER BY w, eid) AS k FROM e),
f AS (SELECT 0 AS k, id, id AS c FROM v UNION ALL SELECT f.k + 1, f.id, CASE WHEN f.c = greatest(x.c, y.c) THEN least(x.c, y.c) ELSE f.c END FROM f JOIN u ON u.k = f.k + 1 JOIN f x ON x.id = u.src JOIN f y ON y.id = u.dst)
SELECT u.eid, u.src, u.dst, u.w::DOUBLE AS w FROM u JOIN f x ON x.k = u.k - 1 AND x.id = u.src JOIN f y ON y.k = u.k - 1 AND y.id = u.dst WHERE x.c <> y.c""")
def minimum_spanning_edges(spark, d):
    return Tr.minimum_spanning_edges(trade(spark, d, False), "payload")


@query(TREE + ", r AS (SELECT id, 0 AS g FROM v WHERE id < 100 UNION ALL SELECT e.dst, g + 1 FROM r JOIN e ON e.src = r.id) SELECT id, (1 - g % 2)::BIGINT AS color FROM r")
def two_color(spark, d):
    return Col.two_color(tree(spark, d).with_(directed=False))


# --- products, matching of patterns, matrices --------------------------------------------------


@query(TRADE + " SELECT x * 25 + src AS src, x * 25 + dst AS dst FROM e CROSS JOIN range(2) t(x) UNION ALL SELECT id, 25 + id FROM v")
def cartesian_product(spark, d):
    return Pr.cartesian_product(G.directed_path_graph(spark, 2).with_(E=G.directed_path_graph(spark, 2).E.withColumn("payload", F.lit(0).cast("bigint"))), trade(spark, d))[0].edge_list()


@query(TRADE + " SELECT src, 25 + dst AS dst FROM e")
def tensor_product(spark, d):
    return Pr.tensor_product(G.directed_path_graph(spark, 2), trade(spark, d))[0].edge_list()


@query(TRADE + ", n AS (SELECT eid, src AS x FROM e UNION ALL SELECT eid, dst FROM e) SELECT p.eid AS src, q.eid AS dst FROM n p JOIN n q ON p.x = q.x AND p.eid < q.eid")
def line_graph(spark, d):
    return Pr.line_graph(trade(spark, d, False))[0].edge_list()


@query(TRADE + " SELECT src, dst FROM e UNION ALL SELECT src, dst FROM e WHERE false")
def union(spark, d):
    g = trade(spark, d)
    return Pr.union(g, g, True, True).edge_list()


@query(TRADE + " SELECT src AS i, dst AS j, w::DOUBLE AS value FROM e")
def adjacency_matrix(spark, d):
    return Pr.adjacency_matrix(trade(spark, d), "payload")


@query(TRADE + " SELECT x.src AS v0, y.src AS v1, z.src AS v2 FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src")
def find_pattern(spark, d):
    return Pr.find_pattern(trade(spark, d), G.directed_cycle_graph(spark, 3)).select("v0", "v1", "v2")


@query(CHAINS + ", r AS (SELECT id, 0::BIGINT AS g FROM v WHERE id NOT IN (SELECT src FROM e) UNION ALL SELECT e.src, g + 1 FROM r JOIN e ON e.dst = r.id) SELECT min(id) OVER (PARTITION BY g) AS block, id FROM r")
def digraph_maximum_bisimulation(spark, d):
    return Pr.digraph_maximum_bisimulation(chains(spark, d))


# --- the graph value ---------------------------------------------------------------------------


@query(TRADE + " SELECT DISTINCT dst AS id FROM e WHERE src = 0")
def neighbors(spark, d):
    return trade(spark, d).neighbors(0)


@query(TRADE + " SELECT eid FROM e WHERE w > 1000")
def filter_edges(spark, d):
    return trade(spark, d).filter_edges("payload > 1000")


@query(TRADE + " SELECT src, dst FROM e WHERE src NOT IN (1, 2) AND dst NOT IN (1, 2)")
def remove_nodes_from(spark, d):
    return trade(spark, d).remove_nodes_from([1, 2]).edge_list()


@query(TRADE + ", m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM v WHERE id % 2 = 0) SELECT x.n AS src, y.n AS dst FROM e JOIN m x ON x.id = src JOIN m y ON y.id = dst")
def subgraph(spark, d):
    g = trade(spark, d)
    return g.subgraph(g.V.where("id % 2 = 0")).edge_list()


@query(TRADE + " SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w)::BIGINT AS payload FROM e GROUP BY 1, 2")
def to_undirected(spark, d):
    return trade(spark, d).to_undirected(False, "sum(payload)").weighted_edge_list()


@query(TRADE + ", c AS (SELECT CASE WHEN src IN (1, 2, 3) THEN 25 ELSE src END AS src, CASE WHEN dst IN (1, 2, 3) THEN 25 ELSE dst END AS dst, w FROM e WHERE NOT (src IN (1, 2, 3) AND dst IN (1, 2, 3))) SELECT src, dst, sum(w)::BIGINT AS payload FROM c GROUP BY 1, 2")
def contract_nodes(spark, d):
    return trade(spark, d).contract_nodes([1, 2, 3], "merged", "sum(payload)")[0].weighted_edge_list()


@query(TRADE + " SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def make_symmetric(spark, d):
    return trade(spark, d).make_symmetric().edge_list()


@query(TRADE + " SELECT dst AS src, src AS dst FROM e")
def reverse(spark, d):
    return trade(spark, d).reverse().edge_list()


@query(TRADE + " SELECT count(*)::BIGINT AS n FROM (SELECT src, dst FROM e WHERE src <> 4 AND dst <> 4 UNION ALL SELECT i.src, o.dst FROM e i JOIN e o ON i.dst = 4 AND o.src = 4)")
def remove_node_retain_edges(spark, d):
    return _row(spark, n=trade(spark, d).remove_node_retain_edges(4).num_edges())


# --- generators, layouts, files ----------------------------------------------------------------


@query(GROWN + " SELECT i AS src, j AS dst FROM a JOIN b ON i < j")
def complete_graph(spark, d):
    return G.complete_graph(spark, grown(spark, d)).edge_list()


@query(GROWN + " SELECT i AS src, i + 1 AS dst FROM a, n WHERE i + 1 < n")
def path_graph(spark, d):
    return G.path_graph(spark, grown(spark, d)).edge_list()


@query(GROWN + " SELECT i AS src, (i + 1) % n AS dst FROM a, n")
def cycle_graph(spark, d):
    return G.cycle_graph(spark, grown(spark, d)).edge_list()


@query(GROWN + " SELECT 0::BIGINT AS src, i AS dst FROM a WHERE i > 0")
def star_graph(spark, d):
    return G.star_graph(spark, grown(spark, d)).edge_list()


@query(GROWN + ", r AS (SELECT unnest(range(k)) AS r, k FROM (SELECT count(*) AS k FROM nation)) SELECT r * n + i AS src, (r + 1) * n + i AS dst FROM a, n, r WHERE r + 1 < k UNION ALL SELECT r * n + i, r * n + i + 1 FROM a, n, r WHERE i + 1 < n")
def grid_graph(spark, d):
    return G.grid_graph(spark, grown(spark, d, "nation"), grown(spark, d)).edge_list()


@query(GROWN + " SELECT i - (1 << floor(log2(i))::INT) AS src, i AS dst FROM (SELECT unnest(range(1, 1 << k)) AS i FROM (SELECT floor(log2(n))::INT + 1 AS k FROM n))")
def binomial_tree_graph(spark, d):
    return G.binomial_tree_graph(spark, grown(spark, d).bit_length()).edge_list()


@query(GROWN + " SELECT (i - 1) // 3 AS src, i AS dst FROM a WHERE i > 0")
def full_rary_tree(spark, d):
    return G.full_rary_tree(spark, 3, grown(spark, d)).edge_list()


@query(GROWN + " SELECT i AS src, (i + 3) % n AS dst FROM a, n UNION ALL SELECT i + n, (i + 1) % n + n FROM a, n UNION ALL SELECT i + n, i FROM a, n")
def generalized_petersen_graph(spark, d):
    return G.generalized_petersen_graph(spark, grown(spark, d), 3).edge_list()


@query("SELECT 34::BIGINT AS nodes, 78::BIGINT AS edges, 231.0::DOUBLE AS weight")
def karate_club_graph(spark, d):
    g = G.karate_club_graph(spark)
    return _row(spark, nodes=g.num_nodes(), edges=g.num_edges(), weight=g.E.agg(F.sum("payload")).head()[0])


@query(TRADE + " SELECT id, round(cos(2 * pi() * id / 25), 6) + 0.0 AS x, round(sin(2 * pi() * id / 25), 6) + 0.0 AS y FROM v")
def circular_layout(spark, d):
    return L.circular_layout(trade(spark, d)).select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query(TRADE + " SELECT src, dst FROM e")
def node_link_round_trip(spark, d):
    return Fi.parse_node_link_json(spark, Fi.node_link_json(trade(spark, d))).edge_list()


@query(TRADE + " SELECT src, dst FROM e")
def matrix_market_round_trip(spark, d):
    return Fi.read_matrix_market(spark, Fi.write_matrix_market(trade(spark, d))).edge_list()


@query(TRADE + " SELECT src, dst FROM e")
def dot_round_trip(spark, d):
    g = trade(spark, d)
    back = Fi.from_dot(spark, Fi.to_dot(g))
    names = back.V.select("id", F.col("payload")["label"].cast("bigint").alias("name"))
    return back.E.join(names.select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("t")), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


def queries():
    from weftgraph.plans import further_queries, large_queries, more_queries  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(ORACLE)
