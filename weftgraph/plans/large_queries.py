"""Registered queries over graphs that grow with the tables and that no single task holds.

``market``: regions, nations, their customers and suppliers, and the parts that suppliers ship (undirected).
``flow``: parts and suppliers; an arc to the supplier where a line item came back, or is open at an odd place of its order,
from it otherwise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import coloring as Col
from weftgraph.operators import components as Co
from weftgraph.operators import dag as D
from weftgraph.operators import products as Pr
from weftgraph.operators import trees as Tr
from weftgraph.plans.fixpoint import written
from weftgraph.plans.queries import TREE, _row, query, read, tree

#: Where the ids of suppliers, customers, nations and regions begin; parts keep their keys.
SUPPLIER, CUSTOMER, NATION, REGION = (k * 10**9 for k in (1, 2, 3, 4))


def market(spark, d):
    def hung(table, key, at, parent, up):
        rows = read(spark, d, table).select((F.col(key).cast("bigint") + at).alias("src"), (F.col(parent).cast("bigint") + up).alias("dst"))
        return rows.select((-F.col("src")).alias("eid"), "src", "dst")

    shipped = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER).alias("dst")).distinct()
    E = shipped.select((F.col("src") * 10**10 + F.col("dst")).alias("eid"), "src", "dst")
    E = E.union(hung("supplier", "s_suppkey", SUPPLIER, "s_nationkey", NATION)).union(hung("customer", "c_custkey", CUSTOMER, "c_nationkey", NATION)).union(hung("nation", "n_nationkey", NATION, "n_regionkey", REGION))
    g = Graph.from_edges(written(E.withColumn("payload", F.lit(1.0))))  # vertices come from the table of edges, not from line items again
    return g.with_(V=written(g.V))


MARKET = f"""WITH RECURSIVE e AS (SELECT src * 10000000000 + dst AS eid, src, dst FROM (SELECT DISTINCT l_partkey AS src, l_suppkey + {SUPPLIER} AS dst FROM lineitem)
UNION ALL SELECT -({SUPPLIER} + s_suppkey), {SUPPLIER} + s_suppkey, {NATION} + s_nationkey FROM supplier UNION ALL SELECT -({CUSTOMER} + c_custkey), {CUSTOMER} + c_custkey, {NATION} + c_nationkey FROM customer
UNION ALL SELECT -({NATION} + n_nationkey), {NATION} + n_nationkey, {REGION} + n_regionkey FROM nation),
ends AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e), deg AS (SELECT id, count(*) AS n FROM ends GROUP BY id),
leaf AS (SELECT e.* FROM e JOIN deg a ON a.id = src JOIN deg b ON b.id = dst WHERE a.n = 1 OR b.n = 1)"""


def flow(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_suppkey") + SUPPLIER).alias("supplier"), "l_returnflag", "l_linenumber")
    up = "l_returnflag = 'R' OR l_returnflag = 'N' AND l_linenumber % 2 = 1"
    E = li.where(up).select(F.col("part").alias("src"), F.col("supplier").alias("dst")).union(li.where(f"NOT ({up})").select("supplier", "part")).distinct()
    V = li.select(F.col("part").alias("id")).union(li.select("supplier")).distinct()
    return Graph.from_edges(E.select(F.xxhash64("src", "dst").alias("eid"), "src", "dst", F.lit(1.0).alias("payload")), V, directed=True).cached()


FLOW = f"""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + {SUPPLIER} AS dst FROM lineitem WHERE l_returnflag = 'R' OR l_returnflag = 'N' AND l_linenumber % 2 = 1 UNION SELECT DISTINCT l_suppkey + {SUPPLIER}, l_partkey FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_returnflag = 'N' AND l_linenumber % 2 = 1)),
v AS (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey + {SUPPLIER} FROM lineitem),
start AS (SELECT min(id) AS id FROM v WHERE id IN (SELECT src FROM e) AND id IN (SELECT dst FROM e)),
fwd AS (SELECT id FROM start UNION SELECT dst FROM fwd JOIN e ON src = fwd.id), bwd AS (SELECT id FROM start UNION SELECT src FROM bwd JOIN e ON dst = bwd.id),
core AS (SELECT id FROM fwd INTERSECT SELECT id FROM bwd), scc AS (SELECT id, CASE WHEN id IN (SELECT id FROM core) THEN (SELECT min(id) FROM core) ELSE id END AS component FROM v)"""


# only a leaf's edge is a bridge here: the rest of the market hangs together twice


@query(MARKET + " SELECT src, dst FROM leaf")
def market_bridges(spark, d):
    return Co.bridges(market(spark, d))


@query(MARKET + " SELECT DISTINCT deg.id FROM leaf JOIN deg ON deg.id IN (src, dst) WHERE n > 1")
def market_articulation_points(spark, d):
    return Co.articulation_points(market(spark, d))


@query(MARKET + " SELECT src, dst, CASE WHEN eid IN (SELECT eid FROM leaf) THEN eid ELSE (SELECT min(eid) FROM e WHERE eid NOT IN (SELECT eid FROM leaf)) END AS comp FROM e")
def market_biconnected_components(spark, d):
    return Co.biconnected_components(market(spark, d))


@query(MARKET + """, adj AS (SELECT src AS id, dst AS other FROM e UNION ALL SELECT dst, src FROM e),
before AS (SELECT adj.id, other FROM adj JOIN deg x ON x.id = adj.id JOIN deg y ON y.id = other WHERE y.n > x.n OR y.n = x.n AND other < adj.id),
r AS (SELECT 0 AS k, id, NULL::BIGINT AS color FROM deg UNION ALL
SELECT k + 1, id, CASE WHEN color IS NOT NULL THEN color WHEN told = given THEN list_min([x for x in range(len(seen) + 1) if NOT list_contains(seen, x)]) END
FROM (SELECT r.k, r.id, r.color, count(b.other) AS told, count(p.color) AS given, coalesce(list(DISTINCT p.color) FILTER (WHERE p.color IS NOT NULL), []) AS seen FROM r LEFT JOIN before b ON b.id = r.id LEFT JOIN r p ON p.id = b.other
WHERE EXISTS (SELECT 1 FROM r WHERE color IS NULL) GROUP BY r.k, r.id, r.color))
SELECT id, color FROM r WHERE k = (SELECT max(k) FROM r)""")
def market_greedy_color(spark, d):
    """By falling degree, then id, each vertex takes the least colour that no neighbour before it has."""
    return Col.greedy_color(market(spark, d))


@query(MARKET + " SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM deg) + 1 AS cycles, true AS closed")
def market_cycle_basis(spark, d):
    """As many cycles as edges outside a spanning tree; each a closed walk along edges without a repeated vertex."""
    g = market(spark, d)
    found = Co.cycle_basis(g).select(F.monotonically_increasing_id().alias("k"), "cycle")
    found = written(found)
    steps = found.select("k", "cycle", F.posexplode("cycle").alias("i", "a")).select("a", F.expr("cycle[(i + 1) % size(cycle)]").alias("b"))
    known = g.E.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    bad = steps.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).join(known, ["x", "y"], "left_anti")
    twice = found.where(F.size(F.array_distinct("cycle")) < F.size("cycle"))
    return _row(spark, cycles=found.count(), closed=bad.isEmpty() and twice.isEmpty())


@query(FLOW + " SELECT id, component FROM scc")
def flow_strong_components(spark, d):
    return Co.strongly_connected_components(flow(spark, d))


@query(FLOW + " SELECT count(DISTINCT component) AS n FROM scc")
def flow_number_of_strong_components(spark, d):
    return _row(spark, n=Co.number_strongly_connected_components(flow(spark, d)))


@query(TREE + " SELECT r.src AS a, r.dst AS b, (SELECT min(dst) FROM e WHERE src = r.dst) AS c FROM e r WHERE r.dst = (SELECT src FROM e WHERE dst = (SELECT min(dst) FROM e WHERE src >= 100))")
def tree_longest_path(spark, d):
    """Region, nation and the least customer or supplier: the first of the paths of greatest length."""
    a, b, c = D.dag_longest_path(tree(spark, d).cached())
    return _row(spark, a=a, b=b, c=c)


@query(MARKET + " SELECT count(*) - 1 AS edges FROM deg")
def market_spanning_edges(spark, d):
    return _row(spark, edges=Tr.minimum_spanning_edges(market(spark, d)).count())


@query(MARKET + f""", w AS (SELECT l_partkey AS src, l_suppkey + {SUPPLIER} AS dst, sum(l_quantity)::BIGINT AS w FROM lineitem GROUP BY 1, 2),
ws AS (SELECT src AS id, w FROM w UNION ALL SELECT dst, w FROM w) SELECT min(n)::DOUBLE AS value FROM (SELECT sum(w) AS n FROM ws WHERE id < {SUPPLIER} GROUP BY id)""")
def market_minimum_cut(spark, d):
    """Edges carry the quantity shipped, those of nations and regions more than any cut through a part; the lightest cut
    sets the part apart that was shipped least."""
    shipped = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER).alias("dst")).agg(F.sum("l_quantity").cast("double").alias("w"))
    g = market(spark, d)
    E = g.E.join(shipped, ["src", "dst"], "left").select("eid", "src", "dst", F.coalesce("w", F.lit(1e6)).alias("payload"))
    return _row(spark, value=Co.stoer_wagner_min_cut(g.with_(E=E).cached(), "payload")[0])


@query(MARKET + " SELECT id, id + 5000000000 AS other FROM deg")
def market_isomorphism(spark, d):
    """To itself under other ids. Parts, suppliers and nations differ by their neighbours; customers of a nation go by rank."""
    g = market(spark, d)
    moved = lambda c: (F.col(c) + 5 * 10**9).alias(c)
    h = g.with_(g.V.select(moved("id"), "payload"), g.E.select("eid", moved("dst").alias("src"), moved("src").alias("dst"), "payload"))
    return Pr.isomorphism(g, h.cached())


@query(TREE + """, n AS (SELECT id, coalesce(min(dst), id) AS head FROM v LEFT JOIN e ON src = id WHERE id BETWEEN 100 AND 999999999 GROUP BY id),
r AS (SELECT e.src AS id, min(head) AS head FROM e JOIN n ON n.id = e.dst GROUP BY 1)
SELECT head, id FROM n UNION ALL SELECT head, id FROM r UNION ALL SELECT id, id FROM v WHERE id >= 1000000000""")
def tree_run_members(spark, d):
    """Of the tree turned round: from a nation's least customer or supplier, and on to the region from the least of its nations."""
    g = tree(spark, d)
    up = g.with_(E=g.E.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "payload"))
    return D.run_members(up.cached(), "true").select("head", "id")
