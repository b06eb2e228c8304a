"""The graph value: two DataFrames.

``V(id bigint, payload)`` and ``E(eid bigint, src bigint, dst bigint, payload)``. Every method is a
DataFrame plan; methods that change a graph return a new one. Only single payloads, degrees and
flags come back as Python values. Ids are kept through deletions and are not reused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.errors import DAGHasCycle, DAGWouldCycle, NoEdgeBetweenNodes, NoSuitableNeighbors
from weftgraph.session import ship

Weight = str | Column | Callable[[Any], float] | None


def condition(pred, payload: Column, returns: str = "boolean") -> Column:
    """A Column from a Column, an SQL expression over the row, or a Python callable of the payload."""
    if isinstance(pred, Column):
        return pred
    if isinstance(pred, str):
        return F.expr(pred)
    return F.udf(pred, returns, useArrow=True)(payload)


def weight_column(fn: Weight, default: float = 1.0, returns: str = "double") -> Column:
    if fn is None:
        return F.lit(default).cast(returns)
    return condition(fn, F.col("payload"), returns).cast(returns)


class Graph:
    def __init__(self, V: DataFrame, E: DataFrame, directed: bool = False, multigraph: bool = True, attrs: Any = None, check_cycle: bool = False):
        ship(V.sparkSession)
        self.V, self.E = V, E
        self.directed, self.is_multigraph, self.attrs, self._check_cycle = directed, multigraph, attrs, check_cycle

    # construction ------------------------------------------------------------------------------

    @classmethod
    def empty(cls, spark: SparkSession, directed: bool = False, node_type: str = "string", edge_type: str = "string", **kw) -> Graph:
        return cls(spark.createDataFrame([], f"id bigint, payload {node_type}"), spark.createDataFrame([], f"eid bigint, src bigint, dst bigint, payload {edge_type}"), directed, **kw)

    @classmethod
    def from_edges(cls, E: DataFrame, V: DataFrame | None = None, directed: bool = False, multigraph: bool = True, **kw) -> Graph:
        """From ``E(src, dst[, payload][, eid])``; vertices default to the endpoints. Without ``multigraph``
        the payload of the greatest edge id wins among parallel edges, under the least id."""
        E = E.withColumns({"src": F.col("src").cast("bigint"), "dst": F.col("dst").cast("bigint")})
        if "payload" not in E.columns:
            E = E.withColumn("payload", F.lit(None).cast("double"))
        if "eid" not in E.columns:
            E = number(E.select("src", "dst", "payload"), "eid", ["src", "dst", "payload"])
        E = E.select("eid", "src", "dst", "payload")
        if not multigraph:
            ends = ["src", "dst"] if directed else [F.least("src", "dst"), F.greatest("src", "dst")]
            E = E.groupBy(*ends).agg(F.min("eid").alias("eid"), F.min_by("src", "eid").alias("s"), F.min_by("dst", "eid").alias("t"), F.max_by("payload", "eid").alias("payload"))
            E = E.select("eid", F.col("s").alias("src"), F.col("t").alias("dst"), "payload")
        if V is None:
            V = E.select(F.col("src").alias("id")).union(E.select("dst")).distinct().withColumn("payload", F.lit(None).cast("string"))
        if "payload" not in V.columns:
            V = V.withColumn("payload", F.lit(None).cast("string"))
        return cls(V.select(F.col("id").cast("bigint").alias("id"), "payload"), E, directed, multigraph, **kw)

    def with_(self, V: DataFrame | None = None, E: DataFrame | None = None, **kw) -> Graph:
        args = {"directed": self.directed, "multigraph": self.is_multigraph, "attrs": self.attrs, "check_cycle": self._check_cycle} | kw
        return Graph(self.V if V is None else V, self.E if E is None else E, **args)

    @property
    def spark(self) -> SparkSession:
        return self.V.sparkSession

    def cached(self) -> Graph:
        from weftgraph.plans.fixpoint import written

        return self.with_(written(self.V), written(self.E))

    def save(self, path: str) -> None:
        """Parquet tables that keep ids and holes, and the graph's settings."""
        import json

        self.V.write.parquet(f"{path}/V")
        self.E.write.parquet(f"{path}/E")
        conf = json.dumps({"directed": self.directed, "multigraph": self.is_multigraph, "attrs": self.attrs, "check_cycle": self._check_cycle})
        self.spark.createDataFrame([(conf,)], "conf string").coalesce(1).write.parquet(f"{path}/conf")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        import json

        conf = json.loads(spark.read.parquet(f"{path}/conf").head()[0])
        return cls(spark.read.parquet(f"{path}/V"), spark.read.parquet(f"{path}/E"), **conf)

    # settings and size -------------------------------------------------------------------------

    @property
    def multigraph(self) -> bool:
        return self.is_multigraph

    @property
    def check_cycle(self) -> bool:
        return self._check_cycle

    def set_check_cycle(self, value: bool) -> Graph:
        from weftgraph.operators.dag import is_directed_acyclic_graph

        if value and not is_directed_acyclic_graph(self):
            raise DAGHasCycle("the graph has a cycle")
        return self.with_(check_cycle=value)

    def num_nodes(self) -> int:
        return self.V.count()

    def num_edges(self) -> int:
        return self.E.count()

    __len__ = num_nodes

    def clear(self) -> Graph:
        return self.with_(self.V.limit(0), self.E.limit(0))

    def clear_edges(self) -> Graph:
        return self.with_(E=self.E.limit(0))

    def copy(self) -> Graph:
        return self.with_()

    def has_parallel_edges(self) -> bool:
        if not self.is_multigraph:
            return False
        ends = ["src", "dst"] if self.directed else [F.least("src", "dst"), F.greatest("src", "dst")]
        return not self.E.groupBy(*ends).count().where("count > 1").isEmpty()

    # scans and lookups -------------------------------------------------------------------------

    def nodes(self) -> DataFrame:
        return self.V.orderBy("id").select("payload")

    def edges(self) -> DataFrame:
        return self.E.orderBy("eid").select("payload")

    def node_indices(self) -> DataFrame:
        return self.V.select("id")

    node_indexes = node_indices

    def edge_indices(self) -> DataFrame:
        return self.E.select("eid")

    def between(self, a: int, b: int) -> DataFrame:
        there = (F.col("src") == a) & (F.col("dst") == b)
        return self.E.where(there if self.directed else there | ((F.col("src") == b) & (F.col("dst") == a)))

    def edge_indices_from_endpoints(self, a: int, b: int) -> DataFrame:
        return self.between(a, b).select("eid")

    def has_node(self, node: int) -> bool:
        return not self.V.where(F.col("id") == node).isEmpty()

    def has_edge(self, a: int, b: int) -> bool:
        return not self.between(a, b).isEmpty()

    def _one(self, df: DataFrame, column: str, error: Exception):
        row = df.select(column).head()
        if row is None:
            raise error
        return row[0]

    def get_edge_data(self, a: int, b: int):
        return self._one(self.between(a, b).orderBy(F.desc("eid")), "payload", NoEdgeBetweenNodes(f"no edge between {a} and {b}"))

    def get_edge_data_by_index(self, eid: int):
        return self._one(self.E.where(F.col("eid") == eid), "payload", IndexError(f"no edge {eid}"))

    def get_edge_endpoints_by_index(self, eid: int) -> tuple[int, int]:
        row = self.E.where(F.col("eid") == eid).select("src", "dst").head()
        if row is None:
            raise IndexError(f"no edge {eid}")
        return row[0], row[1]

    def get_node_data(self, node: int):
        return self._one(self.V.where(F.col("id") == node), "payload", IndexError(f"no node {node}"))

    __getitem__ = get_node_data

    def get_all_edge_data(self, a: int, b: int) -> DataFrame:
        found = self.between(a, b).select("eid", "payload")
        if found.isEmpty():
            raise NoEdgeBetweenNodes(f"no edge between {a} and {b}")
        return found

    def edge_list(self) -> DataFrame:
        return self.E.select("src", "dst")

    def weighted_edge_list(self) -> DataFrame:
        return self.E.select("src", "dst", "payload")

    def edge_index_map(self) -> DataFrame:
        return self.E.select("eid", "src", "dst", "payload")

    def find_node_by_weight(self, obj) -> int | None:
        return self.V.where(F.col("payload").eqNullSafe(F.lit(obj))).agg(F.min("id")).head()[0]

    # neighbourhoods ----------------------------------------------------------------------------

    def arcs(self, undirected: bool | None = None) -> DataFrame:
        """Edges in each direction in which they can be walked (eid, src, dst, payload); an undirected self-loop once."""
        if self.directed and not undirected:
            return self.E
        return self.E.union(self.E.where("src != dst").select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "payload"))

    def reversed_arcs(self) -> DataFrame:
        return self.arcs().select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "payload")

    def successor_indices(self, node: int) -> DataFrame:
        return self.arcs().where(F.col("src") == node).select(F.col("dst").alias("id"))

    def predecessor_indices(self, node: int) -> DataFrame:
        return self.reversed_arcs().where(F.col("src") == node).select(F.col("dst").alias("id"))

    def neighbors(self, node: int) -> DataFrame:
        return self.successor_indices(node).distinct()

    def neighbors_undirected(self, node: int) -> DataFrame:
        return self.arcs(True).where(F.col("src") == node).select(F.col("dst").alias("id")).distinct()

    def successors(self, node: int) -> DataFrame:
        return self.V.join(self.neighbors(node), "id", "left_semi")

    def predecessors(self, node: int) -> DataFrame:
        return self.V.join(self.predecessor_indices(node), "id", "left_semi")

    def adj(self, node: int) -> DataFrame:
        return self.arcs(True).where(F.col("src") == node).groupBy(F.col("dst").alias("id")).agg(F.max_by("payload", "eid").alias("payload"))

    def adj_direction(self, node: int, incoming: bool) -> DataFrame:
        arcs = self.reversed_arcs() if incoming else self.arcs()
        return arcs.where(F.col("src") == node).groupBy(F.col("dst").alias("id")).agg(F.max_by("payload", "eid").alias("payload"))

    def out_edges(self, node: int) -> DataFrame:
        return self.arcs().where(F.col("src") == node).select("src", "dst", "payload")

    def in_edges(self, node: int) -> DataFrame:
        return self.reversed_arcs().where(F.col("src") == node).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "payload")

    def incident_edge_index_map(self, node: int, all_edges: bool = False) -> DataFrame:
        arcs = self.E.where((F.col("src") == node) | (F.col("dst") == node)) if all_edges and self.directed else self.arcs().where(F.col("src") == node)
        return arcs.select("eid", "src", "dst", "payload")

    def incident_edges(self, node: int, all_edges: bool = False) -> DataFrame:
        return self.incident_edge_index_map(node, all_edges).select("eid")

    def in_edge_indices(self, node: int) -> DataFrame:
        return self.reversed_arcs().where(F.col("src") == node).select("eid")

    def out_edge_indices(self, node: int) -> DataFrame:
        return self.arcs().where(F.col("src") == node).select("eid")

    def in_degree(self, node: int) -> int:
        return self.E.where(F.col("dst") == node).count()

    def out_degree(self, node: int) -> int:
        return self.E.where(F.col("src") == node).count()

    def degree(self, node: int) -> int:
        return self.in_degree(node) + self.out_degree(node)

    def degrees(self) -> DataFrame:
        """id, in_degree, out_degree, degree of every vertex; one shuffle of partial counts."""
        ends = self.E.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.E.select("dst", F.lit(0), F.lit(1)))
        ends = ends.union(self.V.select("id", F.lit(0), F.lit(0)))
        d = ends.groupBy("id").agg(F.sum("i").cast("bigint").alias("in_degree"), F.sum("o").cast("bigint").alias("out_degree"))
        return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))

    def find_successors_by_edge(self, node: int, pred) -> DataFrame:
        ids = self.arcs().where(F.col("src") == node).where(condition(pred, F.col("payload"))).select(F.col("dst").alias("id"))
        return self.V.join(ids, "id", "left_semi")

    def find_predecessors_by_edge(self, node: int, pred) -> DataFrame:
        ids = self.reversed_arcs().where(F.col("src") == node).where(condition(pred, F.col("payload"))).select(F.col("dst").alias("id"))
        return self.V.join(ids, "id", "left_semi")

    def find_successor_node_by_edge(self, node: int, pred):
        return self._one(self.find_successors_by_edge(node, pred).orderBy("id"), "payload", NoSuitableNeighbors("no edge matches"))

    find_adjacent_node_by_edge = find_successor_node_by_edge

    def find_predecessor_node_by_edge(self, node: int, pred):
        return self._one(self.find_predecessors_by_edge(node, pred).orderBy("id"), "payload", NoSuitableNeighbors("no edge matches"))

    def filter_nodes(self, pred) -> DataFrame:
        return self.V.where(condition(pred, F.col("payload"))).select("id")

    def filter_edges(self, pred) -> DataFrame:
        return self.E.where(condition(pred, F.col("payload"))).select("eid")

    # changes -----------------------------------------------------------------------------------

    def _next(self, df: DataFrame, column: str) -> int:
        top = df.agg(F.max(column)).head()[0]
        return 0 if top is None else top + 1

    def _frame(self, rows: list, like: DataFrame) -> DataFrame:
        return self.spark.createDataFrame(rows, like.schema)

    def add_nodes_from(self, payloads: Iterable) -> tuple[Graph, list[int]]:
        payloads, at = list(payloads), self._next(self.V, "id")
        ids = list(range(at, at + len(payloads)))
        new = self._frame(list(zip(ids, payloads, strict=True)), self.V) if ids else self.V.limit(0)
        return self.with_(self.V.unionByName(new)), ids

    def add_node(self, payload) -> tuple[Graph, int]:
        g, ids = self.add_nodes_from([payload])
        return g, ids[0]

    def _require(self, ids: set[int]) -> None:
        have = {r[0] for r in self.V.where(F.col("id").isin(list(ids))).select("id").collect()} if ids else set()
        if ids - have:
            raise IndexError(f"no node {min(ids - have)}")

    def add_edges_from(self, edges: Iterable[tuple]) -> tuple[Graph, list[int]]:
        """(src, dst, payload) rows. Without ``multigraph`` an edge that exists gets the new payload and keeps its id."""
        edges = [tuple(e) for e in edges]
        self._require({x for e in edges for x in e[:2]})
        at, E, ids, new = self._next(self.E, "eid"), self.E, [], []
        have: dict = {}

        def key(a, b):
            return (a, b) if self.directed or a <= b else (b, a)

        if not self.is_multigraph and edges:
            pairs = self._frame([(i, a, b, None) for i, (a, b, _) in enumerate(edges)], self.E).select("src", "dst")
            both = pairs if self.directed else pairs.union(pairs.select("dst", "src"))
            have = {key(r.src, r.dst): r.eid for r in self.E.join(F.broadcast(both.distinct()), ["src", "dst"]).select("eid", "src", "dst").collect()}
        changed: dict = {}
        for a, b, p in edges:
            k = key(a, b)
            if not self.is_multigraph and k in have:
                changed[have[k]] = p
                ids.append(have[k])
                continue
            have[k] = at
            new.append([at, a, b, p])
            ids.append(at)
            at += 1
        new = [(e, a, b, changed.get(e, p)) for e, a, b, p in new]
        old = {e: p for e, p in changed.items() if not any(e == n[0] for n in new)}
        if old:
            upd = self._frame([(e, 0, 0, p) for e, p in old.items()], self.E).select("eid", F.col("payload").alias("p_"), F.lit(True).alias("u_"))
            E = E.join(F.broadcast(upd), "eid", "left").select("eid", "src", "dst", F.when(F.col("u_"), F.col("p_")).otherwise(F.col("payload")).alias("payload"))
        if new:
            E = E.unionByName(self._frame(new, self.E))
        g = self.with_(E=E)
        if self._check_cycle and self.directed:
            from weftgraph.operators.dag import is_directed_acyclic_graph

            if not is_directed_acyclic_graph(g):
                raise DAGWouldCycle("the edges would close a cycle")
        return g, ids

    def add_edges_from_no_data(self, edges: Iterable[tuple]) -> tuple[Graph, list[int]]:
        return self.add_edges_from([(a, b, None) for a, b in edges])

    def add_edge(self, a: int, b: int, payload) -> tuple[Graph, int]:
        g, ids = self.add_edges_from([(a, b, payload)])
        return g, ids[0]

    def extend_from_weighted_edge_list(self, edges: Iterable[tuple]) -> Graph:
        """Adds the vertices that are missing up to the greatest id."""
        edges = list(edges)
        top = max((max(e[:2]) for e in edges), default=-1)
        missing = self.spark.range(top + 1).join(self.V, "id", "left_anti").select("id", F.lit(None).cast(self.V.schema["payload"].dataType).alias("payload"))
        return self.with_(self.V.unionByName(missing)).add_edges_from(edges)[0]

    def extend_from_edge_list(self, edges: Iterable[tuple]) -> Graph:
        return self.extend_from_weighted_edge_list([(a, b, None) for a, b in edges])

    def remove_nodes_from(self, ids: Iterable[int]) -> Graph:
        ids = list(ids)
        out = F.col("src").isin(ids) | F.col("dst").isin(ids) if ids else F.lit(False)
        return self.with_(self.V.where(~F.col("id").isin(ids)) if ids else self.V, self.E.where(~out))

    def remove_node(self, node: int) -> Graph:
        return self.remove_nodes_from([node])

    def without(self, node: int) -> Graph:
        if not self.has_node(node):
            raise IndexError(f"no node {node}")
        return self.remove_node(node)

    delete_node = without

    def remove_edge_from_index(self, eid: int) -> Graph:
        return self.with_(E=self.E.where(F.col("eid") != eid))

    def remove_edges_from(self, pairs: Iterable[tuple[int, int]]) -> Graph:
        """One edge per pair, that of the greatest id; raises where none is left."""
        gone: set[int] = set()
        for a, b in pairs:
            row = self.between(a, b).where(~F.col("eid").isin(list(gone)) if gone else F.lit(True)).agg(F.max("eid")).head()
            if row[0] is None:
                raise NoEdgeBetweenNodes(f"no edge between {a} and {b}")
            gone.add(row[0])
        return self.with_(E=self.E.where(~F.col("eid").isin(list(gone)))) if gone else self

    def remove_edge(self, a: int, b: int) -> Graph:
        return self.remove_edges_from([(a, b)])

    def update_edge_by_index(self, eid: int, payload) -> Graph:
        self.get_edge_endpoints_by_index(eid)
        kind = self.E.schema["payload"].dataType
        return self.with_(E=self.E.withColumn("payload", F.when(F.col("eid") == eid, F.lit(payload).cast(kind)).otherwise(F.col("payload"))))

    def update_edge(self, a: int, b: int, payload) -> Graph:
        eid = self._one(self.between(a, b).orderBy(F.desc("eid")), "eid", NoEdgeBetweenNodes(f"no edge between {a} and {b}"))
        return self.update_edge_by_index(eid, payload)

    def set_node_data(self, node: int, payload) -> Graph:
        self.get_node_data(node)
        kind = self.V.schema["payload"].dataType
        return self.with_(self.V.withColumn("payload", F.when(F.col("id") == node, F.lit(payload).cast(kind)).otherwise(F.col("payload"))))

    update_node = set_node_data

    def add_child(self, parent: int, payload, edge) -> tuple[Graph, int]:
        g, new = self.add_node(payload)
        return g.add_edge(parent, new, edge)[0], new

    def add_parent(self, child: int, payload, edge) -> tuple[Graph, int]:
        g, new = self.add_node(payload)
        return g.add_edge(new, child, edge)[0], new

    def merge_nodes(self, u: int, v: int) -> Graph:
        """If both payloads are equal, u's edges go to v and u goes."""
        if self.get_node_data(u) != self.get_node_data(v):
            return self
        E = self.E.withColumns({c: F.when(F.col(c) == u, F.lit(v).cast("bigint")).otherwise(F.col(c)) for c in ("src", "dst")})
        return self.with_(self.V.where(F.col("id") != u), E)

    def _renumbered(self, E: DataFrame) -> DataFrame:
        return number(E, "eid", ["eid", "src", "dst"])

    def insert_node_on_in_edges_multiple(self, node: int, refs: Iterable[int]) -> Graph:
        refs = list(refs)
        hit = F.col("dst").isin(refs)
        cut = self.E.where(hit)
        E = self.E.where(~hit).unionByName(cut.withColumn("dst", F.lit(node).cast("bigint"))).unionByName(cut.withColumn("src", F.lit(node).cast("bigint")))
        return self.with_(E=self._renumbered(E))

    def insert_node_on_out_edges_multiple(self, node: int, refs: Iterable[int]) -> Graph:
        refs = list(refs)
        hit = F.col("src").isin(refs)
        cut = self.E.where(hit)
        E = self.E.where(~hit).unionByName(cut.withColumn("dst", F.lit(node).cast("bigint"))).unionByName(cut.withColumn("src", F.lit(node).cast("bigint")))
        return self.with_(E=self._renumbered(E))

    def insert_node_on_in_edges(self, node: int, ref: int) -> Graph:
        return self.insert_node_on_in_edges_multiple(node, [ref])

    def insert_node_on_out_edges(self, node: int, ref: int) -> Graph:
        return self.insert_node_on_out_edges_multiple(node, [ref])

    def _retained(self, node: int, pairs: DataFrame) -> Graph:
        """``pairs(src, dst, payload)`` replace the node and its edges."""
        g = self.remove_node(node)
        at = self._next(self.E, "eid")
        new = number(pairs.withColumn("eid", F.lit(0)), "eid", ["src", "dst"]).withColumn("eid", F.col("eid") + at)
        return g.with_(E=g.E.unionByName(new.select("eid", "src", "dst", "payload")))

    def remove_node_retain_edges(self, node: int, use_outgoing: bool = False, condition_: str | None = None) -> Graph:
        """Every in-edge joins every out-edge for which ``condition_`` (SQL over in_payload, out_payload) holds."""
        i = self.E.where((F.col("dst") == node) & (F.col("src") != node)).select("src", F.col("payload").alias("in_payload"))
        o = self.E.where((F.col("src") == node) & (F.col("dst") != node)).select("dst", F.col("payload").alias("out_payload"))
        pairs = i.join(o, F.expr(condition_) if condition_ else F.lit(True))
        return self._retained(node, pairs.select("src", "dst", F.col("out_payload" if use_outgoing else "in_payload").alias("payload")))

    def remove_node_retain_edges_by_key(self, node: int, key: str = "payload", use_outgoing: bool = False) -> Graph:
        """In- and out-edges of an equal key (SQL over the edge) are joined by hash; the first payload of a key stands for it."""
        i = self.E.where((F.col("dst") == node) & (F.col("src") != node)).select("src", F.col("payload").alias("ip"), F.expr(key).alias("k"))
        o = self.E.where((F.col("src") == node) & (F.col("dst") != node)).select("dst", F.col("payload").alias("op"), F.expr(key).alias("k"))
        return self._retained(node, i.join(o, "k").select("src", "dst", F.col("op" if use_outgoing else "ip").alias("payload")))

    def remove_node_retain_edges_by_id(self, node: int) -> Graph:
        """Identity of payload objects means equality here."""
        return self.remove_node_retain_edges_by_key(node)

    def make_symmetric(self, payload: str = "payload") -> Graph:
        back = self.E.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.expr(payload).alias("payload"))
        back = back.join(self.E.select("src", "dst"), ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"])
        at = self._next(self.E, "eid")
        back = number(back.withColumn("eid", F.lit(0)), "eid", ["src", "dst"]).withColumn("eid", F.col("eid") + at)
        return self.with_(E=self.E.unionByName(back.select("eid", "src", "dst", "payload")))

    # transforms --------------------------------------------------------------------------------

    def node_frame(self, nodes) -> DataFrame:
        """Ids as a frame; ``nodes`` may be a DataFrame with ``id`` or Python ids."""
        if isinstance(nodes, DataFrame):
            return nodes.select("id").distinct()
        return self.spark.createDataFrame([(int(n),) for n in dict.fromkeys(nodes)], "id bigint")

    def subgraph_with_nodemap(self, nodes, preserve_attrs: bool = False) -> tuple[Graph, DataFrame]:
        """Induced and renumbered in id order; ids that do not exist are passed over. Also (new_id, old_id)."""
        keep = self.V.join(self.node_frame(nodes), "id", "left_semi")
        m = number(keep.withColumn("new_id", F.lit(0)), "new_id", ["id"])
        names = m.select(F.col("id"), "new_id")
        E = self.E.join(names.select(F.col("id").alias("src"), F.col("new_id").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("new_id").alias("t")), "dst")
        E = self._renumbered(E.select("eid", F.col("s").alias("src"), F.col("t").alias("dst"), "payload"))
        return self.with_(m.select(F.col("new_id").alias("id"), "payload"), E, attrs=self.attrs if preserve_attrs else None), names.select("new_id", F.col("id").alias("old_id"))

    def subgraph(self, nodes, preserve_attrs: bool = False) -> Graph:
        return self.subgraph_with_nodemap(nodes, preserve_attrs)[0]

    def edge_subgraph(self, pairs: Iterable[tuple[int, int]]) -> Graph:
        p = self.spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src bigint, dst bigint")
        if not self.directed:
            p = p.union(p.select("dst", "src"))
        E = self.E.join(p.distinct(), ["src", "dst"], "left_semi").select("eid", "src", "dst", "payload")
        ends = E.select(F.col("src").alias("id")).union(E.select("dst"))
        return self.with_(self.V.join(ends, "id", "left_semi"), E)

    def compose(self, other: Graph, node_map: dict[int, tuple[int, Any]], node_map_func=None, edge_map_func=None) -> tuple[Graph, DataFrame]:
        """Adds ``other`` under shifted ids and edges self[k] - other[j] with payload p for node_map {k: (j, p)}.
        Also (old_id, new_id). The functions are Columns, SQL or callables of the payload."""
        at, eat = self._next(self.V, "id"), self._next(self.E, "eid")
        m = number(other.V.select("id").withColumn("new_id", F.lit(0)), "new_id", ["id"]).select("id", (F.col("new_id") + at).alias("new_id"))
        kind, ekind = self.V.schema["payload"].dataType.simpleString(), self.E.schema["payload"].dataType.simpleString()
        np_, ep = (F.col("payload") if f is None else condition(f, F.col("payload"), k).cast(k) for f, k in ((node_map_func, kind), (edge_map_func, ekind)))
        V = self.V.unionByName(other.V.join(m, "id").select(F.col("new_id").alias("id"), np_.alias("payload")))
        moved = other.E.withColumn("payload", ep).join(m.select(F.col("id").alias("src"), F.col("new_id").alias("s")), "src").join(m.select(F.col("id").alias("dst"), F.col("new_id").alias("t")), "dst")
        bridge = self.spark.createDataFrame([(int(k), int(j), p) for k, (j, p) in node_map.items()], T.StructType([T.StructField("src", T.LongType()), T.StructField("j", T.LongType()), T.StructField("payload", self.E.schema["payload"].dataType)]))
        bridge = bridge.join(m.select(F.col("id").alias("j"), F.col("new_id").alias("dst")), "j").select(F.lit(0).cast("bigint").alias("eid"), "src", "dst", "payload")
        new = moved.select("eid", F.col("s").alias("src"), F.col("t").alias("dst"), "payload").unionByName(bridge)
        new = number(new, "eid", ["eid", "src", "dst"]).withColumn("eid", F.col("eid") + eat)
        return self.with_(V, self.E.unionByName(new)), m.select(F.col("id").alias("old_id"), "new_id")

    def substitute_node_with_subgraph(self, node: int, other: Graph, edge_map: Callable[[int, int, Any], int | None], node_filter=None, edge_weight_map=None) -> tuple[Graph, DataFrame]:
        """``other`` takes the place of the node; ``edge_map(src, dst, payload)`` names the vertex of ``other`` at which an edge of the node ends (None: the edge goes)."""
        self.get_node_data(node)
        if node_filter is not None:
            keep = other.V.where(condition(node_filter, F.col("payload")))
            ids = keep.select("id")
            other = other.with_(keep, other.E.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("eid", "src", "dst", "payload"))
        edge = self.E.where((F.col("src") == node) | (F.col("dst") == node))
        to = edge.withColumn("to", F.udf(edge_map, "bigint")("src", "dst", "payload")).where("to IS NOT NULL")
        g, m = self.remove_node(node).compose(other, {}, edge_map_func=edge_weight_map)
        to = to.join(m.select(F.col("old_id").alias("to"), F.col("new_id")), "to")
        moved = to.select("eid", *(F.when(F.col(c) == node, F.col("new_id")).otherwise(F.col(c)).alias(c) for c in ("src", "dst")), "payload")
        return g.with_(E=g.E.unionByName(moved)), m

    def contract_nodes(self, nodes: Iterable[int], payload, weight_combo: str | None = None, check_cycle: bool | None = None) -> tuple[Graph, int | None]:
        """The nodes become one new node. ``weight_combo``: an SQL aggregate over payload that folds parallel edges."""
        ids = [int(n) for n in nodes]
        ids = [r[0] for r in self.V.where(F.col("id").isin(ids)).select("id").collect()] if ids else []
        if self.directed and (self._check_cycle if check_cycle is None else check_cycle) and not self.can_contract_without_cycle(ids):
            raise DAGWouldCycle("contracting the nodes would close a cycle")
        g, new = self.add_node(payload)
        if not ids:
            return g, new
        E = g.E.withColumns({c: F.when(F.col(c).isin(ids), F.lit(new).cast("bigint")).otherwise(F.col(c)) for c in ("src", "dst")})
        inner = self.E.where(F.col("src").isin(ids) & F.col("dst").isin(ids)).select("eid")
        E = E.join(inner, "eid", "left_anti").select("eid", "src", "dst", "payload")
        if weight_combo:
            kind = self.E.schema["payload"].dataType
            hit = (F.col("src") == new) | (F.col("dst") == new)
            ends = ["src", "dst"] if self.directed else [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
            folded = E.where(hit).groupBy(*ends).agg(F.min("eid").alias("eid"), F.expr(weight_combo).cast(kind).alias("payload"))
            E = E.where(~hit).unionByName(folded.select("eid", "src", "dst", "payload"))
        return g.with_(g.V.where(~F.col("id").isin(ids)), E), new

    def can_contract_without_cycle(self, nodes: Iterable[int]) -> bool:
        """No path leaves the set and comes back."""
        from weftgraph.operators.traversal import reach

        ids = [int(n) for n in nodes]
        inside = self.node_frame(ids)
        left = self.E.where(F.col("src").isin(ids) & ~F.col("dst").isin(ids)).select(F.col("dst").alias("id")).distinct() if ids else inside
        outside = self.with_(E=self.E.where(~F.col("src").isin(ids)) if ids else self.E)
        return reach(outside, left).join(inside, "id", "left_semi").isEmpty()

    def is_symmetric(self) -> bool:
        odd = self.E.where("src != dst").groupBy(F.least("src", "dst"), F.greatest("src", "dst")).agg((F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(0)) > 0).alias("f"), (F.sum(F.when(F.col("src") > F.col("dst"), 1).otherwise(0)) > 0).alias("b"))
        return odd.where("f != b").isEmpty()

    def to_undirected(self, multigraph: bool = True, weight_combo: str | None = None) -> Graph:
        """Parallel edges are kept, or folded by an SQL aggregate over payload (default: the last edge's payload)."""
        if multigraph:
            return self.with_(directed=False, multigraph=True, check_cycle=False)
        kind = self.E.schema["payload"].dataType
        fold = F.max_by("payload", "eid") if weight_combo is None else F.expr(weight_combo).cast(kind)
        E = self.E.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("eid").alias("eid"), fold.alias("payload"))
        return self.with_(E=E.select("eid", "src", "dst", "payload"), directed=False, multigraph=False, check_cycle=False)

    def to_directed(self) -> Graph:
        """Each edge both ways; a self-loop twice."""
        E = self.E.select((F.col("eid") * 2).alias("eid"), "src", "dst", "payload").union(self.E.select(F.col("eid") * 2 + 1, "dst", "src", "payload"))
        return self.with_(E=E, directed=True)

    def reverse(self) -> Graph:
        return self.with_(E=self.E.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "payload"))

    def weighted(self, weight: Weight = None, default: float = 1.0, undirected: bool | None = None) -> DataFrame:
        """arcs as (eid, src, dst, w double)."""
        return self.arcs(undirected).select("eid", "src", "dst", weight_column(weight, default).alias("w"))


class DiGraph(Graph):
    """A directed graph."""

    def __init__(self, V, E, **kw):
        super().__init__(V, E, **({"directed": True} | kw))


DAG = DiGraph


def number(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Dense numbers from 0 in the given order, without putting all rows in one partition.

    Rows are dealt by range; each range counts its rows, and the sums of the ranges before it are
    added. Only the counts, one row per range, meet.
    """
    from pyspark.sql import Window as W

    from weftgraph.plans.fixpoint import checkpoint

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(df.withColumn("_k", F.struct(*order)).drop(*([column] if column not in order else [])).repartitionByRange(n, "_k").withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).alias("_b"))
    at = F.row_number().over(W.partitionBy("_p").orderBy("_k")) - 1
    out = dealt.withColumn("_r", at).join(F.broadcast(before), "_p")
    return out.withColumn(column, (F.col("_r") + F.coalesce("_b", F.lit(0))).cast("bigint")).select(*(c for c in df.columns if c != column), column)


def require(error: type[Exception], found: bool, text: str) -> None:
    if not found:
        raise error(text)
