"""Sequential kernels inside Spark tasks.

``by_component`` runs a kernel once per weakly connected part, so parts run in parallel;
``as_whole`` runs it once for algorithms whose result depends on the whole graph;
``fan_out`` runs it per source vertex over a broadcast copy of the graph, whose size is checked.
What a kernel must know of vertices and edges beside the weight travels in their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, Weight, weight_column

#: Vertices, and edges, that may be broadcast to every worker (about 100 bytes each there).
BROADCAST_EDGES = 2_000_000
#: Vertices and edges that a sequential kernel takes in one task (some 500 bytes each, so 2 GB); on more it is refused before it starts.
TASK_ROWS = 4_000_000
#: Rows of a fan-out that a task holds before it passes them on, and those of one source more.
YIELD = 50_000


class Local:
    """A graph in one task: ids in order, edges (eid, u, v, w) by eid, arcs out of and into each vertex; what was carried for vertices and edges."""

    def __init__(self, ids, edges, directed, node=None, edge=None):
        self.ids = sorted(ids)
        self.node, self.edge = node or {}, edge or {}
        self.directed = directed
        self.edges = sorted(edges)
        self.out = {i: [] for i in self.ids}
        self.into = {i: [] for i in self.ids}
        for eid, u, v, w in self.edges:
            self.out[u].append((v, w, eid))
            self.into[v].append((u, w, eid))
            if not directed and u != v:
                self.out[v].append((u, w, eid))
                self.into[u].append((v, w, eid))

    def neighbors(self, v):
        return list(dict.fromkeys(x for x, *_ in self.out[v]))

    def all_neighbors(self, v):
        return list(dict.fromkeys([x for x, *_ in self.out[v]] + [x for x, *_ in self.into[v]]))


def _rows(graph: Graph, key: DataFrame | None, weight: Weight, default: float, node: Column | None = None, edge: Column | None = None) -> DataFrame:
    """Vertices and edges as rows (k, id, a, b, eid, w, x); ``node`` and ``edge`` are columns carried in x as text."""
    w, none = weight_column(weight, default), F.lit(None).cast("string")
    x, y = (none if c is None else c.cast("string") for c in (node, edge))
    nodes = graph.V.select("id", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("bigint").alias("eid"), F.lit(None).cast("double").alias("w"), x.alias("x"))
    edges = graph.E.select(F.col("src").alias("id"), F.col("src").alias("a"), F.col("dst").alias("b"), "eid", w.alias("w"), y.alias("x"))
    rows = nodes.union(edges)
    return rows.withColumn("k", F.lit(0).cast("bigint")) if key is None else rows.join(key.select("id", F.col("component").alias("k")), "id")


def _apply(rows: DataFrame, kernel: Callable[[Local], Iterable[tuple]], schema: str, directed: bool) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in _split(schema)]
    big = rows.select("k").groupBy("k").count().where(F.col("count") > TASK_ROWS).head()
    if big is not None:
        raise ValueError(f"a part of {big['count']} vertices and edges: this algorithm is sequential, and a task takes {TASK_ROWS}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["b"].isna()
        v, e = pdf[at], pdf[~at]
        edges = list(zip(e["eid"].astype("int64").tolist(), e["a"].tolist(), e["b"].astype("int64").tolist(), e["w"].astype(float).tolist(), strict=True))
        ids = v["a"].tolist()
        g = Local(ids, edges, directed, dict(zip(ids, v["x"], strict=True)), {i: x for (i, *_), x in zip(edges, e["x"], strict=True)})
        got = list(kernel(g))
        return pd.DataFrame(got, columns=names) if got else pd.DataFrame({n: pd.Series([], dtype=object) for n in names})

    return rows.groupBy("k").applyInPandas(run, schema)


def _split(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def by_component(graph: Graph, kernel, schema: str, weight: Weight = None, default: float = 1.0, node: Column | None = None, edge: Column | None = None, parts: DataFrame | None = None) -> DataFrame:
    """``parts`` (id, component) limits the kernel to some components; without it all take part."""
    from weftgraph.operators.components import labels

    return _apply(_rows(graph, labels(graph) if parts is None else parts, weight, default, node, edge), kernel, schema, graph.directed)


#: Vertices and edges of components that a kernel takes where a distributed form exists for larger ones.
PART_ROWS = 40_000


def within(rows: int, *frames: DataFrame) -> bool:
    """Whether all frames together have at most so many rows; counts no further."""
    for df in frames:
        rows -= df.limit(rows + 1).count()
        if rows < 0:
            return False
    return True


def by_size(graph: Graph) -> tuple[DataFrame | None, Graph | None]:
    """(id, component) of the components of up to PART_ROWS vertices and edges, for kernels, and the graph of the
    larger ones, whose vertices have ``component`` as their payload; None where there are none. A graph of so few
    rows is one part."""
    from weftgraph.operators.components import labels
    from weftgraph.plans.fixpoint import checkpoint, meet, written

    if within(PART_ROWS, graph.V, graph.E):
        return graph.V.select("id", F.lit(0).cast("bigint").alias("component")), None
    parts = written(labels(graph))
    most = parts.groupBy("component").count().orderBy(F.desc("count"), "component").head()
    if most["count"] == parts.count():
        return None, graph.with_(parts.select("id", F.col("component").alias("payload")))
    ends = meet(graph.E.select(F.col("src").alias("id")), parts, "id").select("component")
    sizes = parts.select("component").union(ends).groupBy("component").count()
    large = checkpoint(sizes.where(F.col("count") > PART_ROWS).select("component"))
    if large.isEmpty():
        return parts, None
    far = checkpoint(parts.join(F.broadcast(large), "component", "left_semi"))  # at most rows / PART_ROWS components
    E = graph.E.join(far.select(F.col("id").alias("src")), "src", "left_semi").select("eid", "src", "dst", "payload")
    small = checkpoint(parts.join(F.broadcast(large), "component", "left_anti"))
    return None if small.isEmpty() else small, graph.with_(far.select("id", F.col("component").alias("payload")), checkpoint(E))


def as_whole(graph: Graph, kernel, schema: str, weight: Weight = None, default: float = 1.0, node: Column | None = None, edge: Column | None = None) -> DataFrame:
    return _apply(_rows(graph, None, weight, default, node, edge), kernel, schema, graph.directed)


def can_broadcast(graph: Graph) -> bool:
    return all(df.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES for df in (graph.E, graph.V))


def fan_out(graph: Graph, kernel: Callable[[Local, int], Iterable[tuple]], schema: str, weight: Weight = None, default: float = 1.0, sources: DataFrame | None = None) -> DataFrame:
    """Rows of ``kernel(graph, source)`` for every source; sources are spread over the workers.

    Graphs of more than BROADCAST_EDGES vertices or edges are refused here; callers that have a
    join-based form (:mod:`weftgraph.operators.levels`) use that instead.
    """
    if not can_broadcast(graph):
        raise ValueError(f"more than {BROADCAST_EDGES} vertices or edges: use the distributed form of this operator")
    spark = graph.spark
    edges = graph.E.select("eid", "src", "dst", weight_column(weight, default).alias("w")).toPandas()
    arrays = tuple(edges[c].to_numpy() for c in ("eid", "src", "dst", "w"))
    shared = spark.sparkContext.broadcast(arrays)
    directed, names = graph.directed, [c.strip().split(" ")[0] for c in _split(schema)]
    src = (graph.V if sources is None else sources).select("id")
    known = graph.V.select("id").toPandas()["id"].to_numpy()
    ids = spark.sparkContext.broadcast(known)

    def run(batches):
        e, a, b, w = shared.value
        g = Local([int(x) for x in ids.value], list(zip(e.tolist(), a.tolist(), b.tolist(), w.tolist(), strict=True)), directed)
        for pdf in batches:
            got = []
            for s in pdf["id"]:
                got += kernel(g, int(s))
                if len(got) >= YIELD:
                    yield pd.DataFrame(got, columns=names)
                    got = []
            yield pd.DataFrame(got, columns=names) if got else pd.DataFrame({n: pd.Series([], dtype=object) for n in names})

    n = max(1, min(len(known), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return src.repartition(n).mapInPandas(run, schema)
