"""Stateful operators: the online topological sorter, and components of a growing edge stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.errors import DAGHasCycle
from weftgraph.graph import Graph
from weftgraph.operators.components import labels
from weftgraph.plans.fixpoint import checkpoint


class TopologicalSorter:
    """Hands out vertices whose predecessors are done. The state is three DataFrames; a step joins only what changed."""

    def __init__(self, graph: Graph, check_cycle: bool = True, reverse: bool = False, initial: list[int] | None = None, check_args: bool = True):
        from weftgraph.operators.dag import is_directed_acyclic_graph

        if check_cycle and not is_directed_acyclic_graph(graph):
            raise DAGHasCycle("the graph has a cycle")
        g = graph.reverse() if reverse else graph
        self.check = check_args
        self.arcs = checkpoint(g.E.groupBy("src", "dst").agg(F.count("*").alias("m")))
        need = self.arcs.groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("n"))
        self.need = checkpoint(g.V.select("id").join(need, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))
        if initial is None:
            ready = self.need.where("n = 0").select("id")
        else:
            ready = g.node_frame(initial)
            if self.check and not self.need.join(ready, "id", "left_semi").where("n > 0").isEmpty():
                from weftgraph.operators.traversal import reach

                start = g.node_frame(initial)
                into = self.arcs.join(start.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))
                if not reach(g, start).join(into, "id", "left_semi").isEmpty():
                    raise ValueError("an initial node can be reached from another one")
        self.ready = checkpoint(ready)
        self.out = checkpoint(self.ready.limit(0))
        self.finished = self.out

    def is_active(self) -> bool:
        return not self.ready.isEmpty() or not self.out.isEmpty()

    def get_ready(self) -> list[int]:
        """The vertices that became ready, each once."""
        got = sorted(r[0] for r in self.ready.collect())
        self.out = checkpoint(self.out.union(self.ready))
        self.ready = self.ready.limit(0)
        return got

    def done(self, nodes: list[int] | int) -> None:
        nodes = [nodes] if isinstance(nodes, int) else list(nodes)
        spark: SparkSession = self.arcs.sparkSession
        new = spark.createDataFrame([(int(v),) for v in nodes], "id bigint")
        if self.check:
            if len(set(nodes)) != len(nodes) or not new.join(self.finished, "id", "left_semi").isEmpty():
                raise ValueError("a node was done before")
            if not new.join(self.out, "id", "left_anti").isEmpty():
                raise ValueError("a node was not handed out")
        self.out = checkpoint(self.out.join(new, "id", "left_anti"))
        self.finished = checkpoint(self.finished.union(new))
        cut = self.arcs.join(new.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("c"))
        hit = checkpoint(self.need.join(cut, "id", "left").select("id", "n", (F.col("n") - F.coalesce("c", F.lit(0))).alias("k")))
        self.ready = checkpoint(self.ready.union(hit.where("n > 0 AND k <= 0").select("id").join(self.finished, "id", "left_anti")))
        self.need = hit.select("id", F.col("k").alias("n"))


class StreamingComponents:
    """Components of a stream of edges (src, dst): ``stream.writeStream.foreachBatch(self.update)``.

    Under ``path`` every batch leaves a delta: the ids that are new with their component, and the
    links from components that went into another one. A batch looks its ends up (a scan against a
    broadcast copy of them), is contracted, and writes only what it changed; after ``compact``
    deltas all labels are written once. Nothing is kept on the driver: after a restart the newest
    versions on the file system count, and a batch that is delivered again starts from the
    versions before it and writes the same delta. Versions that no delivery can need are removed.
    """

    #: Ends of a batch up to this number (8 bytes each) are broadcast; beyond it they are joined by shuffle.
    BROADCAST = 1_000_000

    def __init__(self, spark: SparkSession, path: str, compact: int = 16):
        self.spark, self.path, self.compact = spark, path.rstrip("/"), compact

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self, before: int | None = None) -> list[tuple[int, str]]:
        """(batch, kind) of the whole versions that make up the state: the newest full one and the deltas after it."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        found = []
        for f in fs.listStatus(path):
            kind, _, n = f.getPath().getName().partition("-")
            if kind in ("full", "delta") and all(fs.exists(at(f.getPath(), f"{part}/_SUCCESS")) for part in ("nodes", "links")):
                found.append((int(n), kind))
        found = sorted(v for v in found if before is None or v[0] < before)
        full = max((n for n, kind in found if kind == "full"), default=None)
        return [v for v in found if full is None or v[0] > full or v == (full, "full")]

    def _read(self, versions, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}-{n}/{part}" for n, kind in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _roots(named: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
        """(id, component) with components followed along the links; a chain has a link per version at most."""
        for _ in range(rounds):
            named = named.join(links.withColumnRenamed("root", "on"), "component", "left").select("id", F.coalesce("on", "component").alias("component"))
        return named

    def labels(self) -> DataFrame:
        """id, component (the least id) of all vertices so far."""
        have = self.versions()
        named = self._read(have, "nodes", "id bigint, component bigint")
        return self._roots(named, self._read(have, "links", "component bigint, root bigint"), len(have))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        have = self.versions(before=batch_id)
        nodes, links = self._read(have, "nodes", "id bigint, component bigint"), self._read(have, "links", "component bigint, root bigint")
        batch = checkpoint(batch.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
        ends = checkpoint(batch.select(F.col("src").alias("id")).union(batch.select("dst")).distinct())
        few = F.broadcast(ends) if ends.limit(self.BROADCAST + 1).count() <= self.BROADCAST else ends
        known = checkpoint(self._roots(nodes.join(few, "id", "left_semi"), links, len(have)))
        new = checkpoint(ends.join(known, "id", "left_anti"))
        named = checkpoint(known.union(new.select("id", F.col("id").alias("component"))))
        e = batch.join(named.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
        merged = labels(Graph.from_edges(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), named.select(F.col("component").alias("id")).distinct()))
        merged = checkpoint(merged.select(F.col("id").alias("component"), F.col("component").alias("root")))
        at = f"{self.path}/delta-{batch_id}"
        new.select("id", F.col("id").alias("component")).join(merged, "component").select("id", F.col("root").alias("component")).write.mode("overwrite").parquet(f"{at}/nodes")
        merged.where("component != root").join(new.select(F.col("id").alias("component")), "component", "left_anti").write.mode("overwrite").parquet(f"{at}/links")
        if sum(kind == "delta" for _, kind in self.versions()) >= self.compact:
            self._compact(batch_id)

    def _compact(self, batch_id: int) -> None:
        out, at = self.labels(), f"{self.path}/full-{batch_id}"
        out.write.mode("overwrite").parquet(f"{at}/nodes")
        self.spark.createDataFrame([], "component bigint, root bigint").write.mode("overwrite").parquet(f"{at}/links")
        fs, path = self._fs()
        need = {f"{kind}-{n}" for n, kind in [*self.versions(), *self.versions(before=batch_id)]}
        for f in fs.listStatus(path):
            if f.getPath().getName() not in need:
                fs.delete(f.getPath(), True)
