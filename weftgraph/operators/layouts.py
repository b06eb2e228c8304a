"""Vertex positions: static ones as column expressions, force-directed ones as kernels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, Weight, number
from weftgraph.operators import kernels as K
from weftgraph.operators.components import labels
from weftgraph.operators.local import as_whole, by_component


def _ranked(graph: Graph) -> DataFrame:
    return number(graph.V.select("id").withColumn("r", F.lit(0)), "r", ["id"])


def _placed(df: DataFrame, scale: float | None, center) -> DataFrame:
    """Centred on the mean, scaled so that the greatest coordinate is ``scale``, moved to ``center``."""
    if scale is not None:
        mx, my = df.agg(F.avg("x"), F.avg("y")).head()
        df = df.withColumns({"x": F.col("x") - (mx or 0.0), "y": F.col("y") - (my or 0.0)})
        top = df.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).head()[0]
        if top:
            df = df.withColumns({"x": F.col("x") * scale / top, "y": F.col("y") * scale / top})
    if center is not None:
        df = df.withColumns({"x": F.col("x") + center[0], "y": F.col("y") + center[1]})
    return df.select("id", "x", "y")


def random_layout(graph: Graph, center=None, seed: int = 0) -> DataFrame:
    """Uniform in the unit square; hashes of the id, so partitioning does not matter."""
    def unit(k):
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(2**53)) / float(2**53)

    return _placed(graph.V.select("id", unit(1).alias("x"), unit(2).alias("y")), None, center)


def circular_layout(graph: Graph, scale: float | None = 1.0, center=None) -> DataFrame:
    n = graph.num_nodes()
    t = F.col("r") * (2 * math.pi / max(1, n))
    x, y = (F.lit(0.0), F.lit(0.0)) if n <= 1 else (F.cos(t), F.sin(t))
    s = 1.0 if scale is None else scale
    return _placed(_ranked(graph).select("id", (x * s).alias("x"), (y * s).alias("y")), None, center)


def shell_layout(graph: Graph, nlist: list[list[int]] | None = None, rotate: float | None = None, scale: float | None = 1.0, center=None) -> DataFrame:
    """Concentric circles, each turned against the one before."""
    if nlist is None:
        return circular_layout(graph, scale, center)
    s, k = (1.0 if scale is None else scale), len(nlist)
    turn = math.pi / k if rotate is None else rotate
    gap = s / k
    radius, first, rows = (0.0 if len(nlist[0]) == 1 else gap), turn, []
    for shell in nlist:
        for i, v in enumerate(shell):
            t = 2 * math.pi * i / len(shell) + first
            rows.append((int(v), radius * math.cos(t), radius * math.sin(t)))
        radius += gap
        first += turn
    return _placed(graph.spark.createDataFrame(rows, "id bigint, x double, y double"), None, center)


def spiral_layout(graph: Graph, scale: float = 1.0, center=None, resolution: float = 0.35, equidistant: bool = False) -> DataFrame:
    """Radius grows with the rank; ``equidistant`` steps the angle by the radius so that neighbours keep their distance."""
    if not equidistant:
        r = F.col("r").cast("double")
        return _placed(_ranked(graph).select("id", (r * F.cos(r * resolution)).alias("x"), (r * F.sin(r * resolution)).alias("y")), scale, center)

    def kernel(g):
        rows, theta = [], resolution
        for v in g.ids:
            r = 0.5 * theta
            theta += 1.0 / r
            rows.append((v, math.cos(theta) * r, math.sin(theta) * r))
        return rows

    return _placed(as_whole(graph, kernel, "id bigint, x double, y double"), scale, center)


def bipartite_layout(graph: Graph, first_nodes, horizontal: bool = False, scale: float = 1.0, center=None, aspect_ratio: float = 4 / 3) -> DataFrame:
    """Two columns, each spread evenly over its height."""
    left = graph.node_frame(first_nodes).withColumn("left", F.lit(True))
    v = graph.V.select("id").join(left, "id", "left").select("id", F.coalesce("left", F.lit(False)).alias("left"))
    a = number(v.where("left").withColumn("r", F.lit(0)), "r", ["id"])
    b = number(v.where("NOT left").withColumn("r", F.lit(0)), "r", ["id"])
    sizes = {r[0]: r[1] for r in v.groupBy("left").count().collect()}
    parts = None
    for part, side, n in ((a, 0.0, sizes.get(True, 0)), (b, float(aspect_ratio), sizes.get(False, 0))):
        y = F.col("r") / max(1, n - 1) if n > 1 else F.lit(0.5)
        p = part.select("id", F.lit(side).alias("x"), y.cast("double").alias("y"))
        parts = p if parts is None else parts.union(p)
    if horizontal:
        parts = parts.select("id", F.col("y").alias("x"), F.col("x").alias("y"))
    return _placed(parts, scale, center)


def spring_layout(graph: Graph, pos: dict | None = None, fixed=None, k: float | None = None, repulsive_exponent: int = 2, adaptive_cooling: bool = True, num_iter: int = 50, tol: float = 1e-6, weight: Weight = None, default: float = 1.0, scale: float = 1.0, center=None, seed: int = 0) -> DataFrame:
    if fixed and not pos:
        raise ValueError("fixed nodes need positions")
    keep = set(fixed or ())

    def kernel(g):
        at = K.spring(g, pos, keep, k, repulsive_exponent, adaptive_cooling, num_iter, tol, seed)
        return [(v, float(x), float(y)) for v, (x, y) in at.items()]

    out = as_whole(graph, kernel, "id bigint, x double, y double", weight, default)
    return out if fixed else _placed(out, scale, center)


def kamada_kawai_layout(graph: Graph, pos: dict | None = None, fixed=None, weight: Weight = None, default: float = 1.0, epsilon: float = 1e-4, max_outer: int = 500, max_inner: int = 10, scale: float = 1.0, center=None) -> DataFrame:
    """Parts are laid out in parallel on undirected distances and then set side by side."""
    if not graph.weighted(weight, default).where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    keep = set(fixed or ())

    def kernel(g):
        at = K.kamada_kawai(g, pos, keep, max_outer, max_inner, epsilon)
        return [(v, float(x), float(y)) for v, (x, y) in at.items()]

    out = by_component(graph.with_(directed=False), kernel, "id bigint, x double, y double", weight, default)
    if not pos and not keep:
        from pyspark.sql import Window as W

        parts = out.join(labels(graph), "id")
        box = parts.groupBy("component").agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("width"))
        left = F.coalesce(F.sum(F.col("width") + 1.0).over(W.orderBy("component").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))  # one row per part
        box = box.select("component", "lo", left.alias("left"))
        out = parts.join(box, "component").select("id", (F.col("x") - F.col("lo") + F.col("left")).alias("x"), "y")
    return out if keep else _placed(out, scale, center)
