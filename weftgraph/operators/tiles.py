"""All distances by tiled (min, +) products: the matrix as rows of square blocks, numpy inside a block.

For each block of vertices in turn: its own tile is closed, then the tiles of its row and column take paths through it, then
all others by one product of a column tile and a row tile. No task holds more than three tiles, and as many
rounds as there are blocks do what a sequential program does vertex by vertex.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, Weight, number
from weftgraph.plans.fixpoint import handy, meet, written
from weftgraph.session import ship

#: Vertices of a block: a tile of distances and next vertices takes 16 bytes times its square (1 MB).
SIDE = 256
TILE = "bi int, bj int, d binary, x binary"


def through(d, x, left, left_x, right):
    """Distances ``d`` and next vertices ``x`` where paths by way of ``left`` and ``right`` may be shorter."""
    for c in range(left.shape[1]):
        t = left[:, c, None] + right[None, c, :]
        better = t < d
        d = np.where(better, t, d)
        x = np.where(better, left_x[:, c, None], x)
    return d, x


def closed(d, x):
    """All paths inside a tile on the diagonal."""
    for c in range(len(d)):
        d, x = through(d, x, d[:, c : c + 1], x[:, c : c + 1], d[c : c + 1, :])
    return d, x


def all_distances(graph: Graph, weight: Weight = None, default: float = 1.0, side: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Tiles (bi, bj, d, x: numbers of the next vertices) and (id, at), the vertices' numbers in order of their ids.

    Parallel arcs take the least weight; the diagonal is 0 at most; x is the target itself where there is no path.
    """
    ship(graph.spark)
    side = side or SIDE
    spot = written(number(graph.V.select("id").withColumn("at", F.lit(0)), "at", ["id"]))
    n = spot.count()
    blocks = -(-n // side)
    arcs = graph.weighted(weight, default).groupBy("src", "dst").agg(F.min("w").alias("w"))
    arcs = meet(meet(arcs, spot.select(F.col("id").alias("src"), F.col("at").alias("i")), "src"), spot.select(F.col("id").alias("dst"), F.col("at").alias("j")), "dst")
    cell = lambda c: F.expr(f"cast({c} div {side} AS int)")
    none = F.lit(None)
    every = graph.spark.range(blocks * blocks).select(F.expr(f"cast(id div {max(blocks, 1)} AS int)").alias("bi"), F.expr(f"cast(id % {max(blocks, 1)} AS int)").alias("bj"), none.cast("bigint").alias("i"), none.cast("bigint").alias("j"), none.cast("double").alias("w"))
    rows = arcs.select(cell("i").alias("bi"), cell("j").alias("bj"), "i", "j", "w").union(every)

    def pack(bi, bj, d, x):
        return pd.DataFrame({"bi": [bi], "bj": [bj], "d": [d.tobytes()], "x": [x.tobytes()]})

    def view(d, x, bi, bj):
        shape = (min(side, n - bi * side), min(side, n - bj * side))
        return np.frombuffer(d).reshape(shape), np.frombuffer(x, np.int64).reshape(shape)

    def build(key, pdf):
        bi, bj = int(key[0]), int(key[1])
        h, w = min(side, n - bi * side), min(side, n - bj * side)
        d, x = np.full((h, w), np.inf), np.tile(np.arange(bj * side, bj * side + w), (h, 1))
        at = pdf[pdf["i"].notna()]
        np.minimum.at(d, (at["i"].to_numpy(np.int64) - bi * side, at["j"].to_numpy(np.int64) - bj * side), at["w"].to_numpy(float))
        if bi == bj:
            np.fill_diagonal(d, np.minimum(d.diagonal(), 0.0))
        return pack(bi, bj, d, x)

    tiles = written(rows.groupBy("bi", "bj").applyInPandas(build, TILE))

    def close(key, pdf):
        k = int(key[0])
        return pack(k, k, *closed(*view(pdf["d"].iloc[0], pdf["x"].iloc[0], k, k)))

    def border(key, pdf):
        r = pdf.iloc[0]
        bi, bj, k = int(key[0]), int(key[1]), int(r["k"])
        d, x = view(r["d"], r["x"], bi, bj)
        pd_, px = view(r["pd"], r["px"], k, k)
        return pack(bi, bj, *(through(d, x, pd_, px, d) if bi == k else through(d, x, d, x, pd_)))

    def inner(key, pdf):
        r = pdf.iloc[0]
        bi, bj, k = int(key[0]), int(key[1]), int(r["k"])
        ld, lx = view(r["ld"], r["lx"], bi, k)
        rd, _ = view(r["rd"], r["rd"], k, bj)
        return pack(bi, bj, *through(*view(r["d"], r["x"], bi, bj), ld, lx, rd))

    for k in range(blocks):
        pivot = written(tiles.where(f"bi = {k} AND bj = {k}").groupBy("bi", "bj").applyInPandas(close, TILE))
        edge = tiles.where(f"(bi = {k}) != (bj = {k})").join(F.broadcast(pivot.select(F.col("d").alias("pd"), F.col("x").alias("px"), F.lit(k).alias("k"))))  # one row
        edge = written(edge.groupBy("bi", "bj").applyInPandas(border, TILE))
        left = edge.where(f"bj = {k}").select("bi", F.col("d").alias("ld"), F.col("x").alias("lx"))
        right = edge.where(f"bi = {k}").select("bj", F.col("d").alias("rd"))
        rest = tiles.where(f"bi != {k} AND bj != {k}").join(left, "bi").join(right, "bj").withColumn("k", F.lit(k))
        rest = rest.groupBy("bi", "bj").applyInPandas(inner, TILE)
        tiles = written(pivot.union(edge).union(rest))
    return tiles, spot


def pairs(tiles: DataFrame, spot: DataFrame, side: int | None = None) -> DataFrame:
    """src, dst, dist, next (ids) of every pair of vertices."""
    side = side or SIDE
    n = spot.count()

    def spread(key, pdf):
        bi, bj = int(key[0]), int(key[1])
        h, w = min(side, n - bi * side), min(side, n - bj * side)
        i, j = np.divmod(np.arange(h * w), w)
        return pd.DataFrame({"i": i + bi * side, "j": j + bj * side, "dist": np.frombuffer(pdf["d"].iloc[0]), "x": np.frombuffer(pdf["x"].iloc[0], np.int64)})

    out = tiles.groupBy("bi", "bj").applyInPandas(spread, "i bigint, j bigint, dist double, x bigint")
    for c, name in (("i", "src"), ("j", "dst"), ("x", "next")):
        out = out.join(handy(spot.select(F.col("at").alias(c), F.col("id").alias(name)), n), c)
    return out.select("src", "dst", "dist", "next")
