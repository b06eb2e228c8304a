"""Graph generators as plans over ``spark.range``: rows come into being on the workers.

Edge ids follow the order in which the families are usually written down. Random generators hash
(seed, pair), so a seed gives the same graph at any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.distances import hyperboloid_hyperbolic_distance, lp_distance, maximum_distance
from weftgraph.graph import Graph, number
from weftgraph.plans.fixpoint import checkpoint, written


def _make(spark: SparkSession, n: int, E: DataFrame, directed: bool, multigraph: bool, weights=None, bidirectional: bool = False) -> Graph:
    """From E(eid, src, dst); ``bidirectional`` adds each edge's reverse after it."""
    V = spark.range(n).select("id", F.lit(None).cast("string").alias("payload"))
    if weights is not None:
        V = spark.range(n).select("id").join(spark.createDataFrame([(i, str(w)) for i, w in enumerate(weights)], "id bigint, payload string"), "id", "left")
    E = E.select(F.col("eid").cast("bigint").alias("eid"), F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    if bidirectional and directed:
        E = E.select((F.col("eid") * 2).alias("eid"), "src", "dst").union(E.select(F.col("eid") * 2 + 1, "dst", "src"))
    return Graph(V, E.withColumn("payload", F.lit(None).cast("double")), directed, multigraph)


def _size(num_nodes: int | None, weights) -> int:
    if num_nodes is None and weights is None:
        raise IndexError("num_nodes or weights must be given")
    return len(weights) if num_nodes is None or weights is not None and len(weights) > num_nodes else num_nodes


def empty_graph(spark, n: int, multigraph: bool = True, directed: bool = False) -> Graph:
    return _make(spark, n, spark.range(0).select(F.col("id").alias("eid"), F.col("id").alias("src"), F.col("id").alias("dst")), directed, multigraph)


def directed_empty_graph(spark, n: int, multigraph: bool = True) -> Graph:
    return empty_graph(spark, n, multigraph, True)


def path_graph(spark, num_nodes: int | None = None, weights=None, multigraph: bool = True, directed: bool = False, bidirectional: bool = False) -> Graph:
    n = _size(num_nodes, weights)
    return _make(spark, n, spark.range(max(0, n - 1)).select(F.col("id").alias("eid"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), directed, multigraph, weights, bidirectional)


def directed_path_graph(spark, num_nodes=None, weights=None, bidirectional=False, multigraph=True) -> Graph:
    return path_graph(spark, num_nodes, weights, multigraph, True, bidirectional)


def cycle_graph(spark, num_nodes: int | None = None, weights=None, multigraph: bool = True, directed: bool = False, bidirectional: bool = False) -> Graph:
    n = _size(num_nodes, weights)
    return _make(spark, n, spark.range(n).select(F.col("id").alias("eid"), F.col("id").alias("src"), ((F.col("id") + 1) % max(1, n)).alias("dst")), directed, multigraph, weights, bidirectional)


def directed_cycle_graph(spark, num_nodes=None, weights=None, bidirectional=False, multigraph=True) -> Graph:
    return cycle_graph(spark, num_nodes, weights, multigraph, True, bidirectional)


def star_graph(spark, num_nodes: int | None = None, weights=None, multigraph: bool = True, directed: bool = False, inward: bool = False, bidirectional: bool = False) -> Graph:
    n = _size(num_nodes, weights)
    hub, leaf = F.lit(0), F.col("id") + 1
    a, b = (leaf, hub) if inward and not bidirectional else (hub, leaf)
    return _make(spark, n, spark.range(max(0, n - 1)).select(F.col("id").alias("eid"), a.alias("src"), b.alias("dst")), directed, multigraph, weights, bidirectional)


def directed_star_graph(spark, num_nodes=None, weights=None, inward=False, bidirectional=False, multigraph=True) -> Graph:
    return star_graph(spark, num_nodes, weights, multigraph, True, inward, bidirectional)


#: Ends that a row of pairs meets at a time, and pairs per task.
STRIP, TASK_PAIRS = 1024, 16_000_000


def _strips(spark, rows: tuple[int, int], cols: tuple[int, int], lead: int | None = None) -> DataFrame:
    """src, dst: ``rows`` x ``cols`` (from, to exclusive), or those pairs with src + lead <= dst, without a shuffle.

    The pairs come in strips of STRIP columns, row by row: what a task writes holds few different values in a short period, so
    that a file of pairs takes a small part of the space that whole rows of the square would.
    """
    (a, b), (c, d) = rows, cols
    high, strips = max(0, b - a), -(-max(0, d - c) // STRIP)
    tasks = min(max(spark.sparkContext.defaultParallelism, high * max(0, d - c) // TASK_PAIRS), max(1, high * strips))
    at = spark.range(0, high * strips, 1, tasks).select((F.col("id") % max(1, high) + a).alias("src"), (F.expr(f"id div {max(1, high)}") * STRIP + c).alias("lo"))
    at = at.select("src", "lo" if lead is None else F.greatest("lo", F.col("src") + lead).alias("lo"), F.least(F.col("lo") + STRIP, F.lit(d).cast("bigint")).alias("hi")).where("lo < hi")
    return at.select("src", F.explode(F.expr("sequence(lo, hi - 1)")).alias("dst"))


def _square(spark, n: int) -> DataFrame:
    """src != dst below n in the order of :func:`_strips`, each from its number: where all pairs are wanted, no row holds a strip first."""
    high = max(1, n * STRIP)
    tasks = max(spark.sparkContext.defaultParallelism, n * n // TASK_PAIRS)
    at = spark.range(0, -(-n // STRIP) * n * STRIP, 1, tasks).select("id", F.expr(f"id div {high}").alias("s")).select("s", (F.col("id") - F.col("s") * high).alias("r"))
    return at.select(F.expr(f"r div {STRIP}").alias("src"), F.expr(f"s * {STRIP} + r % {STRIP}").alias("dst")).where(f"dst < {n} AND src != dst")


def _pairs(spark, n: int, ordered: bool) -> DataFrame:
    """All pairs i < j (or i != j); their numbers go row by row."""
    if ordered:
        return _square(spark, n).select(F.expr(f"src * {n - 1} + dst - cast(dst > src AS int)").alias("eid"), "src", "dst")
    return _strips(spark, (0, n), (0, n), 1).select(F.expr(f"src * ({2 * n - 1} - src) div 2 + dst - src - 1").alias("eid"), "src", "dst")


def complete_graph(spark, num_nodes: int | None = None, weights=None, multigraph: bool = True, directed: bool = False) -> Graph:
    n = _size(num_nodes, weights)
    return _make(spark, n, _pairs(spark, n, directed), directed, multigraph, weights)


mesh_graph = complete_graph


def directed_complete_graph(spark, num_nodes=None, weights=None, multigraph=True) -> Graph:
    return complete_graph(spark, num_nodes, weights, multigraph, True)


directed_mesh_graph = directed_complete_graph


def _numbered(E: DataFrame, order: list[str]) -> DataFrame:
    return number(E.withColumn("eid", F.lit(0)), "eid", order)


#: Neighbouring numbers of pairs whose bits a row holds where parallel edges are looked for in a dense graph.
BITS = 256


class _Unnumbered(Graph):
    """A graph whose edges (src, dst) get their ids, in that order, when ids are first asked for: lists and counts of edges need none.

    ``dense`` says that the vertices are 0 to dense - 1 and a fair share of all pairs has an edge: whether two have the same ends is
    then seen from a row of bits for each BITS neighbouring pairs and the number of edges there, and no edge has to be sent.
    """

    def __init__(self, V: DataFrame, ends: DataFrame, directed: bool, dense: int | None = None):
        self._ends, self._edges, self._dense, self._told = ends, None, dense, None
        super().__init__(V, None, directed, True)

    @property
    def E(self) -> DataFrame:
        if self._edges is None:
            self._edges = _numbered(self._ends, ["src", "dst"]).select("eid", "src", "dst", F.lit(None).cast("double").alias("payload"))
        return self._edges

    @E.setter
    def E(self, edges: DataFrame | None) -> None:
        self._edges = edges

    def edge_list(self) -> DataFrame:
        return self._ends

    def num_edges(self) -> int:
        return self._ends.count() if self._told is None else self._told[0]

    def has_parallel_edges(self) -> bool:
        if self._dense is None:
            return self.with_(E=self._ends).has_parallel_edges()
        if self._told is None:
            a, b = ("src", "dst") if self.directed else ("least(src, dst)", "greatest(src, dst)")
            pairs = self._ends.select(F.expr(f"{a} * {self._dense} + {b}").alias("k"))
            words = [F.expr(f"bit_or(IF(k div 64 % {BITS // 64} = {i}, shiftleft(1L, int(k % 64)), 0L))") for i in range(BITS // 64)]
            rows = pairs.groupBy(F.expr(f"k div {BITS}")).agg(F.count("*").alias("n"), F.array(*words).alias("bits"))
            rows = rows.select("n", F.expr("aggregate(bits, 0, (s, x) -> s + bit_count(x))").alias("apart"))
            n, most = rows.agg(F.sum("n"), F.max(F.col("n") - F.col("apart"))).head()
            self._told = (n or 0, bool(most))
        return self._told[1]

    def cached(self) -> Graph:
        return _Unnumbered(written(self.V), written(self._ends), self.directed, self._dense)


def _drawn(spark, n: int, ends: DataFrame, directed: bool, dense: bool = False) -> Graph:
    return _Unnumbered(spark.range(n).select("id", F.lit(None).cast("string").alias("payload")), ends, directed, n if dense else None)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid_graph(spark, rows: int | None = None, cols: int | None = None, weights=None, multigraph: bool = True, directed: bool = False, bidirectional: bool = False) -> Graph:
    """Cell (i, j) is i * cols + j; edges down and right. Without a shape the weights are one row."""
    if rows is None or cols is None:
        if weights is None:
            raise IndexError("a shape or weights must be given")
        rows, cols = (rows or 1), (cols or len(weights))
    n = rows * cols
    cells = spark.range(n).select("id", F.expr(f"id div {max(1, cols)}").alias("i"), (F.col("id") % max(1, cols)).alias("j"))
    down = cells.where(F.col("i") < rows - 1).select("id", F.lit(0).alias("k"), F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    right = cells.where(F.col("j") < cols - 1).select("id", F.lit(1).alias("k"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return _make(spark, n, _numbered(down.union(right), ["id", "k"]), directed, multigraph, None if weights is None else weights[:n], bidirectional)


def directed_grid_graph(spark, rows=None, cols=None, weights=None, bidirectional=False, multigraph=True) -> Graph:
    return grid_graph(spark, rows, cols, weights, multigraph, True, bidirectional)


def binomial_tree_graph(spark, order: int, weights=None, multigraph: bool = True, directed: bool = False, bidirectional: bool = False) -> Graph:
    """2^order nodes; a node's parent clears its highest bit."""
    if order >= 60:
        raise OverflowError("the order is too large")
    n = 1 << order
    kids = spark.range(1, n).select((F.col("id") - 1).alias("eid"), F.expr("id - shiftleft(1L, 63 - cast(length(regexp_replace(lpad(bin(id), 64, '0'), '1.*$', '')) AS int))").alias("src"), F.col("id").alias("dst"))
    return _make(spark, n, kids, directed, multigraph, weights, bidirectional)


def directed_binomial_tree_graph(spark, order, weights=None, bidirectional=False, multigraph=True) -> Graph:
    return binomial_tree_graph(spark, order, weights, multigraph, True, bidirectional)


def full_rary_tree(spark, branching_factor: int, num_nodes: int, weights=None, multigraph: bool = True) -> Graph:
    """The parent of i is (i - 1) div r."""
    if weights is not None and len(weights) > num_nodes:
        raise IndexError("more weights than nodes")
    E = spark.range(1, max(1, num_nodes)).select((F.col("id") - 1).alias("eid"), F.expr(f"(id - 1) div {branching_factor}").alias("src"), F.col("id").alias("dst"))
    return _make(spark, num_nodes, E, False, multigraph, weights)


def _odd(d: int) -> None:
    if d % 2 == 0:
        raise ValueError("d must be odd")


def heavy_square_graph(spark, d: int, multigraph: bool = True, directed: bool = False, bidirectional: bool = False) -> Graph:
    """d*d data nodes, then d(d-1) syndrome and d(d-1) flag nodes: a flag sits between data nodes of a
    row, a syndrome between rows, joined to the data node above or below and to the flags beside it."""
    _odd(d)
    data, n = d * d, d * d + 2 * d * (d - 1)
    if d == 1:
        return empty_graph(spark, 1, multigraph, directed)
    synd, flag = data, data + d * (d - 1)
    e = spark.range(d * (d - 1))
    i, j = F.expr(f"id div {d - 1}"), F.col("id") % (d - 1)
    f = F.col("id") + flag
    one = e.select("id", F.lit(0).alias("k"), (i * d + j).alias("src"), f.alias("dst"))
    two = e.select("id", F.lit(1).alias("k"), f.alias("src"), (i * d + j + 1).alias("dst"))
    # syndrome s = (row r of d-1, column c of d): even rows border the right side, odd rows the left
    r, c = F.expr(f"id div {d}"), F.col("id") % d
    s = F.col("id") + synd
    edge = F.when(r % 2 == 0, d - 1).otherwise(0)
    above = e.select("id", F.lit(2).alias("k"), F.when(c == edge, r * d + edge).otherwise(flag + r * (d - 1) + F.least(c, F.lit(d - 2))).alias("src"), s.alias("dst"))
    below = e.select("id", F.lit(3).alias("k"), s.alias("src"), F.when(c == edge, (r + 1) * d + edge).otherwise(flag + (r + 1) * (d - 1) + F.least(c, F.lit(d - 2))).alias("dst"))
    return _make(spark, n, _numbered(_union([one, two, above, below]), ["k", "id"]), directed, multigraph, None, bidirectional)


def directed_heavy_square_graph(spark, d, bidirectional=False, multigraph=True) -> Graph:
    return heavy_square_graph(spark, d, multigraph, True, bidirectional)


def heavy_hex_graph(spark, d: int, multigraph: bool = True, directed: bool = False, bidirectional: bool = False) -> Graph:
    """(5d*d - 2d - 1)/2 nodes: data, then syndrome, then flag nodes."""
    _odd(d)
    if d == 1:
        return empty_graph(spark, 1, multigraph, directed)
    data = d * d
    n_synd, n_flag = (d - 1) * (d + 1) // 2, d * (d - 1)
    synd, flag = data, data + n_synd
    n = flag + n_flag
    e = spark.range(n_flag)
    i, j = F.expr(f"id div {d - 1}"), F.col("id") % (d - 1)
    f = F.col("id") + flag
    parts = [e.select("id", F.lit(0).alias("k"), (i * d + j).alias("src"), f.alias("dst")), e.select("id", F.lit(1).alias("k"), f.alias("src"), (i * d + j + 1).alias("dst"))]
    # between rows r and r+1: (d-1)/2 syndromes join flags of equal parity, one joins the border's data nodes
    h = (d + 1) // 2
    s = spark.range(n_synd)
    r, c = F.expr(f"id div {h}"), F.col("id") % h
    border = F.when(r % 2 == 0, c == h - 1).otherwise(c == 0)
    col = F.when(r % 2 == 0, 2 * c).otherwise(2 * c - 1)
    side = F.when(r % 2 == 0, d - 1).otherwise(0)
    node = F.col("id") + synd
    parts.append(s.select("id", F.lit(2).alias("k"), F.when(border, r * d + side).otherwise(flag + r * (d - 1) + col).alias("src"), node.alias("dst")))
    parts.append(s.select("id", F.lit(3).alias("k"), node.alias("src"), F.when(border, (r + 1) * d + side).otherwise(flag + (r + 1) * (d - 1) + col).alias("dst")))
    return _make(spark, n, _numbered(_union(parts), ["k", "id"]), directed, multigraph, None, bidirectional)


def directed_heavy_hex_graph(spark, d, bidirectional=False, multigraph=True) -> Graph:
    return heavy_hex_graph(spark, d, multigraph, True, bidirectional)


def hexagonal_lattice_graph(spark, rows: int, cols: int, multigraph: bool = True, periodic: bool = False, with_positions: bool = False, directed: bool = False, bidirectional: bool = False) -> Graph:
    """Hexagons in ``cols`` columns of ``rows``: columns of 2*rows+2 points (2*rows if periodic), the
    first and last without the point that no hexagon uses; rungs join neighbouring columns at points of equal parity."""
    if periodic and (cols % 2 or rows < 2 or cols < 2):
        raise ValueError("a periodic lattice needs an even number of columns and more than one row and column")
    if rows == 0 or cols == 0:
        return empty_graph(spark, 0, multigraph, directed)
    height, width = (2 * rows, cols) if periodic else (2 * rows + 2, cols + 1)
    pts = spark.range(height * width).select(F.expr(f"id div {height}").alias("c"), (F.col("id") % height).alias("r"))
    if not periodic:
        unused = ((F.col("c") == 0) & (F.col("r") == height - 1)) | ((F.col("c") == cols) & (F.col("r") == (0 if cols % 2 == 0 else height - 1)))
        pts = pts.where(~unused)
    pts = number(pts.withColumn("id", F.lit(0)), "id", ["c", "r"])
    up_r = (F.col("r") + 1) % height if periodic else F.col("r") + 1
    over_c = (F.col("c") + 1) % width if periodic else F.col("c") + 1
    ends = pts.select(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("id").alias("dst"))
    along = pts.select(F.col("id").alias("src"), F.col("c").alias("c2"), up_r.alias("r2"), F.lit(0).alias("k")).join(ends, ["c2", "r2"])
    rung = pts.where(F.col("c") % 2 == F.col("r") % 2).select(F.col("id").alias("src"), over_c.alias("c2"), F.col("r").alias("r2"), F.lit(1).alias("k")).join(ends, ["c2", "r2"])
    E = _numbered(along.unionByName(rung).select("k", "src", "dst"), ["k", "src", "dst"])
    g = _make(spark, pts.count(), E, directed, multigraph, None, bidirectional)
    if with_positions:
        x = 0.5 + F.col("c") + F.expr("c div 2") + (F.col("r") % 2) * ((F.col("c") % 2) - 0.5)
        g = g.with_(V=pts.select("id", F.struct(x.cast("double").alias("x"), (F.col("r") * math.sqrt(3) / 2).alias("y")).alias("payload")))
    return g


def directed_hexagonal_lattice_graph(spark, rows, cols, bidirectional=False, multigraph=True, periodic=False, with_positions=False) -> Graph:
    return hexagonal_lattice_graph(spark, rows, cols, multigraph, periodic, with_positions, True, bidirectional)


def lollipop_graph(spark, num_mesh_nodes: int | None = None, num_path_nodes: int | None = None, mesh_weights=None, path_weights=None, multigraph: bool = True) -> Graph:
    m = _size(num_mesh_nodes, mesh_weights)
    p = len(path_weights) if path_weights is not None else num_path_nodes or 0
    tail = spark.range(p).select((F.col("id") + m * (m - 1) // 2).alias("eid"), (F.col("id") + m - 1).alias("src"), (F.col("id") + m).alias("dst"))
    weights = [*(mesh_weights or []), *(path_weights or [])] if mesh_weights is not None or path_weights is not None else None
    return _make(spark, m + p, _pairs(spark, m, False).union(tail), False, multigraph, weights)


def barbell_graph(spark, num_mesh_nodes: int | None = None, num_path_nodes: int | None = None, multigraph: bool = True, mesh_weights=None, path_weights=None) -> Graph:
    m = _size(num_mesh_nodes, mesh_weights)
    p = len(path_weights) if path_weights is not None else num_path_nodes or 0
    one, k = _pairs(spark, m, False), m * (m - 1) // 2
    mid = spark.range(p + 1).select((F.col("id") + k).alias("eid"), (F.col("id") + m - 1).alias("src"), (F.col("id") + m).alias("dst"))
    two = one.select((F.col("eid") + k + p + 1).alias("eid"), (F.col("src") + m + p).alias("src"), (F.col("dst") + m + p).alias("dst"))
    weights = [*(mesh_weights or []), *(path_weights or []), *(mesh_weights or [])] if mesh_weights is not None or path_weights is not None else None
    return _make(spark, 2 * m + p, one.union(mid).union(two), False, multigraph, weights)


def generalized_petersen_graph(spark, n: int, k: int, multigraph: bool = True) -> Graph:
    """Inner nodes 0..n-1 in steps of k, outer nodes n..2n-1 in a ring, spokes between."""
    if n < 3 or k <= 0 or 2 * k >= n:
        raise IndexError("n is 3 or more and k below n/2")
    e = spark.range(n)
    star = e.select(F.col("id").alias("eid"), F.col("id").alias("src"), ((F.col("id") + k) % n).alias("dst"))
    ring = e.select((F.col("id") + n).alias("eid"), (F.col("id") + n).alias("src"), ((F.col("id") + 1) % n + n).alias("dst"))
    spokes = e.select((F.col("id") + 2 * n).alias("eid"), (F.col("id") + n).alias("src"), F.col("id").alias("dst"))
    return _make(spark, 2 * n, star.union(ring).union(spokes), False, multigraph)


def dorogovtsev_goltsev_mendes_graph(spark, n: int) -> Graph:
    """Each round puts a new node over every edge: (3^n + 3)/2 nodes, 3^n edges."""
    if n < 0:
        raise ValueError("n is 0 or more")
    E, size = spark.range(1).select(F.col("id").alias("eid"), F.lit(0).alias("src"), F.lit(1).alias("dst")), 2
    for k in range(n):
        m = 3**k
        eid, new = F.col("eid"), (F.col("eid") + size).cast("bigint").alias("dst")
        edge = lambda e, a, b: F.struct(e.cast("bigint").alias("eid"), F.col(a).cast("bigint").alias("src"), b)
        kept, left, right = edge(eid, "src", F.col("dst").cast("bigint").alias("dst")), edge(eid * 2 + m, "src", new), edge(eid * 2 + m + 1, "dst", new)
        E = E.select(F.inline(F.array(kept, left, right)))
        size += m
    return _make(spark, size, E, False, True)


#: Zachary's karate club, the weighted ties of each member to members of a lower number.
KARATE = {
    1: {0: 4}, 2: {0: 5, 1: 6}, 3: {0: 3, 1: 3, 2: 3}, 4: {0: 3}, 5: {0: 3}, 6: {0: 3, 4: 2, 5: 5}, 7: {0: 2, 1: 4, 2: 4, 3: 3},
    8: {0: 2, 2: 5}, 9: {2: 1}, 10: {0: 2, 4: 3, 5: 3}, 11: {0: 3}, 12: {0: 1, 3: 3}, 13: {0: 3, 1: 5, 2: 3, 3: 3}, 16: {5: 3, 6: 3},
    17: {0: 2, 1: 1}, 19: {0: 2, 1: 2}, 21: {0: 2, 1: 2}, 25: {23: 5, 24: 2}, 27: {2: 2, 23: 4, 24: 3}, 28: {2: 2}, 29: {23: 3, 26: 4},
    30: {1: 2, 8: 3}, 31: {0: 2, 24: 2, 25: 7, 28: 2}, 32: {2: 2, 8: 3, 14: 3, 15: 3, 18: 1, 20: 3, 22: 2, 23: 5, 29: 4, 30: 3, 31: 4},
    33: {8: 4, 9: 2, 13: 3, 14: 2, 15: 4, 18: 2, 19: 1, 20: 1, 22: 3, 23: 4, 26: 2, 27: 4, 28: 2, 29: 2, 30: 3, 31: 4, 32: 5},
}
KARATE_OFFICER = (9, 14, 15, 18, 20, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33)


def karate_club_graph(spark, multigraph: bool = True) -> Graph:
    ties = [(a, b, float(w)) for b, row in KARATE.items() for a, w in row.items()]
    E = spark.createDataFrame([(i, *t) for i, t in enumerate(ties)], "eid bigint, src bigint, dst bigint, payload double")
    V = spark.createDataFrame([(i, "Officer" if i in KARATE_OFFICER else "Mr. Hi") for i in range(34)], "id bigint, payload string")
    return Graph(V, E, False, multigraph)


# --- random ------------------------------------------------------------------------------------


def _unit(seed: int | None, *keys: Column) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the keys alone."""
    return F.xxhash64(F.lit(seed or 0), *keys).bitwiseAND(F.lit(2**53 - 1)) / float(2**53)


def _share(p: float) -> None:
    if not 0 <= p <= 1:
        raise ValueError("a probability lies between 0 and 1")


#: The chance of a pair from which on all pairs are looked at.
DENSE = 1 / 64


def gnp_random_graph(spark, num_nodes: int, probability: float, seed: int | None = None, directed: bool = False) -> Graph:
    """Each pair by itself. From DENSE on every pair is looked at, which takes less than a gap; below it pair numbers are drawn by
    geometric gaps inside blocks, so the work follows the edges and not the pairs."""
    _share(probability)
    n = num_nodes
    if probability in (0.0, 1.0):
        return complete_graph(spark, n, directed=directed) if probability else empty_graph(spark, n, directed=directed)
    if probability >= DENSE:
        box = _strips(spark, (0, n), (0, n), None if directed else 1).where("src != dst")
        return _drawn(spark, n, box.where(_unit(seed, F.col("src"), F.col("dst")) < probability), directed, dense=True)
    total = n * (n - 1) if directed else n * (n - 1) // 2
    block = max(1, int(64 / probability))
    gaps = 64 + 12 * 8  # mean 64 with 12 deviations of room; the last gaps run past the block
    starts = spark.range((total + block - 1) // block if total else 0)
    walk = F.expr(f"transform(sequence(1, {gaps}), i -> cast(floor(ln(1 - pmod(xxhash64({seed or 0}, id, i), {2**53}) / {float(2**53)!r}D) / {math.log1p(-probability)!r}D) AS bigint) + 1)")
    at = F.expr("aggregate(g, named_struct('p', -1L, 'o', cast(array() AS array<bigint>)), (a, x) -> named_struct('p', a.p + x, 'o', array_append(a.o, a.p + x)), a -> a.o)")
    picked = starts.withColumn("g", walk).select("id", F.explode(at).alias("q")).where(F.col("q") < block).select((F.col("id") * block + F.col("q")).alias("k")).where(F.col("k") < total)
    return _drawn(spark, n, _unpair(picked, n, directed), directed)


def _unpair(picked: DataFrame, n: int, ordered: bool) -> DataFrame:
    """src, dst of pair numbers ``k``."""
    if ordered:
        i, j = F.expr(f"k div {max(1, n - 1)}"), F.col("k") % max(1, n - 1)
        return picked.select(i.alias("src"), F.when(j >= i, j + 1).otherwise(j).alias("dst"))
    first = lambda i: F.expr(f"({i}) * ({2 * n - 1} - ({i})) div 2")
    g = F.floor((2 * n - 1 - F.sqrt(F.lit((2.0 * n - 1) ** 2) - 8 * F.col("k"))) / 2).cast("bigint")
    q = picked.withColumn("g", g).withColumn("i", F.when(first("g + 1") <= F.col("k"), F.col("g") + 1).when(first("g") > F.col("k"), F.col("g") - 1).otherwise(F.col("g")))
    return q.select(F.col("i").alias("src"), (F.col("k") - first("i") + F.col("i") + 1).alias("dst"))


def undirected_gnp_random_graph(spark, num_nodes, probability, seed=None) -> Graph:
    return gnp_random_graph(spark, num_nodes, probability, seed)


def directed_gnp_random_graph(spark, num_nodes, probability, seed=None) -> Graph:
    return gnp_random_graph(spark, num_nodes, probability, seed, True)


def gnm_random_graph(spark, num_nodes: int, num_edges: int, seed: int | None = None, directed: bool = False) -> Graph:
    """Exactly m different pairs: draws are made distinct and topped up; beyond half of all pairs the complement is drawn."""
    n = num_nodes
    total = n * (n - 1) if directed else n * (n - 1) // 2
    if num_edges >= total:
        return complete_graph(spark, n, directed=directed)
    few = num_edges if num_edges <= total // 2 else total - num_edges
    got, extra = None, few
    for turn in range(64):
        new = spark.range(extra + 16).select(F.pmod(F.xxhash64(F.lit(seed or 0), F.lit(turn), F.col("id")), F.lit(total)).alias("k"))
        got = new.distinct() if got is None else got.union(new).distinct()
        have = got.count()
        if have >= few:
            break
        extra = 2 * (few - have)
    got = got.orderBy(F.xxhash64(F.lit(seed or 0), F.col("k")), "k").limit(few)
    if few != num_edges:
        got = spark.range(total).select(F.col("id").alias("k")).join(got, "k", "left_anti")
    return _make(spark, n, _numbered(_unpair(got, n, directed), ["src", "dst"]), directed, True)


def undirected_gnm_random_graph(spark, num_nodes, num_edges, seed=None) -> Graph:
    return gnm_random_graph(spark, num_nodes, num_edges, seed)


def directed_gnm_random_graph(spark, num_nodes, num_edges, seed=None) -> Graph:
    return gnm_random_graph(spark, num_nodes, num_edges, seed, True)


def sbm_random_graph(spark, sizes: list[int], probabilities, loops: bool, seed: int | None = None, directed: bool = False) -> Graph:
    """Blocks of nodes; a pair's chance is that of its two blocks."""
    k, n = len(sizes), sum(sizes)
    p = [[float(x) for x in row] for row in probabilities]
    if len(p) != k or any(len(r) != k for r in p):
        raise ValueError("the matrix must have a row and a column per block")
    for row in p:
        for x in row:
            _share(x)
    if not directed and any(abs(p[a][b] - p[b][a]) > 1e-12 for a in range(k) for b in range(k)):
        raise ValueError("the matrix must be symmetric")
    ends = [sum(sizes[: i + 1]) for i in range(k)]
    pairs = [spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))]
    for a in range(k):
        for b in range(0 if directed else a, k):
            if p[a][b]:  # no pair is drawn where none can be
                box = _strips(spark, (ends[a] - sizes[a], ends[a]), (ends[b] - sizes[b], ends[b]), 0 if a == b and not directed else None)
                box = box if loops or a != b else box.where("src != dst")
                pairs.append(box if p[a][b] == 1 else box.where(_unit(seed, F.col("src"), F.col("dst")) < p[a][b]))
    return _drawn(spark, n, _union(pairs), directed)


def undirected_sbm_random_graph(spark, sizes, probabilities, loops, seed=None) -> Graph:
    return sbm_random_graph(spark, sizes, probabilities, loops, seed)


def directed_sbm_random_graph(spark, sizes, probabilities, loops, seed=None) -> Graph:
    return sbm_random_graph(spark, sizes, probabilities, loops, seed, True)


def random_bipartite_graph(spark, num_l_nodes: int, num_r_nodes: int, probability: float, seed: int | None = None, directed: bool = False) -> Graph:
    _share(probability)
    q = spark.range(num_l_nodes * num_r_nodes).select(F.expr(f"id div {max(1, num_r_nodes)}").alias("src"), (F.col("id") % max(1, num_r_nodes) + num_l_nodes).alias("dst"))
    q = q.where(_unit(seed, F.col("src"), F.col("dst")) < probability)
    return _make(spark, num_l_nodes + num_r_nodes, _numbered(q, ["src", "dst"]), directed, True)


def undirected_random_bipartite_graph(spark, num_l_nodes, num_r_nodes, probability, seed=None) -> Graph:
    return random_bipartite_graph(spark, num_l_nodes, num_r_nodes, probability, seed)


def directed_random_bipartite_graph(spark, num_l_nodes, num_r_nodes, probability, seed=None) -> Graph:
    return random_bipartite_graph(spark, num_l_nodes, num_r_nodes, probability, seed, True)


def random_regular_graph(spark, num_nodes: int, degree: int, seed: int | None = None) -> Graph:
    """Stubs are paired at random; pairs that make a loop or a double edge are drawn again with others."""
    import random

    if num_nodes * degree % 2:
        raise ValueError("nodes times degree must be even")
    if degree >= num_nodes:
        raise ValueError("the degree must be below the number of nodes")
    rng = random.Random(seed)
    while True:
        edges: set[tuple[int, int]] = set()
        stubs = [v for v in range(num_nodes) for _ in range(degree)]
        stuck = 0
        while stubs and stuck < 100:
            rng.shuffle(stubs)
            left = []
            for a, b in zip(stubs[::2], stubs[1::2], strict=True):
                e = (min(a, b), max(a, b))
                if a == b or e in edges:
                    left += [a, b]
                else:
                    edges.add(e)
            stuck = stuck + 1 if len(left) == len(stubs) else 0
            stubs = left
        if not stubs:
            break
    E = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sorted(edges))], "eid bigint, src bigint, dst bigint")
    g = _make(spark, num_nodes, E, False, True)
    return g.with_(V=spark.range(num_nodes).select("id", F.col("id").cast("string").alias("payload")))


def random_geometric_graph(spark, num_nodes: int, radius: float, dim: int = 2, pos=None, p: float = 2.0, seed: int | None = None) -> Graph:
    """Points in the unit cube, or ``pos`` (lists of coordinates, or a table (id, pos)), joined if their Lp distance is below
    the radius: cells as wide as the radius are joined with their neighbours by equality, then distances are tested."""
    if pos is not None:
        pts = _points(spark, pos)
        first = pts.head()
        dim = dim if first is None else len(first.pos)
    else:
        pts = spark.range(num_nodes).select("id", F.array(*(_unit(seed, F.col("id"), F.lit(k)) for k in range(dim))).alias("pos"))
    return _make_geometric(spark, pts, radius, dim, p)


def _make_geometric(spark, pts: DataFrame, radius: float, dim: int, p: float) -> Graph:
    cells = pts.withColumn("cell", F.transform("pos", lambda x: F.floor(x / radius)))
    around = F.expr("array(array())").cast("array<array<bigint>>")

    def grown(k: int):
        near = F.array(F.lit(-1), F.lit(0), F.lit(1))
        return lambda a: F.transform(near, lambda d: F.array_append(a, F.element_at(F.col("cell"), k) + d))

    for k in range(1, dim + 1):
        around = F.flatten(F.transform(around, grown(k)))
    a = cells.select(F.col("id").alias("src"), F.col("pos").alias("x"), F.explode(around).alias("cell"))
    b = cells.select(F.col("id").alias("dst"), F.col("pos").alias("y"), "cell")
    far = maximum_distance(F.col("x"), F.col("y")) if math.isinf(p) else lp_distance(F.col("x"), F.col("y"), p)
    if p == 2.0 and dim:
        far = F.sqrt(F.expr(" + ".join(f"(y[{k}] - x[{k}]) * (y[{k}] - x[{k}])" for k in range(dim))))
    return _Unnumbered(pts.select("id", F.struct("pos").alias("payload")), a.join(b, "cell").where("src < dst").where(far < radius).select("src", "dst"), False)


def hyperbolic_random_graph(spark, pos, r: float, beta: float | None = None, seed: int | None = None) -> Graph:
    """Points of the hyperboloid; joined below the distance r, or by a chance that falls with it.

    ``pos``: lists of coordinates, or a table (id, pos). Without ``beta`` radial bands and directions give the candidates
    (:func:`_near_on_hyperboloid`). With it every pair has a chance of its own, so all pairs are drawn.
    """
    if r <= 0 or beta is not None and beta < 0:
        raise ValueError("r is positive, beta is not negative")
    pts = _points(spark, pos)
    if beta is None:
        pairs = _near_on_hyperboloid(pts, r)
    else:
        a, b = (pts.select(F.col("id").alias(i), F.col("pos").alias(x)) for i, x in (("src", "x"), ("dst", "y")))
        pairs = a.join(b, F.expr("src < dst"))
    d = hyperboloid_hyperbolic_distance(F.col("x"), F.col("y"))
    keep = d < r if beta is None else _unit(seed, F.col("src"), F.col("dst")) < 1 / (F.exp(beta / 2 * (d - r)) + 1)
    return _Unnumbered(pts.select("id", F.lit(None).cast("string").alias("payload")), pairs.where(keep).select("src", "dst"), False)


def _points(spark, pos) -> DataFrame:
    """id, pos from lists of coordinates, or from a table of these columns."""
    if isinstance(pos, DataFrame):
        return pos.select(F.col("id").cast("bigint").alias("id"), F.col("pos").cast("array<double>").alias("pos"))
    return spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(pos)], "id bigint, pos array<double>")


#: Points of a band and slice of directions, on average.
SLICE = 32


def _near_on_hyperboloid(pts: DataFrame, r: float) -> DataFrame:
    """src < dst with positions x, y: pairs that hold all nearer than ``r``.

    Points fall into bands of their radius (the distance from the origin), and inside a band into slices of their
    direction. Two points nearer than r differ by less than r in radius, and by no more in angle than the law of
    cosines allows at the most favourable radius of the other's band; a point meets the slices within that angle. In two
    dimensions the direction is the angle itself; in others the first coordinate of the unit vector, which
    differs by no more than the chord. Slices are as many as let SLICE points share one on average.
    """
    height = min(r / 2, 1.0)
    norm = F.sqrt(F.aggregate("pos", F.lit(0.0), lambda s, x: s + x * x))
    at = pts.withColumn("rho", F.asinh(norm)).withColumn("n", norm)
    plane = F.size("pos") == 2
    turn = F.when(plane, F.atan2(F.get("pos", 1), F.get("pos", 0)) / (2 * math.pi) + 0.5).otherwise((F.get("pos", 0) / F.col("n") + 1) / 2)
    at = at.withColumns({"t": F.when(F.col("n") > 0, turn).otherwise(0.5), "band": F.floor(F.col("rho") / height), "plane": plane})
    at = checkpoint(at.select("id", "pos", "rho", "t", "band", "plane"))
    bands = at.groupBy("band").agg(F.ceil(F.count("*") / SLICE).cast("bigint").alias("slices"))
    # bands within reach, and in each the widest angle: cos = (cosh a cosh b - cosh r) / (sinh a sinh b) is least at cosh b = cosh a / cosh r
    span = F.sequence(F.greatest(F.lit(0), F.floor((F.col("rho") - r) / height) - 1), F.floor((F.col("rho") + r) / height) + 1)
    seen = at.select("*", F.explode(span).alias("of")).drop("band").withColumnRenamed("of", "band").join(bands, "band")
    low, high = F.col("band") * height, (F.col("band") + 1) * height
    best = F.acosh(F.greatest(F.lit(1.0), F.cosh("rho") / math.cosh(r)))

    def cosine(b):
        ground = F.sinh("rho") * F.sinh(b)
        return F.when(ground > 0, (F.cosh("rho") * F.cosh(b) - math.cosh(r)) / ground).otherwise(-1.0)

    least = F.least(cosine(low), cosine(high), cosine(F.greatest(low, F.least(high, best)))) - 1e-9
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least)))
    wide = F.when(F.col("plane"), angle / (2 * math.pi)).otherwise(F.sin(angle / 2)) + 1e-9
    seen = seen.withColumn("wide", wide).withColumns({"from": F.floor((F.col("t") - F.col("wide")) * F.col("slices")), "to": F.floor((F.col("t") + F.col("wide")) * F.col("slices"))})
    # a circle of slices is met once around at most; on a line the ends are the last slices
    round_ = F.when(F.col("to") - F.col("from") + 1 >= F.col("slices"), F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).otherwise(F.transform(F.sequence("from", "to"), lambda s: F.pmod(s, F.col("slices"))))
    line = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.least("from", F.col("slices") - 1)), F.greatest(F.lit(0).cast("bigint"), F.least("to", F.col("slices") - 1)))
    a = seen.select(F.col("id").alias("src"), F.col("pos").alias("x"), "band", F.explode(F.when(F.col("plane"), round_).otherwise(line)).alias("slice"))
    own = F.least(F.floor(F.col("t") * F.col("slices")), F.col("slices") - 1)
    b = at.join(bands, "band").select(F.col("id").alias("dst"), F.col("pos").alias("y"), "band", own.alias("slice"))
    return a.join(b, ["band", "slice"]).where("src < dst").select("src", "dst", "x", "y")


def barabasi_albert_graph(spark, n: int, m: int, seed: int | None = None, initial_graph: Graph | None = None, directed: bool = False) -> Graph:
    """Nodes arrive one by one with m edges to nodes drawn by degree: sequential by definition, built on the driver."""
    import random

    if m < 1 or m >= n:
        raise ValueError("m is 1 or more and below n")
    rng = random.Random(seed)
    if initial_graph is None:
        edges, at = [(0, i) for i in range(1, m)], m  # a star of m nodes
    else:
        at = initial_graph.num_nodes()
        if not m <= at <= n:
            raise ValueError("the initial graph must have at least m nodes and at most n")
        edges = [(r.src, r.dst) for r in initial_graph.E.select("src", "dst").collect()]
    ends = [v for e in edges for v in e]
    for v in range(at, n):
        to: set[int] = set()
        if v < at + 2 * m:  # few nodes have an edge yet; where they are too few, the others are as good
            some = sorted(set(ends))
            if len(some) < m:
                to = {*some, *rng.sample(sorted(set(range(v)) - set(some)), m - len(some))}
        while len(to) < m:
            to.add(rng.choice(ends))
        for x in sorted(to):
            edges.append((v, x))
            ends += [v, x]
    E = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "eid bigint, src bigint, dst bigint")
    return _make(spark, max(n, at), E, directed, True)


def directed_barabasi_albert_graph(spark, n, m, seed=None, initial_graph=None) -> Graph:
    return barabasi_albert_graph(spark, n, m, seed, initial_graph, True)
