"""Isomorphism of large graphs: colours of both graphs are refined together until they tell vertices apart.

A vertex's colour is a hash of its old one and of the colours around it, taken as a multiset, so vertices that an
isomorphism maps to each other always share a colour. Vertices that colours cannot tell apart are told apart by choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.graph import Graph, condition
from weftgraph.plans.fixpoint import checkpoint, handy, hot_keys, meet, written


def isomorphism(first: Graph, second: Graph, node_key: Column | str | None = None, edge_key: Column | str | None = None) -> DataFrame | None:
    """id, other: an isomorphism of ``first`` to ``second``, or None where there is none. ``node_key`` and ``edge_key`` are
    columns over the rows of V and E; vertices and edges that are mapped to each other have equal ones (null equals null).

    Both graphs are coloured as one table. Of a class whose neighbours all have colours of their own, the members are
    interchangeable and are paired by rank. Of the smallest other class one vertex of ``first`` is paired with each
    candidate of ``second`` in turn, and colours are refined again. The pairing that is left when each colour has one
    vertex a graph is held against all edges, so hash collisions cannot make it wrong.
    """
    if first.directed != second.directed:
        raise TypeError("both graphs must be of one kind")
    key = lambda k: F.lit(0).cast("bigint") if k is None else F.xxhash64(condition(k, F.col("payload")))
    sides = [(0, first), (1, second)]
    V = [g.V.select(F.lit(s).alias("g"), "id", key(node_key).alias("c")) for s, g in sides]
    a, b = (F.col("src"), F.col("dst")) if first.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    links = [g.E.select(a.alias("src"), b.alias("dst"), key(edge_key).alias("k")).groupBy(F.lit(s).alias("g"), "src", "dst", "k").agg(F.count("*").alias("m")) for s, g in sides]
    links = written(links[0].union(links[1]))
    if not _balanced(links, "k", F.sum("m")):
        return None
    return _search(written(V[0].union(V[1])), links, _Whole(links, first.directed))


class _Whole:
    """All links (g, src, dst, k, m: edges of a key between two vertices, the lesser first if undirected) and their hubs."""

    def __init__(self, links: DataFrame, directed: bool):
        self.links, self.directed = links, directed
        self.hubs = {c: hot_keys(links.select(F.struct("g", F.col(c).alias("id")).alias("v")), "v") for c in ("src", "dst")}


def _balanced(rows: DataFrame, by: str, total: Column) -> bool:
    """Whether both graphs have as much of everything."""
    one = rows.groupBy("g", by).agg(total.alias("t"))
    return one.groupBy(by, "t").agg(F.sum(F.when(F.col("g") == 0, 1).otherwise(-1)).alias("d")).where("d != 0").isEmpty()


def _refined(colours: DataFrame, links: DataFrame, whole: _Whole) -> tuple[DataFrame, DataFrame] | None:
    """g, id, c with stable colours, and what the next call needs of ``links``; None once the graphs differ in how often a colour occurs.

    The colour of a single vertex a graph stays as it is, so a round needs the links of the other vertices only.
    """
    n, least = -1, colours.count()
    while True:
        sizes = written(colours.groupBy("c").agg(F.sum(1 - F.col("g")).alias("n"), F.count("*").alias("both")))
        if not sizes.where("2 * n != both").isEmpty():
            return None
        k = sizes.count()
        if k == n:
            return colours, links
        n = k
        parted = written(meet(colours, sizes.select("c", "n"), "c").select("g", "id", "c", "n"))
        loose = parted.where("n > 1").select("g", "id", "c")
        left = loose.count()
        if not left:
            return colours, links
        if 2 * left <= least:
            links, least = _touching(links, loose, left), left
        rows = []
        for near, far in (("dst", "src"), ("src", "dst")):
            seen = links.select("k", "m", F.struct("g", F.col(near).alias("id")).alias("v"), F.col(far).alias("id"))
            if k == 1:
                seen = seen.withColumn("c", F.lit(sizes.head().c))
            else:
                seen = meet(seen, colours.select(F.struct("g", "id").alias("v"), "c").hint("shuffle_hash"), "v", whole.hubs[near])
            h = F.xxhash64("c", "k", "m", F.lit(near if whole.directed else "")).alias("h")
            rows.append(seen.select(F.col("v.g").alias("g"), "id", h))
        # both halves of the hashes are added up: sums do not depend on the order
        sums = rows[0].union(rows[1]).groupBy("g", "id").agg(F.sum(F.col("h").bitwiseAND(F.lit(2**31 - 1))).alias("a"), F.sum(F.shiftrightunsigned("h", 33)).alias("b"))
        new = loose.join(sums, ["g", "id"], "left").select("g", "id", F.xxhash64("c", "a", "b").alias("c"))
        colours = written(new.union(parted.where("n = 1").select("g", "id", "c")))


def _touching(links: DataFrame, loose: DataFrame, count: int) -> DataFrame:
    """``links`` of which an end is in ``loose`` (g, id and more columns)."""
    for c in ("src", "dst"):
        links = links.join(handy(loose.select("g", F.col("id").alias(c), F.lit(True).alias(f"_{c}")), count), ["g", c], "left")
    return written(links.where("_src OR _dst").select("g", "src", "dst", "k", "m"))


def _twins(colours: DataFrame, links: DataFrame) -> DataFrame | None:
    """Colours with the rank added inside classes of several vertices a graph of which no member has a neighbour, itself
    included, in such a class; None if there is no such class."""
    several = colours.where("g = 0").groupBy("c").count().where("count > 1").select("c")
    loose = checkpoint(colours.join(several, "c", "left_semi").select("g", "id", "c"))
    pairs = links.where("g = 0").select("src", "dst")
    near = loose.where("g = 0")
    both = pairs.join(near.select(F.col("id").alias("src"), F.col("c").alias("x")), "src").join(near.select(F.col("id").alias("dst"), F.col("c").alias("y")), "dst")
    tied = both.select(F.col("x").alias("c")).union(both.select("y")).distinct()
    free = checkpoint(loose.join(tied, "c", "left_anti"))
    if free.isEmpty():
        return None
    # many twins of one colour may hang from a hub: their ranks come from sorted ranges, not from one window
    ranked = _rank(free)
    return checkpoint(colours.join(free.select("g", "id"), ["g", "id"], "left_anti").select("g", "id", "c").union(ranked.select("g", "id", F.xxhash64("c", "r").alias("c"))))


def _rank(rows: DataFrame) -> DataFrame:
    """g, id, c, r: place among the rows of (g, c) by id, from numbers of all rows less the least of the class."""
    from weftgraph.graph import number

    placed = checkpoint(number(rows.withColumn("r", F.lit(0)), "r", ["g", "c", "id"]))
    least = placed.groupBy("g", "c").agg(F.min("r").alias("low"))
    return placed.join(least, ["g", "c"]).select("g", "id", "c", (F.col("r") - F.col("low")).alias("r"))


def _search(colours: DataFrame, links: DataFrame, whole: _Whole) -> DataFrame | None:
    while True:
        stable = _refined(colours, links, whole)
        if stable is None:
            return None
        colours, links = stable
        ranked = _twins(colours, links)
        if ranked is None:
            break
        colours = ranked
    classes = colours.where("g = 0").groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    tied = classes.where("n > 1").orderBy("n", "id").head()
    if tied is None:
        return _verified(colours, whole)
    # one vertex is set apart, and each of the other graph's that it may go to is tried
    options = colours.where((F.col("g") == 1) & (F.col("c") == tied.c)).select("id").orderBy("id")
    for other in options.toLocalIterator():
        chosen = (F.col("g") == 0) & (F.col("id") == tied.id) | (F.col("g") == 1) & (F.col("id") == other.id)
        found = _search(checkpoint(colours.withColumn("c", F.when(chosen, F.xxhash64("c", F.lit(1))).otherwise(F.col("c")))), links, whole)
        if found is not None:
            return found
    return None


def _verified(colours: DataFrame, whole: _Whole) -> DataFrame | None:
    """Links are different from each other, and so are their images: as many of them, all found, are the same."""
    a, b = (colours.where(F.col("g") == g).select(F.col("id").alias(n), "c") for g, n in ((0, "id"), (1, "other")))
    pairs = written(a.join(b, "c").select("id", "other"))
    one, other = (whole.links.where(F.col("g") == g).select("src", "dst", "k", "m") for g in (0, 1))
    if one.count() != other.count():
        return None
    for c in ("src", "dst"):
        one = meet(one, pairs.select(F.col("id").alias(c), F.col("other").alias(f"_{c}")).hint("shuffle_hash"), c)
    if not whole.directed:
        one = one.withColumns({"_src": F.least("_src", "_dst"), "_dst": F.greatest("_src", "_dst")})
    moved = one.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "k", "m")
    return pairs if moved.join(other, ["src", "dst", "k", "m"], "left_anti").isEmpty() else None
