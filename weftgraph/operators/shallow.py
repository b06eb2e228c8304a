"""Breadth-first forests of components of small diameter: every vertex carries its path from the root.

Where a path has few vertices, what Euler tours and ancestor tables find in many rounds is read from two paths: the lowest
common ancestor of two vertices is the last vertex that their paths begin with alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans import fixpoint as fix
from weftgraph.plans.fixpoint import checkpoint, handy, hot_keys, meet, written

#: Levels below the roots up to which a forest is shallow.
DEEP = 24


def forest(E: DataFrame, roots: DataFrame, n: int) -> DataFrame | None:
    """id, parent, via (edge id), path (from the root to the vertex) of the ``n`` vertices that ``roots`` (id; one per
    component) reach along ``E`` (eid, src, dst; either way); None if one lies more than DEEP levels down.

    A level's arcs are met once each. Neighbours of a level lie in it, before it or after it, so only two levels are
    taken from what it reaches.
    """
    none = F.lit(None).cast("bigint")
    new = checkpoint(roots.select("id", none.alias("parent"), none.alias("via"), F.array("id").alias("path")))
    here = new.count()
    left, levels, hubs = n - here, [new], None
    if left and DEEP:
        ends = E.where("src != dst")
        arcs = written(ends.select("eid", F.col("src").alias("u"), F.col("dst").alias("v")).union(ends.select("eid", "dst", "src")))
    while left and here and len(levels) <= DEEP:
        at = new.select(F.col("id").alias("u"))
        if here <= fix.STATE:
            out = arcs.join(F.broadcast(at), "u")
        else:
            hubs = hot_keys(arcs, "u") if hubs is None else hubs
            out = meet(arcs, at, "u", hubs)
        found = out.groupBy(F.col("v").alias("id")).agg(F.min(F.struct("u", "eid")).alias("m"))
        for level in levels[-2:]:
            found = found.join(level.select("id"), "id", "left_anti")
        found = checkpoint(found.select("id", F.col("m.u").alias("parent"), F.col("m.eid").alias("via")))
        above = new.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        below = found.join(handy(above, here), "parent") if here <= fix.STATE else meet(found, above, "parent")
        new = checkpoint(below.select("id", "parent", "via", F.array_append("above", F.col("id")).alias("path")))
        here = new.count()
        left -= here
        levels.append(new)
    if left:
        return None
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    return written(every)


def common(p: str, q: str) -> Column:
    """How many vertices two paths begin with alike."""
    return F.expr(f"aggregate(sequence(0, least(size({p}), size({q})) - 1), 0, (s, i) -> s + int({p}[i] = {q}[i]))")


def between(rest: DataFrame, tree: DataFrame) -> DataFrame:
    """``rest`` (src, dst and more columns) with p and q, the paths of src and dst."""
    paths = tree.select("id", "path")
    many = {end: hot_keys(rest, end) for end in ("src", "dst")}
    for end, path in (("src", "p"), ("dst", "q")):
        rest = meet(rest, paths.select(F.col("id").alias(end), F.col("path").alias(path)), end, many[end])
    return rest


def pairs(E: DataFrame) -> DataFrame:
    """a < b, the ends of every edge but loops, as a table."""
    return written(E.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))


def flood(ends: DataFrame, roots: DataFrame, left: int, most: int) -> tuple[list[DataFrame], int]:
    """The breadth-first levels (id, parent) of ``roots`` (id; at most one per component) along ``ends`` (a, b), ``most`` below the
    roots at most, the last one empty where there are fewer; and how many of ``left`` vertices they lack."""
    levels = [written(roots.select("id", F.lit(None).cast("bigint").alias("parent")))]
    here = levels[0].count()
    left, hubs = left - here, None
    while left > 0 and here and len(levels) <= most:
        if here > fix.IDS and hubs is None:
            hubs = {c: hot_keys(ends, c) for c in "ab"}
        out = []
        for near, far in ("ab", "ba"):
            at = levels[-1].select(F.col("id").alias(near))
            hit = ends.join(F.broadcast(at), near) if here <= fix.IDS else meet(ends, at, near, hubs[near])
            out.append(hit.select(F.col(far).alias("id"), F.col(near).alias("parent")))
        found = out[0].union(out[1]).groupBy("id").agg(F.min("parent").alias("parent"))
        for level in levels[-2:]:
            found = found.join(level.select("id"), "id", "left_anti")
        levels.append(written(found))
        here = levels[-1].count()
        left -= here
    return levels, left


def joined(levels: list[DataFrame]) -> DataFrame:
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    return every


def hung(ends: DataFrame, roots: DataFrame, n: int) -> DataFrame | None:
    """id, parent, path of the ``n`` vertices that ``roots`` reach along ``ends``, as :func:`forest` has them; None if one lies more than DEEP levels down."""
    levels, left = flood(ends, roots, n, DEEP)
    if left:
        return None
    paths = [written(levels[0].select("id", "parent", F.array("id").alias("path")))]
    for level in levels[1:]:
        above, count = paths[-1].select(F.col("id").alias("parent"), F.col("path").alias("above")), paths[-1].count()
        below = level.join(handy(above, count), "parent") if count <= fix.STATE else meet(level, above, "parent")
        paths.append(written(below.select("id", "parent", F.array_append("above", F.col("id")).alias("path"))))
    return joined(paths)


def covered(ends: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """id, parent, at, up, name of all but the roots. ``at`` is the vertex's place on its path and ``name`` its part in the graph without
    the edges between parents and children. ``up`` is the place of the highest common ancestor of a part that the
    vertex's subtree meets and that reaches beyond it; null where none does.

    In a breadth-first forest an edge outside joins no vertex to its ancestor, so its cycle holds the edges above both its
    ends: edges outside that hang together lie in one block, and close what any links between the same vertices would. So
    a part counts as one, however many edges it has.
    """
    from weftgraph.operators.components import labels

    up = tree.where("parent IS NOT NULL").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    rest = written(ends.join(fix.lent(up, n, ends), ["a", "b"], "left_anti"))
    none = F.lit(None).cast("string").alias("payload")
    part = labels(Graph(tree.select("id", none), rest.select(F.lit(0).cast("bigint").alias("eid"), F.col("a").alias("src"), F.col("b").alias("dst"), none)))
    spots = written(tree.join(part.withColumnRenamed("component", "name"), "id"))
    # what the least and the greatest path begin with, all between begin with
    tops = spots.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("p"), F.max("path").alias("q")).where("n > 1")
    tops = written(tops.select("name", common("p", "q").alias("k")))
    over = meet(spots.select("name", "path"), tops, "name").select(F.explode(F.expr("slice(path, k + 1, size(path) - k)")).alias("id"), "k")
    over = over.groupBy("id").agg(F.min("k").alias("up"))
    down = spots.where("parent IS NOT NULL").join(over, "id", "left")
    return written(down.select("id", "parent", F.size("path").alias("at"), "up", "name"))


def bridges(graph: Graph, ends: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """src, dst of edges between parent and child that no cycle covers and that have no parallel."""
    cut = covered(ends, tree, n).where("up IS NULL").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    cut, both = written(cut), graph.E.select("src", "dst", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    found = both.join(fix.lent(cut, cut.count(), ends), ["a", "b"])
    return found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("src").alias("src"), F.min("dst").alias("dst")).where("n = 1").select("src", "dst")


def blocks(ends: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """id, parent, at, block of all but the roots: the block of the edge to the parent, and of every edge to a vertex no deeper."""
    from weftgraph.operators.components import labels

    down = covered(ends, tree, n)
    links = meet(down.where("up < at - 1").select("parent", F.col("name").alias("src")), down.select(F.col("id").alias("parent"), F.col("name").alias("dst")), "parent")
    links = written(links.where("src != dst").select("src", "dst").distinct().withColumn("eid", F.lit(0).cast("bigint")))
    if links.isEmpty():
        return down.select("id", "parent", "at", F.col("name").alias("block"))
    same = written(labels(Graph.from_edges(links)).select(F.col("id").alias("name"), F.col("component").alias("block")))
    named = down.join(F.broadcast(same), "name", "left") if same.count() <= fix.STATE else down.join(same, "name", "left")
    return written(named.select("id", "parent", "at", F.coalesce("block", "name").alias("block")))


def of_edges(E: DataFrame, down: DataFrame, roots: DataFrame) -> DataFrame:
    """eid, src, dst, block of the edges ``E`` but loops: the child's block between a parent and a child, elsewhere that of both ends.
    Where most vertices share a block and the others are few, only those are looked up, and no edge is shuffled."""
    most = down.groupBy("block").count().orderBy(F.desc("count"), "block").head()
    usual = F.lit(None if most is None else most.block).cast("bigint")
    other = down.where(F.col("block") != usual).select("id", "parent", "block")
    few = fix.pays(other.count(), E)
    none = F.lit(None).cast("bigint")
    every = other if few else down.select("id", "parent", "block").union(roots.select("id", none, none)).hint("shuffle_hash")
    E = E.where("src != dst").select("eid", "src", "dst")
    hubs = None if few else {end: hot_keys(E, end) for end in ("src", "dst")}
    for end, p, b in (("src", "pu", "bu"), ("dst", "pv", "bv")):
        spots = every.select(F.col("id").alias(end), F.col("parent").alias(p), F.col("block").alias(b))
        E = E.join(F.broadcast(spots), end, "left") if few else meet(E, spots, end, hubs[end])
    block = F.when(F.col("pu") == F.col("dst"), F.col("bu")).when(F.col("pv") == F.col("src"), F.col("bv")).when(F.col("bu") == F.col("bv"), F.col("bu")).otherwise(usual)
    return written(E.select("eid", "src", "dst", block.alias("block")))


def cycles(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """cycle of each of ``pairs`` (eid, src, dst) outside the forest: from src up to the common ancestor and down to dst."""
    rest = pairs.join(tree.select(F.col("via").alias("eid")).where("eid IS NOT NULL"), "eid", "left_anti").select("src", "dst")
    both = between(checkpoint(rest), tree).withColumn("k", common("p", "q"))
    return both.select(F.expr("concat(reverse(slice(p, k, size(p) - k + 1)), slice(q, k + 1, size(q) - k))").alias("cycle"))
