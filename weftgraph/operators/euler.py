"""Rooted forests of any depth: Euler tours ranked by pointer doubling, subtree ranges, ancestor tables.

A tree's edges, taken in both directions, are one closed walk: after the arc into a vertex comes the next arc out of
it. Walks of all trees are hung behind one another; the place of every arc follows by pointer doubling in
O(log n) rounds, whatever the depth. An arc that comes before its twin leads down, which gives parents,
numbers in preorder and subtree sizes: a subtree is a range of preorder numbers, and "ancestor of" a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import number
from weftgraph.plans.fixpoint import checkpoint, meet


def rooted(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """id, parent, via (edge id), pre, size, depth of every vertex of a forest ``tree`` (eid, src, dst) without parallel
    edges, hung from ``roots`` (id; one per tree). Roots have neither parent nor via. Preorder numbers are dense
    over all trees; roots of trees without edges stand alone."""
    arcs = tree.select("eid", F.col("src").alias("u"), F.col("dst").alias("v")).union(tree.select("eid", "dst", "src"))
    arcs = checkpoint(number(arcs.withColumn("i", F.lit(0)), "i", ["u", "v"]))
    total = arcs.count()
    firsts = arcs.groupBy("u").agg(F.min("i").alias("first"))
    ahead = arcs.join(arcs.select((F.col("i") - 1).alias("i"), F.col("u").alias("nu")), "i", "left")
    after = ahead.where("nu = u").select("i", (F.col("i") + 1).alias("next"))
    after = after.union(ahead.where("NOT nu <=> u").join(firsts, "u").select("i", "first"))  # one row per vertex: round to its first arc
    twins = checkpoint(arcs.join(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("i").alias("t")), ["u", "v"]))
    walk = twins.select("i", "t").join(after.withColumnRenamed("i", "t"), "t").select("i", "next")
    starts = roots.select("id").join(firsts.withColumnRenamed("u", "id"), "id", "left")
    starts = checkpoint(number(starts.withColumns({"r": F.lit(0), "lone": F.col("first").isNull()}), "r", ["lone", "first"]))
    used = starts.where("first IS NOT NULL")
    onward = used.join(used.select((F.col("r") - 1).alias("r"), F.col("first").alias("onto")), "r", "left").select(F.col("first").alias("next"), "onto", F.lit(True).alias("ends"))
    walk = walk.join(onward, "next", "left").select("i", F.when(F.col("ends"), F.col("onto")).otherwise(F.col("next")).alias("next"))
    place = ranked(walk, total).select("i", (total - 1 - F.col("n")).alias("at"))
    place = checkpoint(place)
    down = twins.join(place, "i").join(place.select(F.col("i").alias("t"), F.col("at").alias("back")), "t").where("at < back")
    down = down.select(F.col("v").alias("id"), F.col("u").alias("parent"), F.col("eid").alias("via"), ((F.col("back") - F.col("at") + 1) / 2).cast("bigint").alias("size"), "at")
    # of the arcs up to a vertex's own, ``f`` and itself led down and the others up
    down = number(down.withColumn("f", F.lit(0)), "f", ["at"]).withColumn("depth", 2 * (F.col("f") + 1) - (F.col("at") + 1)).drop("f")
    tops = starts.join(place.select(F.col("i").alias("first"), "at"), "first", "left")
    ends = tops.where("at IS NOT NULL").select((F.col("r") - 1).alias("r"), F.col("at").alias("end"))
    size = F.when(F.col("at").isNull(), 1).otherwise((F.coalesce("end", F.lit(total)) - F.col("at")) / 2 + 1)
    none, before = F.lit(None).cast("bigint"), F.col("at") - 0.5
    tops = tops.join(ends, "r", "left").select("id", none.alias("parent"), none.alias("via"), size.cast("bigint").alias("size"), before.alias("at"), F.lit(0).cast("bigint").alias("depth"))
    both = down.withColumn("at", F.col("at").cast("double")).unionByName(tops).withColumns({"lone": F.col("at").isNull(), "pre": F.lit(0)})
    return checkpoint(number(both, "pre", ["lone", "at", "id"]).select("id", "parent", "via", "pre", "size", "depth"))


def ranked(walk: DataFrame, total: int) -> DataFrame:
    """i, n: steps from each row of ``walk`` (i, next; null at an end) to its end, all at most ``total``.

    Rows that have arrived are kept apart, so null keys never meet in one task.
    """
    state = checkpoint(walk.select("i", "next", F.col("next").isNotNull().cast("bigint").alias("n")))
    for _ in range(max(1, total).bit_length()):
        far = state.select(F.col("i").alias("next"), F.col("next").alias("onto"), F.col("n").alias("m"))
        moved = state.where("next IS NOT NULL").join(far, "next").select("i", F.col("onto").alias("next"), (F.col("n") + F.col("m")).alias("n"))
        state = checkpoint(state.where("next IS NULL").union(moved))
    return state.select("i", "n")


#: Preorder numbers per block of the next level in range minima.
FOUR = 2


def range_extremes(values: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """id, lo, hi: least lo and greatest hi of ``values`` (pos, lo, hi; 0 <= pos < n) in each range of ``ranges``
    (id, start, size).

    Positions are summed up in blocks of 4, 16, ... positions. A range is put together from at most six blocks of
    each size, so every range meets O(log n) rows at any length.
    """
    levels = 0
    while 1 << (FOUR * levels) < n:
        levels += 1
    code = lambda k, b: (k.cast("bigint") * (1 << 56) + b).alias("c")
    at = values.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k"), "pos", "lo", "hi")
    blocks = checkpoint(at.groupBy(code(F.col("k"), F.expr(f"shiftright(pos, {FOUR} * k)"))).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    up = lambda x, k: f"shiftright({x} + shiftleft(1L, {FOUR} * ({k})) - 1, {FOUR} * ({k}))"
    down = lambda x, k: f"shiftright({x}, {FOUR} * ({k}))"
    span = lambda a, b: f"IF({a} < {b}, sequence({a}, {b} - 1), array())"
    s, e, s1, e1 = up("start", "k"), down("(start + size)", "k"), f"4 * {up('start', 'k + 1')}", f"4 * {down('(start + size)', 'k + 1')}"
    pieces = f"IF({s} >= {e}, array(), IF({s1} < {e1}, concat({span(s, s1)}, {span(e1, e)}), {span(s, e)}))"
    taken = ranges.select("id", F.explode(F.expr(f"flatten(transform(sequence(0, {levels}), k -> transform({pieces}, b -> k * {1 << 56}L + b)))")).alias("c"))
    return meet(taken, blocks, "c").groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def lifted(forest: DataFrame) -> list[DataFrame]:
    """Ancestor tables: the k-th has (id, up), the ancestor 2^k steps above where there is one."""
    table = checkpoint(forest.where("parent IS NOT NULL").select("id", F.col("parent").alias("up")))
    out = []
    while not table.isEmpty():
        out.append(table)
        table = checkpoint(meet(table, table.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")))
    return out


def climb(rows: DataFrame, at: str, steps: Column, tables: list[DataFrame]) -> DataFrame:
    """``rows`` with column ``at`` replaced by its ancestor ``steps`` steps above: one join per bit of the steps."""
    rows = rows.withColumn("_s", steps)
    for k, table in enumerate(tables):
        bit = F.col("_s").bitwiseAND(F.lit(1 << k)) > 0
        near = table.select(F.col("id").alias(at), "up")
        moved = meet(rows.where(bit), near, at).withColumn(at, F.col("up")).select(rows.columns)
        rows = checkpoint(rows.where(~bit).union(moved))
    return rows.drop("_s")


def lowest_common_ancestors(pairs: DataFrame, forest: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``pairs`` (u, w and more columns; both in one tree) with ``lca``.

    From u the longest steps come first; a step is taken where it does not yet reach an ancestor of w.
    """
    more = pairs.columns
    spot = forest.select(F.col("id").alias("_c"), F.col("pre").alias("_p"), F.col("size").alias("_z"), F.col("parent").alias("_up"))
    rows = meet(pairs.withColumn("_c", F.col("u")), spot, "_c")
    rows = meet(rows, forest.select(F.col("id").alias("w"), F.col("pre").alias("_w")), "w")
    above = (F.col("_p") <= F.col("_w")) & (F.col("_w") < F.col("_p") + F.col("_z"))
    done = checkpoint(rows.where(above).select(*more, F.col("_c").alias("lca")))
    rows = checkpoint(rows.where(~above).select(*more, "_c", "_w"))
    for table in reversed(tables):
        onto = checkpoint(table.select(F.col("id").alias("_c"), "up").join(spot.select(F.col("_c").alias("up"), "_p", "_z"), "up"))
        tried = meet(rows, onto, "_c").where(~above).select(*more, F.col("up").alias("_c"), "_w")
        # a row that has no such ancestor, or whose ancestor is one of w, stays
        kept = rows.join(tried.select(*more), more, "left_anti")
        rows = checkpoint(kept.unionByName(tried))
    return done.unionByName(meet(rows, spot.select("_c", "_up"), "_c").select(*more, F.col("_up").alias("lca")))
