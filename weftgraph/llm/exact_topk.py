"""Exact top-k search by inner product: cover trees over queries and data, walked together.

Vectors become integers. A bounded sample gives up to NODES pivots, by farthest-first traversal; every row joins its
nearest pivot, queries and data alike, which is the top of the cover tree: nodes with a pivot, a covering radius,
the largest length and the least id. Nodes of many rows (copies of one vector, say) are dealt in blocks by
a hash. For a query node (centre q, radius r) and a data node (centre p, radius s) no product exceeds

    min(q.p + s |q| + r |p| + r s,  longest query * longest row)

A first search sends each query to one block of its own node and of the two nodes of the greatest bound, which gives
each query a k-th score. A second sends it to all blocks of all nodes whose bound reaches the worst k-th score
of its query node. Within a task both sides get their own cover tree; pairs of tree nodes are pruned by the same
bound against the worst k-th score below the query node, ties by the least id. So nothing is approximate:
where spheres overlap too much for pruning, blocks are multiplied out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm._util import Scratch, shipped, slices

#: Fixed value: factor of the integers.
SCALE = 1024
#: Rows from which pivots are chosen, most pivots, rows of a block, queries that meet a block at a time.
SAMPLE, NODES, BLOCK, BATCH = 4096, 512, 4096, 4096
#: Rows of a leaf and most children of a node of the trees within tasks.
LEAF, FAN = 64, 16
#: Below all scores; the id of rows without one, which come last among ties.
LEAST, LAST = -(2**63), 2**63 - 1


def far_apart(x, most: int, until: float = 0.0, first: int = 0):
    """Farthest-first traversal from row ``first``: picked rows, every row's nearest pick (place among the picks)
    and distance. It ends at ``most`` picks or when all rows are within ``until`` of one. Picks are as
    far from each other as the radius that they cover."""
    picks, owner = [first], np.zeros(len(x), np.int64)
    near = ((x - x[first]) ** 2).sum(1)
    while len(picks) < most:
        i = int(near.argmax())
        if near[i] <= until * until:
            break
        d = ((x - x[i]) ** 2).sum(1)
        closer = d < near
        near[closer], owner[closer] = d[closer], len(picks)
        picks.append(i)
    return picks, owner, np.sqrt(near)


class Cover:
    """A cover tree in arrays. Node j holds rows lo[j] to hi[j] of ``order``, its centre is one of them, and
    all lie within radius[j]; its children are kids[j] to kids[j] + fan[j]. The first child has the parent's centre;
    centres of siblings are at least their covering radius apart."""

    def __init__(self, x, ids):
        self.order = np.arange(len(x))
        lo, hi, centre, kids, fan = [0], [len(x)], [0], [0], [0]
        j = 0
        while j < len(lo):
            rows = self.order[lo[j] : hi[j]].copy()
            at = x[rows]
            first = int(np.flatnonzero(rows == centre[j])[0])
            reach = ((at - at[first]) ** 2).sum(1).max()
            if len(rows) > LEAF and reach > 0:
                picks, owner, _ = far_apart(at, FAN, np.sqrt(reach) / 2, first)
                by = np.argsort(owner, kind="stable")
                self.order[lo[j] : hi[j]] = rows[by]
                ends = np.cumsum(np.bincount(owner, minlength=len(picks))) + lo[j]
                kids[j], fan[j] = len(lo), len(picks)
                lo += [lo[j], *ends[:-1]]
                hi += list(ends)
                centre += [int(rows[p]) for p in picks]
                kids += [0] * len(picks)
                fan += [0] * len(picks)
            j += 1
        self.lo, self.hi, self.kids, self.fan = (np.array(a) for a in (lo, hi, kids, fan))
        self.centre = x[np.array(centre)]
        self.length = np.sqrt((self.centre**2).sum(1))
        self.x, self.ids = x[self.order], ids[self.order]
        far = np.sqrt((self.x**2).sum(1))
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(lo, hi, self.centre, strict=True)])
        self.longest = np.array([far[a:b].max() for a, b in zip(lo, hi, strict=True)])
        self.least = np.array([self.ids[a:b].min() for a, b in zip(lo, hi, strict=True)])


def bound(product, q_length, q_radius, q_longest, p_length, p_radius, p_longest):
    """No inner product of two nodes exceeds this whole number; rounding is on the safe side."""
    top = np.minimum(product + p_radius * q_length + q_radius * p_length + q_radius * p_radius, q_longest * p_longest)
    return np.floor(top + 1e-9 * (np.abs(product) + (q_length + q_radius) * (p_length + p_radius)) + 0.25)


def products(a, b):
    """Exact inner products (int64) of whole-numbered rows."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    out = whole(a) @ whole(b).T
    if out.size and max(abs(int(out.max())), abs(int(out.min()))) >= 2**63:
        raise OverflowError("an inner product does not fit a long")
    return out.astype(np.int64)


def dual_search(q: Cover, q_uid, low, low_id, p: Cover, p_uid, k: int):
    """Per query (in the tree's order) the k best rows of ``p`` that are not worse than (low, low_id): places, scores."""
    n = len(q.x)
    score, place = np.full((n, k), LEAST), np.full((n, k), -1)
    worst, worst_id = low.copy(), low_id.copy()  # what a row must reach: a greater score, or the same and no greater id

    def hopeless(i, top, least):
        rows = slice(q.lo[i], q.hi[i])
        return bool(((top < worst[rows]) | ((top == worst[rows]) & (least > worst_id[rows]))).all())

    def tops(i, j):
        return bound(q.centre[i] @ p.centre[j].T, q.length[i], q.radius[i], q.longest[i], p.length[j], p.radius[j], p.longest[j])

    stack = [(0, 0, float(tops(0, 0)))]
    while stack:
        i, j, top = stack.pop()
        if hopeless(i, top, p.least[j]):
            continue
        if p.fan[j] and (p.radius[j] >= q.radius[i] or not q.fan[i]):
            kids = np.arange(p.kids[j], p.kids[j] + p.fan[j])
            t = tops(i, kids)
            stack += [(i, int(kids[c]), float(t[c])) for c in np.argsort(t)]
        elif q.fan[i]:
            for c in range(q.kids[i], q.kids[i] + q.fan[i]):
                stack.append((c, j, float(tops(c, j))))
        else:
            a, b = slice(q.lo[i], q.hi[i]), slice(p.lo[j], p.hi[j])
            s, ids = products(q.x[a], p.x[b]), p.ids[b]
            wanted = ((s > worst[a, None]) | ((s == worst[a, None]) & (ids <= worst_id[a, None]))) & (q_uid[a, None] != p_uid[None, b])
            rows, cols = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
            if not len(rows):
                continue
            at = rows + q.lo[i]
            s = np.hstack([score[at], np.where(wanted, s, LEAST)[np.ix_(rows, cols)]])
            to = np.hstack([place[at], np.broadcast_to(cols + p.lo[j], (len(rows), len(cols)))])
            by = np.lexsort((np.where(s > LEAST, p.ids[to], LAST), -np.maximum(s, LEAST + 1)), axis=1)[:, :k]
            score[at], place[at] = np.take_along_axis(s, by, 1), np.take_along_axis(to, by, 1)
            kth, kth_id = score[at, -1], p.ids[place[at, -1]]
            better = (kth > LEAST) & ((kth > worst[at]) | ((kth == worst[at]) & (kth_id < worst_id[at])))
            worst[at], worst_id[at] = np.where(better, kth, worst[at]), np.where(better, kth_id, worst_id[at])
    return place, score


def rows_taking_part(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v array<double> (whole numbers) of rows whose vector is not null and holds finite entries only."""
    data = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    data = data.where("x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf'))")
    return data.select("vec_id", F.expr(f"transform(x, c -> {SCALE}D * c)").alias("v"))


def whole(col, dim: int):
    """Rows of an Arrow list column of finite doubles, floored, short ones ended by zeros."""
    offs, vals = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    size = np.diff(offs)
    x = np.zeros((len(size), dim))
    within = np.arange(offs[-1] - offs[0]) - np.repeat(offs[:-1] - offs[0], size)
    x[np.repeat(np.arange(len(size)), size), within] = np.floor(vals[offs[0] : offs[-1]])
    return x


def assigned(data: DataFrame, pivots, dim: int) -> DataFrame:
    """vec_id, node, dist, length, v binary: rows with their nearest pivot."""

    def run(batches):
        import pyarrow as pa

        square = (pivots**2).sum(1)
        for batch in slices(batches, 4096):
            x = whole(batch["v"], dim)
            node = (square - 2 * x @ pivots.T).argmin(1).astype(np.int32)
            dist = np.sqrt(((x - pivots[node]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(node), pa.array(dist), pa.array(np.sqrt((x**2).sum(1))), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["vec_id", "node", "dist", "length", "v"],
            )

    return shipped(data).mapInArrow(run, "vec_id bigint, node int, dist double, length double, v binary")


def met(data: DataFrame, queries: DataFrame, visits: DataFrame, groups: int, k: int) -> DataFrame:
    """uid, query_id, other, vec_id, score: for each query the k best rows of every block that it visits.

    ``visits`` (qn, node, from, to) lists blocks from..to of ``node`` for the queries of node ``qn``; it has NODES^2
    rows at most. A task gets one block and one of ``groups`` shares of the queries.
    """
    spread = queries.withColumn("g", F.expr(f"cast(pmod(xxhash64(uid, 2), {groups}) AS int)"))
    sent = spread.join(F.broadcast(visits), "qn").select("node", F.explode(F.expr("sequence(from, to)")).alias("block"), "g", "uid", "vec_id", "v", "low", "low_id")
    there = visits.select("node", F.explode(F.expr("sequence(from, to)")).alias("block")).distinct()
    held = data.join(F.broadcast(there), ["node", "block"], "left_semi").fillna(LAST, ["vec_id"]).withColumn("g", F.explode(F.expr(f"sequence(0, {groups - 1})"))).select(*[F.col(c).alias(f"{c}_") for c in ("node", "block", "g", "uid", "vec_id", "v")])

    def tree(v, ids):
        x = np.frombuffer(b"".join(v)).reshape(len(v), -1)
        return Cover(x, ids.to_numpy(np.int64))

    def search(key, left, right):
        names = ["uid", "query_id", "other", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})
        q, p = tree(left["v"], left["vec_id"]), tree(right["v_"], right["vec_id_"])
        a, b = left["uid"].to_numpy()[q.order], right["uid_"].to_numpy()[p.order]
        place, score = dual_search(q, a, left["low"].to_numpy(np.int64)[q.order], left["low_id"].to_numpy(np.int64)[q.order], p, b, k)
        i, c = np.nonzero(score > LEAST)
        ids = pd.array(p.ids[place[i, c]], dtype="Int64")
        ids[p.ids[place[i, c]] == LAST] = pd.NA
        return pd.DataFrame({"uid": a[i], "query_id": q.ids[i], "other": b[place[i, c]], "vec_id": ids, "score": score[i, c]})

    return sent.groupBy("node", "block", "g").cogroup(held.groupBy("node_", "block_", "g_")).applyInPandas(search, "uid bigint, query_id bigint, other bigint, vec_id bigint, score bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with rank; Spark cuts to k rows a query before the shuffle."""
    order = W.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: str, k: int = 10, key: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of greatest inner product for every row that meets the
    SQL condition ``queries`` on vec_id, against all rows but itself; ties go to the smaller vec_id.

    Rows whose vector is null or holds null or non-finite entries take no part, neither as queries nor as results.
    Entries are floor(1024 x); a vector shorter than the longest counts as ended by zeros. Rows of one vec_id are rows of their
    own: each is a result for the other, and as queries each gets its rows. Rows without vec_id are results (last
    among ties) but no queries. With fewer than k other rows all are given; no rows or no queries give
    none. Products beyond a long are an OverflowError. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    data = rows_taking_part(vectors, key, vector)
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    n, dim = data.agg(F.count("*"), F.max(F.size("v"))).head()
    if not n:
        return spark.createDataFrame([], schema)
    sample = data.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).select("v").collect()  # SAMPLE rows at most
    x = np.zeros((len(sample), max(dim, 1)))
    for row, r in zip(x, sample, strict=True):
        row[: len(r.v)] = np.floor(r.v)
    picks, _, _ = far_apart(x, min(NODES, -(-n // BLOCK)))
    pivots = x[picks]
    rows = scratch.save(assigned(data, pivots, max(dim, 1)).withColumn("uid", F.monotonically_increasing_id()))
    asked = F.coalesce(F.expr(queries), F.lit(False))

    def summary(df):
        got = df.groupBy("node").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.max("length").alias("far"), F.min(F.coalesce("vec_id", F.lit(LAST))).alias("least")).collect()
        return pd.DataFrame([r.asDict() for r in got], columns=["node", "n", "r", "far", "least"]).set_index("node").sort_index()  # NODES rows at most

    p, q = summary(rows), summary(rows.where(asked))
    if q.empty:
        return spark.createDataFrame([], schema)
    dot = pivots[q.index] @ pivots[p.index].T
    length = np.sqrt((pivots**2).sum(1))
    tops = bound(dot, *(c[:, None] for c in (length[q.index], q["r"].to_numpy(), q["far"].to_numpy())), *(c[None] for c in (length[p.index], p["r"].to_numpy(), p["far"].to_numpy())))
    blocks = -(-p["n"].to_numpy() // BLOCK)
    groups = -(-int(q["n"].sum()) // BATCH)

    def visiting(pairs):
        return spark.createDataFrame([tuple(map(int, t)) for t in pairs], "qn int, node int, from int, to int")

    deal = F.element_at(F.create_map(*[F.lit(int(v)) for t in zip(p.index, blocks, strict=True) for v in t]), F.col("node"))
    held = rows.withColumn("block", F.pmod(F.xxhash64("uid"), deal).cast("int"))
    asking = rows.where(asked).select(F.col("node").alias("qn"), "uid", "vec_id", "v")
    first = {(i, j) for i, name in enumerate(q.index) for j in {*np.argsort(-tops[i])[:2], *np.flatnonzero(p.index == name)}}
    start = visiting([(q.index[i], p.index[j], 0, 0) for i, j in sorted(first)])
    open_ = asking.withColumns({"low": F.lit(LEAST), "low_id": F.lit(LAST)})
    found = scratch.save(best(met(held, open_, start, groups, k), k).drop("rank"))
    kth = found.groupBy("uid").agg(F.count("*").alias("c"), F.max_by(F.struct("score", F.coalesce("vec_id", F.lit(LAST)).alias("id")), F.struct(-F.col("score"), F.coalesce("vec_id", F.lit(LAST)))).alias("m")).where(F.col("c") == k)
    known = scratch.save(asking.join(kth.select("uid", F.col("m.score").alias("low"), F.col("m.id").alias("low_id")), "uid", "left").fillna({"low": LEAST, "low_id": LAST}))
    worst = {r.qn: r.low for r in known.groupBy("qn").agg(F.min("low").alias("low")).collect()}  # NODES rows at most
    rest = []
    for i, name in enumerate(q.index):
        for j in np.flatnonzero(tops[i] >= worst[name]):
            seen = (i, j) in first
            if blocks[j] > seen:
                rest.append((name, p.index[j], int(seen), blocks[j] - 1))
    if rest:
        found = found.unionByName(met(held, known, visiting(rest), groups, k))
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score FROM u a JOIN u b USING (i) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
