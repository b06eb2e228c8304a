"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact sets.

Registers are truncated, exponentially spaced minima (SetSketch): of two sketches the element-wise
maximum is the sketch of the union, and registers agree about as often as the sets' Jaccard
similarity says. The pipeline:

1.  One scan gives each document's number of shingles, a 128-bit digest of its shingle set, and
    the keys of its register bands. Documents of one digest are one node.
2.  Buckets (band keys held by several nodes) are joined as stars: every node of a bucket is
    compared with the bucket's hub. Pairs are first judged by the likelihood of the registers,
    given both set sizes, then verified on the full sets.
3.  Verified links give components. In buckets whose nodes still lie in several components the
    nodes outside the hub's component are compared with all others, in blocks that give back
    links only; so no pair that shares a bucket stays untested unless it is connected already.
4.  Final components; every document gets the smallest doc_id that it can reach.

Pairs are lost in two ways only: if they share no band (with 36 bands of 6 registers, 2e-5 at
similarity 0.8 and less above), and if their registers speak so strongly against the similarity that
the likelihood test gives them up (GIVE_UP; 2e-8 at similarity 0.8).

Keys that many rows share (a text with many copies, a band that a large group of near copies has in
common, the label of a giant component) do not meet in one task: see :func:`deal`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from weftgraph.llm._util import Scratch, map_batches, shipped, slices

BANDS, ROWS = 36, 6
#: SetSketch parameters: base, rate of the exponential variables, largest register.
BASE, RATE, LAST = 1.001, 20.0, 65_534
#: Pairs are given up before the exact check if the threshold's log-likelihood is this much below the best: twice
#: that exceeds 32, which chi-square of one degree does with a chance of 2e-8.
GIVE_UP = 16.0
#: Members compared with one copy of a hub, and nodes of a block.
SALT, BLOCK = 512, 192
#: Keys up to this number (8 to 16 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST = 1_000_000
#: A key is hot if it has more rows than a share of 1 / HOT of all, and than WARM. There are HOT such keys at most.
HOT, WARM = 50_000, 128
#: Words whose hashes a worker keeps.
CACHE = 200_000


class _Words(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > CACHE:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_words = _Words()


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, none none."""
    import numpy as np

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    got = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        got = _mix(got * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(got)


def sketches(sets, registers: int = BANDS * ROWS):
    """Registers (uint16, a row per set) of non-empty sets."""
    import numpy as np

    odd = np.random.default_rng(20_250_101).integers(0, 2**63, registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), registers), np.uint16)
    start = 0
    while start < len(sets):  # pieces that stay in the cache
        stop, n = start, 0
        while stop < len(sets) and (stop == start or n + len(sets[stop]) <= 16_384):
            n += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[start:stop])
        offs = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        low = np.empty((registers, stop - start), np.uint64)
        y = np.empty_like(x)
        for j in range(registers):
            np.multiply(x, odd[j], out=y)
            np.minimum.reduceat(y, offs, out=low[j])
        u = (low.T.astype(np.float64) + 1.0) / 2.0**64
        at = np.floor(1.0 - np.log(-np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE) / np.log(BASE))
        out[start:stop] = np.clip(at, 0, LAST).astype(np.uint16)
        start = stop
    return out


def merge(a, b):
    """The sketch of the union of two sets."""
    import numpy as np

    return np.maximum(a, b)


def log_likelihood(more, less, same, na, nb, j):
    """Of similarity ``j``, given in how many registers a's is greater, smaller and equal, and the set sizes."""
    import numpy as np

    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    e = 1e-12
    return more * np.log(a + e) + less * np.log(b + e) + same * np.log(np.maximum(1 - a - b, 0) + e)


def plausible(sk, n, sks, ns, share: float):
    """Which of ``sks`` (sizes ``ns``) may reach the similarity ``share`` with ``sk`` (size ``n``)."""
    import numpy as np

    size_ok = np.minimum(n, ns) >= share * np.maximum(n, ns) - 1e-9
    more, less = (sk > sks).sum(1), (sk < sks).sum(1)
    same = sks.shape[1] - more - less
    grid = np.linspace(0, 1, 41)[None, :] * np.minimum(n / ns, ns / n)[:, None]
    best = log_likelihood(more[:, None], less[:, None], same[:, None], n, ns[:, None], grid).max(1)
    at = log_likelihood(more, less, same, n, ns, np.minimum(share, np.minimum(n / ns, ns / n)))
    enough = same >= share * sks.shape[1]
    return size_ok & (enough | (best - at <= GIVE_UP))


def _linked(a, b, percent: int) -> bool:
    import numpy as np

    both = int(np.isin(a, b, assume_unique=True).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, h, n_shingles, node (binary, null without words), keys array<bigint> (one per band) from doc_id, h, text."""

    def make():
        import numpy as np
        import xxhash

        def fn(cols):
            n, nodes, keys = [], [], []
            texts = cols["text"]
            for at in range(0, len(texts), 256):
                sets = [shingle_set(t, k) for t in texts[at : at + 256]]
                sk = iter(sketches([s for s in sets if len(s)]))
                for s in sets:
                    n.append(len(s))
                    if len(s):
                        nodes.append(xxhash.xxh3_128_digest(s.tobytes()))
                        regs = next(sk).reshape(BANDS, ROWS)
                        keys.append([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) - 2**63 for i, r in enumerate(regs)])
                    else:
                        nodes.append(None)
                        keys.append([])
            return {"doc_id": cols["doc_id"], "h": cols["h"], "n_shingles": np.array(n, np.int64), "node": nodes, "keys": keys}

        return fn

    return map_batches(docs.select("doc_id", "h", "text"), make, "doc_id bigint, h bigint, n_shingles bigint, node binary, keys array<bigint>")


def node_sets(docs: DataFrame, k: int) -> DataFrame:
    """node, sk binary, st binary of documents that have words."""

    def make():
        import xxhash

        def fn(cols):
            out = {"node": [], "sk": [], "st": []}
            for at in range(0, len(cols["text"]), 256):
                sets = [s for s in (shingle_set(t, k) for t in cols["text"][at : at + 256]) if len(s)]
                for s, r in zip(sets, sketches(sets), strict=True):
                    out["node"].append(xxhash.xxh3_128_digest(s.tobytes()))
                    out["sk"].append(r.tobytes())
                    out["st"].append(s.tobytes())
            return out

        return fn

    return map_batches(docs.select("text"), make, "node binary, sk binary, st binary")


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows (ids only)."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def hot_keys(sizes: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The keys of ``sizes`` (key, count) that have many rows; HOT at most, so they may be broadcast at any size."""
    total = sizes.agg(F.sum("count")).head()[0] or 0
    return scratch.save(sizes.where(F.col("count") > max(WARM, total // HOT)).select(key))


def deal(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a row per key at most (inner, left or left_semi).

    Rows of hot keys stay where they are and meet a broadcast copy of their few partners; only the
    others are dealt by the key, so no task gets more of one key than the bound of a cold one.
    """
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    warm = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return left.join(hot, key, "left_anti").join(right, key, how).unionByName(warm)


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, c: the least label ``m`` that a node of ``nodes`` (node, m) reaches over ``links`` (a, b); no label is null.

    Each round passes labels along the links and then follows the labels themselves, so long
    chains shorten quickly; tables are written each round, which cuts the lineage.
    """
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct())
    touched = both.select(F.col("a").alias("node")).distinct()
    state = scratch.save(nodes.join(touched, "node", "left_semi").select("node", "m", F.col("m").alias("c")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("o"))
        new = state.join(near, "node", "left").select("node", "m", "c", F.least("c", "o").alias("n"))
        # the label is another node's id: take what that node has now
        new = scratch.save(new)
        jump = scratch.save(new.groupBy(F.col("m").alias("n")).agg(F.min("n").alias("j")))
        hot = hot_keys(new.groupBy("n").count(), "n", scratch)
        new = scratch.save(deal(new, jump, "n", hot, "left").select("node", "m", F.col("c").alias("old"), F.least("n", "j").alias("c")))
        state = new.select("node", "m", "c")
        if new.where("c < old").isEmpty():
            return state.select("node", "c")


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Verified links (a = hub, b) among ``pairs`` (hub, node): members stream past their hub's set."""
    pairs = scratch.save(pairs.select("hub", "node").distinct())
    sizes = scratch.save(pairs.groupBy("hub").count())
    copies = sizes.select("hub", F.ceil(F.col("count") / SALT).cast("int").alias("s"))
    members = deal(pairs, copies, "hub", hot_keys(sizes, "hub", scratch)).withColumn("salt", F.expr("cast(pmod(xxhash64(node), s) AS int)"))
    members = members.join(sets, "node").select("hub", "salt", F.lit(1).alias("kind"), "node", "sk", "st")
    hubs = copies.select(F.col("hub").alias("node"), "s").join(sets, "node").select(F.col("node").alias("hub"), F.explode(F.expr("sequence(0, s - 1)")).alias("salt"), F.lit(0).alias("kind"), "node", "sk", "st")
    rows = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    share = percent / 100

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hub, now = None, None
        for batch in slices(batches):
            a, b = [], []
            h, salt, kind, node, sk, st = (batch[c].to_pylist() for c in ("hub", "salt", "kind", "node", "sk", "st"))
            at = 0
            while at < len(h):
                if kind[at] == 0:
                    hub, now = (node[at], np.frombuffer(sk[at], np.uint16), np.frombuffer(st[at], np.uint64)), (h[at], salt[at])
                    at += 1
                    continue
                if now != (h[at], salt[at]):
                    raise RuntimeError("members of a bucket came without its hub")
                to = at
                while to < len(h) and kind[to] == 1 and (h[to], salt[to]) == now:
                    to += 1
                sks = np.frombuffer(b"".join(sk[at:to]), np.uint16).reshape(to - at, -1)
                ns = np.array([len(x) // 8 for x in st[at:to]])
                for i in np.flatnonzero(plausible(hub[1], len(hub[2]), sks, ns, share)):
                    if _linked(hub[2], np.frombuffer(st[at + i], np.uint64), percent):
                        a.append(hub[0])
                        b.append(node[at + i])
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return scratch.save(shipped(rows).mapInArrow(run, "a binary, b binary"))


def _block_links(members: DataFrame, sets: DataFrame, percent: int, hot: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components within buckets: ``members`` (key, node, c, odd) lists the nodes of open
    buckets; each odd one is compared with every node of another component, block by block."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"), F.ceil(F.sum(F.col("odd").cast("int")) / BLOCK).cast("int").alias("no"))
    m = deal(members, scratch.save(sizes), "key", hot).withColumns({"h": F.xxhash64("node"), "c": F.col("c").cast("string")})
    left = m.where("odd").select("key", F.expr("cast(pmod(h, no) AS int)").alias("ob"), F.explode(F.expr("sequence(0, nb - 1)")).alias("mb"), F.lit(0).alias("kind"), "node", "c")
    right = m.select("key", F.explode(F.expr("sequence(0, no - 1)")).alias("ob"), F.expr("cast(pmod(h, nb) AS int)").alias("mb"), F.lit(1).alias("kind"), "node", "c")
    rows = left.unionByName(right).join(sets, "node").repartition("key", "ob", "mb").sortWithinPartitions("key", "ob", "mb", "kind")
    share = percent / 100

    def block(odd, other):
        import numpy as np

        root = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        sks = np.frombuffer(b"".join(r[2] for r in other), np.uint16).reshape(len(other), -1)
        ns = np.array([len(r[3]) // 8 for r in other])
        for node, c, sk, st in odd:
            a = np.frombuffer(st, np.uint64)
            for i in np.flatnonzero(plausible(np.frombuffer(sk, np.uint16), len(a), sks, ns, share)):
                if find(c) != find(other[i][1]) and _linked(a, np.frombuffer(other[i][3], np.uint64), percent):
                    root[find(c)] = find(other[i][1])
                    yield node, other[i][0]

    def run(batches):
        import pyarrow as pa

        now, odd, other = None, [], []
        for batch in slices(batches):
            links = []
            for key, ob, mb, kind, node, c, sk, st in zip(*(batch[x].to_pylist() for x in ("key", "ob", "mb", "kind", "node", "c", "sk", "st")), strict=True):
                if (key, ob, mb) != now:
                    if odd and other:
                        links += block(odd, other)
                    now, odd, other = (key, ob, mb), [], []
                (other if kind else odd).append((node, c, sk, st))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], names=["a", "b"])
        links = list(block(odd, other)) if odd and other else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], names=["a", "b"])

    return scratch.save(shipped(rows).mapInArrow(run, "a binary, b binary"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are parted by ASCII white space and lower-cased A-Z; a document's set holds its distinct
    k-word shingles (with fewer words the whole as one). Documents are linked if
    100 * intersection >= percent * union. Null and empty texts have no set and link with nothing.
    Repeated rows fall in one component. Rows without doc_id take part like others: they get the least doc_id that
    they reach, or null where none of their component has one, and are not kept if it has. Of a component without
    any doc_id the rows of one text are kept. Long texts count whole; no rows give none; other columns are not read.
    """
    found = linked_rows(docs, k, percent)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def row_hash(text):
    """What tells the rows of one doc_id apart; a null text has its own."""
    return F.xxhash64(F.lit(2), text)


def linked_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The same, and h, the hash of the row's text, so that rows of one doc_id can be told apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", row_hash("text").alias("h"), "text")
    sig = scratch.save(signatures(docs, k))
    # a node's label: its least doc_id, or behind all of those a hash of itself; its text: that of the row with the least id
    nodes = sig.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("of"), F.first("keys").alias("keys"), F.count("*").alias("count"))
    label = F.struct(F.col("of.none").alias("none"), F.coalesce("of.doc_id", F.xxhash64("node")).alias("id"))
    nodes = scratch.save(nodes.select("node", label.alias("m"), F.struct("of.doc_id", "of.h").alias("of"), "keys", "count"))
    copied = hot_keys(nodes, "node", scratch)
    keyed = nodes.select("node", "m", F.posexplode("keys").alias("band", "key"))
    many = scratch.save(keyed.groupBy("key").count().where("count > 1"))
    hot = hot_keys(many, "key", scratch)
    few = many.limit(BROADCAST + 1).count() <= BROADCAST
    rows = scratch.save(keyed.join(F.broadcast(many.select("key")), "key") if few else deal(keyed, many.select("key"), "key", hot))
    # the hub: one node per bucket, by an order that differs between groups of bands
    hubs = rows.groupBy("key").agg(F.min_by("node", F.xxhash64("m", F.col("band") % 6)).alias("hub"))
    hubs = scratch.save(hubs)
    wanted = scratch.save((nodes.join(_small(rows.select("node").distinct()), "node", "left_semi")).select(F.col("of.doc_id").alias("id_"), F.col("of.h").alias("h_")).distinct())
    texts = docs.join(_small(wanted), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left_semi")
    sets = node_sets(texts, k).join(_small(rows.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"])
    sets = scratch.save(sets)
    pairs = deal(rows, hubs, "key", hot).where("node != hub")
    links = _star_links(pairs, sets, percent, scratch)
    state = components(nodes, links, scratch)
    # open buckets: nodes outside the component of the hub
    labelled = rows.select("key", "node", "m").join(state, "node", "left").select("key", "node", F.coalesce("c", "m").alias("c"))
    heads = hubs.join(state.withColumnRenamed("node", "hub"), "hub", "left").join(nodes.select(F.col("node").alias("hub"), "m"), "hub").select("key", "hub", F.coalesce("c", "m").alias("hc"))
    marked = scratch.save(deal(scratch.save(labelled), scratch.save(heads), "key", hot).where("node != hub").select("key", "node", "c", (F.col("c") != F.col("hc")).alias("odd")))
    open_ = marked.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("odd").cast("int")).alias("o"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("o > 0 AND n > 1 AND lo != hi")
    members = scratch.save(deal(marked, scratch.save(open_.select("key")), "key", hot, "left_semi"))
    if not members.isEmpty():
        more = _block_links(members, sets, percent, hot, scratch)
        if not more.isEmpty():
            state = components(nodes, links.union(more), scratch)
    final = nodes.select("node", "m").join(state, "node", "left").withColumn("c", F.coalesce("c", "m"))
    final = scratch.save(final.select("node", F.when(~F.col("c.none"), F.col("c.id")).alias("component_id"), (F.col("c") == F.col("m")).alias("own")))
    out = sig.select("doc_id", "h", "n_shingles", "node")
    out = deal(out.where("node IS NOT NULL"), final, "node", copied).unionByName(out.where("node IS NULL").withColumns({"component_id": F.col("doc_id"), "own": F.lit(True)}))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | F.col("own"))
    return out.select("doc_id", "n_shingles", "component_id", "h", kept.alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT sym.b, r.c FROM r JOIN sym ON sym.a = r.a),
c AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.a = doc_id
"""
