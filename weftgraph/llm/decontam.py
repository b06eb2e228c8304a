"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's shingles are its windows of consecutive words. For each window the rarest word, by its
count over all documents, is a token that any text holding the window must hold: the window's
prefix. Documents give a row only where one of those words stands; the row carries the words
around it. Joined on the word (and, where the neighbours exist, on them), it is verified word by
word over the item-sized window around the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm._util import Scratch, ascii_lower

#: Fixed value: everything that parts two words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the benchmark, and prefix rows, up to this number are broadcast; beyond it they are joined by shuffle.
INLINE = 20_000
#: Most bits of the bitmap of prefix words that the scan carries; it only spares rows, the join decides.
BITS = 1 << 22
#: Documents with hits up to this number (some 150 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST = 100_000


def words(text) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """item, n (its words), pos (0-based), word: a row per word of each different item that has words."""
    it = items.select(uid(key, text, "item"), words(F.col(text)).alias("w")).where("size(w) > 0").distinct()
    return it.select("item", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))


def prefixes(each: DataFrame, window: int) -> DataFrame:
    """item, size, word, q, df, il, ir from words with their counts (item, n, pos, word, df): the rarest word of each
    window (ties: the word itself, then the first place), its place, and up to ``window - 1`` words before (nearest
    first) and after it. All are frames of at most ``window`` rows around a word, so long items cost no more
    a word than short ones."""
    at = W.partitionBy("item").orderBy("pos")
    around = window - 1
    seen = each.select(
        "item", "pos", F.least(F.lit(window), "n").alias("size"), "n",
        F.min(F.struct("df", "word", "pos")).over(at.rowsBetween(0, around)).alias("m"),
        F.reverse(F.collect_list("word").over(at.rowsBetween(-around, -1))).alias("il"),
        F.collect_list("word").over(at.rowsBetween(1, around)).alias("ir"),
    )
    rare = seen.where("pos <= n - size AND m.df > 0").select("item", "size", F.col("m.word").alias("word"), F.col("m.pos").alias("pos"), F.col("m.df").alias("df")).distinct()
    return rare.join(seen.select("item", "pos", "il", "ir"), ["item", "pos"]).withColumnRenamed("pos", "q")


def bitmap(prefix: DataFrame) -> tuple[Column, int]:
    """The words' hash slots as one constant array of 64-bit pieces, and the number of bits."""
    n, bits = prefix.count(), 1 << 12
    while bits < BITS and bits < 64 * n:
        bits *= 2
    slot = F.pmod(F.xxhash64("word"), F.lit(bits))
    got = prefix.select(slot.alias("b")).groupBy(F.expr("cast(b div 64 AS int)").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("v")).collect()
    held = dict.fromkeys(range(bits // 64), 0) | {r.k: r.v for r in got}  # at most BITS / 64 rows
    return F.split(F.lit(",".join(str(held[k]) for k in range(bits // 64))), ",").cast("array<bigint>"), bits


def hits(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """Where documents hold windows of items: ``uid`` (key and text hash), item, lo, hi (word
    positions, both inclusive): maximal matched runs around prefix words.

    An item of fewer than ``window`` words, but not none, is one window. Rows repeat where two
    prefix words lie in one run.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    d = docs.select(uid(doc_key, text), words(F.col(text)).alias("w"))
    each = scratch.save(item_words(items, item_key, text))
    # rarity: counts over all documents, of the items' words only
    n_vocab = scratch.save(each.select("word").distinct())
    inline = n_vocab.limit(INLINE + 1).count() <= INLINE
    all_words = d.select(F.explode("w").alias("word"))
    side = F.broadcast(n_vocab) if inline else n_vocab
    counts = all_words.join(side, "word", "left_semi").groupBy("word").count()
    counts = scratch.save(n_vocab.join(counts, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("df")))
    around = window - 1
    rare = scratch.save(prefixes(each.join(F.broadcast(counts) if inline else counts, "word"), window))
    held, bits = bitmap(rare.select("word").distinct())
    ctx = "named_struct('p', i, 'word', w[i], 'l', reverse(slice(w, greatest(i - {0}, 0) + 1, least(i, {0}))), 'r', slice(w, i + 2, {0}))".format(around)
    slot = f"pmod(xxhash64(x), {bits})"
    at = d.withColumn("held", held).select("uid", "w", F.expr(f"filter(transform(w, (x, i) -> IF((shiftright(held[cast({slot} div 64 AS int)], cast({slot} % 64 AS int)) & 1L) = 1L, i, -1)), i -> i >= 0)").alias("s"))
    rows = at.where("size(s) > 0").select("uid", F.expr(f"inline(transform(s, i -> {ctx}))"))
    found = rows.join(F.broadcast(rare) if rare.limit(INLINE + 1).count() <= INLINE else rare, "word")
    same = "coalesce(array_position(zip_with({0}, slice({1}, 1, size({0})), (a, b) -> coalesce(a = b, false)), false) - 1, -1)"
    run = "IF({0} < 0, least(size({1}), size({2})), {0})"
    found = found.withColumns({"l_": F.expr(same.format("l", "il")), "r_": F.expr(same.format("r", "ir"))})
    found = found.withColumns({"nl": F.expr(run.format("l_", "l", "il")), "nr": F.expr(run.format("r_", "r", "ir"))})
    return found.where("nl + nr + 1 >= size").select("uid", "item", (F.col("p") - F.col("nl")).cast("bigint").alias("lo"), (F.col("p") + F.col("nr")).cast("bigint").alias("hi"))


def uid(key: str, text: str, name: str = "uid") -> Column:
    """Rows of one key may differ; equal rows may repeat. Both get what is theirs."""
    return F.struct(F.col(key).alias("k"), F.xxhash64(F.lit(1), F.col(text)).alias("h")).alias(name)


def contamination(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have no words and
    are clean; repeated rows are judged each; clashing column names are replaced; an empty
    benchmark leaves all clean.
    """
    scratch = Scratch(docs.sparkSession)
    out = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*out)
    found = hits(docs, items, doc_key, item_key, text, window, scratch).distinct()
    union = """aggregate(array_sort(collect_set(struct(lo, hi))), named_struct('n', 0L, 'end', -1L),
        (a, s) -> named_struct('n', a.n + greatest(s.hi - greatest(s.lo, a.end + 1) + 1, 0L), 'end', greatest(a.end, s.hi)), a -> a.n)"""
    per = found.groupBy("uid").agg(F.expr(union).alias("n_hit"), F.expr("array_sort(collect_set(cast(item.k AS string)))").alias("items"))
    per = per.select("uid", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    per = scratch.save(per).withColumnRenamed("uid", "__uid")
    if per.limit(BROADCAST + 1).count() <= BROADCAST:
        per = F.broadcast(per)
    d = docs.withColumns({"__uid": uid(doc_key, text), "n_words": F.size(words(F.col(text))).cast("bigint")})
    res = d.join(per, "__uid", "left").drop("__uid")
    res = res.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256))})
    return res.withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda p: array_to_string(w[p:p + least(13, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k),
h AS (SELECT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, coalesce(it.sha, sha256('')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def flags(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("text")
