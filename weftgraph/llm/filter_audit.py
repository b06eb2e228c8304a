"""How five quality filters interact: every order of them, from one histogram of failure masks.

Which filter removes a document depends on the order only through the set of filters that the document
fails. So one scan gives each document a five-bit mask, a grouping by text tells which copies are later
ones, and documents are counted in at most 32 cells per part. All 120 orders are read off those cells; the
documents are not looked at again.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filter letters; the k-th has bit k of the mask.
LETTERS = "ABCDE"
#: What parts two words, and the symbols of filter D.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "[#$%&*|]"


def own_failures(words: Column, text: Column) -> Column:
    """Bits of the filters that a text decides alone: A few words, B repeated words, C capitals, D symbols."""
    failed = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("bigint") > 5 * F.length(text).cast("bigint"),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def failure_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask (bits 0 to 4: filters A to E failed), n: rows of ``docs`` with one doc_id, part and mask.

    Null texts are empty, null parts the empty string. E fails where a smaller doc_id has the same text. A row
    without doc_id has no smaller one and is none, so it never fails E. The least doc_id of every text comes from
    a grouping by the text itself; rows find theirs by (doc_id, two hashes of the text), which can only err
    where one doc_id stands for two texts that agree in 128 bits.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    key = [F.xxhash64(F.lit(k), "text").alias(f"h{k}") for k in (1, 2)]
    first = rows.where("doc_id IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", *key, F.lit(True).alias("first"))
    masks = rows.withColumn("words", F.array_remove(F.split("text", SPACE), "")).select("doc_id", "part", *key, own_failures(F.col("words"), F.col("text")).alias("mask"))
    late = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    found = masks.join(first, ["doc_id", "h1", "h2"], "left").select("doc_id", "part", (F.col("mask") + late).alias("mask"))
    return found.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, and those that ``labels`` (doc_id, quality, toxic) marks 1."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("bigint")).alias("g"), F.max((F.col("toxic") == 1).cast("bigint")).alias("t"))
    rows = masks.join(marks, "doc_id", "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0)) * F.col("n"))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("g").alias("good"), count("t").alias("toxic"))


def all_orders(found: DataFrame) -> DataFrame:
    """The rows of :func:`audit` from cells: a part's cells, 32 at most, become one array, which every order folds."""
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    at = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = sum((F.when(F.expr(f"substring(filter_order, step, 1) = '{c}'"), 1 << k).otherwise(0) for k, c in enumerate(LETTERS)), F.lit(0))
    before = sum((F.when(F.expr(f"instr(filter_order, '{c}') < step"), 1 << k).otherwise(0) for k, c in enumerate(LETTERS)), F.lit(0))
    at = at.select("*", bit.alias("bit"), before.alias("before"))
    total = lambda of, where: F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (a, c) -> a + {of})")
    here = "(c.mask & bit) > 0 AND (c.mask & before) = 0"
    return at.select(
        "part", "filter_order", "step",
        total("c.n", "(c.mask & (before | bit)) = 0").alias("kept"),
        total("c.n", here).alias("removed"),
        total("c.n", "(c.mask & bit) > 0 AND (c.mask & before) > 0").alias("redundant"),
        total("c.n", "c.mask = bit").alias("unique_fails"),
        total("c.good", here).alias("good_lost"),
        total("c.toxic", here).alias("toxic_lost"),
        # of k failed filters each comes first in a k-th of the 120 orders
        total("c.n * (120 div bit_count(c.mask))", "(c.mask & bit) > 0").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row, zeros included, per value of ``part``, order of the filters and step. Null texts are empty texts
    (they fail A, and E behind another empty one); null parts count under the empty string; long texts are
    judged whole; rows that repeat count each, and under one doc_id none of them is later than the other;
    rows without doc_id have no label and never fail E. Where ``labels`` has several rows of one doc_id, 1 wins.
    No documents give no rows. Other columns are not read.
    """
    return all_orders(cells(failure_masks(docs, part), labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 1 ELSE 0 END AS b, CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 1 ELSE 0 END AS c,
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e FROM d),
f AS (SELECT b.*, coalesce(l.quality, 0) AS good, coalesce(l.toxic, 0) AS bad FROM b LEFT JOIN labels l USING (doc_id)),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum((good = 1)::INT) AS good, sum((bad = 1)::INT) AS bad FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, n, good, bad, list_filter(string_split(filter_order, ''), lambda y: CASE y WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END = 1) AS failed FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
s AS (SELECT part, filter_order, step, f, sum(CASE WHEN len(failed) = 0 OR instr(filter_order, failed[1]) > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed[1] = f THEN n ELSE 0 END) AS removed, sum(CASE WHEN list_contains(failed, f) AND failed[1] <> f THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failed = [f] THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failed[1] = f THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed[1] = f THEN bad ELSE 0 END) AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM s
"""
