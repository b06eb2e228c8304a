"""Exact document fingerprints of canonical texts, with DataFrame functions only.

A text is brought to Unicode normal form KC with full case folding, its white space is folded,
and the result is hashed twice by seeded xxhash64 to 128 bits. Buckets of equal hashes are
compared byte by byte; should two texts ever collide, their fingerprints get a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.llm._util import Scratch

#: Fingerprints that occur more than once, up to this number (16 bytes each), are broadcast; else joined by shuffle.
BROADCAST = 500_000


def canonical(text: Column) -> Column:
    """NFKC and full case folding by the ICU library that Spark ships; white space runs become one space."""
    icu = "com.ibm.icu.text.Normalizer"
    kc = F.reflect(F.lit(icu), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), kc, F.lit(True))
    wide = F.reflect(F.lit(icu), F.lit("compose"), folded, F.lit(True))
    one = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(wide)
    # only what is not already a single blank is rewritten
    return F.trim(F.regexp_replace(one, r"(?: [\s\x85   ]+|[\t-\r\x85   ][\s\x85   ]*)", " "))


def digest(canon: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in (0x5EED1, 0x5EED2))))


def collisions(keys: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """From keys (uid, fingerprint) and texts (uid, text): uid, n (from 1) of texts in buckets whose canonical bytes differ; normally empty.

    Only texts whose fingerprint occurs more than once are brought to canonical form again.
    """
    dup = scratch.save(keys.groupBy("fingerprint").count().where("count > 1").select("fingerprint"))
    few = dup.limit(BROADCAST + 1).count() <= BROADCAST
    held = scratch.save(keys.join(F.broadcast(dup) if few else dup, "fingerprint").select("uid", "fingerprint").distinct())
    few = held.limit(BROADCAST + 1).count() <= BROADCAST
    members = texts.join(F.broadcast(held) if few else held, "uid").withColumn("canon", canonical(F.col("text")))
    bad = scratch.save(members.groupBy("fingerprint").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo != hi").select("fingerprint"))
    each = members.join(bad, "fingerprint").select("uid", F.dense_rank().over(W.partitionBy("fingerprint").orderBy("canon")).alias("n"))
    return scratch.save(each.distinct())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns plus ``out``. Equal canonical texts, and only those, have equal fingerprints.

    A null text is empty; a column of the output's name is replaced; names that start with ``_f_``
    are internal.
    """
    scratch, one = Scratch(docs.sparkSession), F.coalesce(text, F.lit(""))
    uid = F.struct(F.xxhash64(F.lit(1), one), F.xxhash64(F.lit(2), one), F.length(one))
    df = docs.drop(out)
    each = collisions(scratch.save(df.select(uid.alias("uid"), digest(canonical(one)).alias("fingerprint"))), df.select(uid.alias("uid"), one.alias("text")), scratch)
    df = df.withColumn(out, digest(canonical(one)))
    if each.isEmpty():
        return df
    each = each.select(F.col("uid").alias("_f_u"), F.col("n").alias("_f_n"))
    return df.withColumn("_f_u", uid).join(each, "_f_u", "left").withColumn(out, F.concat_ws("-", out, "_f_n")).drop("_f_u", "_f_n")


def next_of(keys: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """Each row with the ``carry`` columns of the next row in the order as ``next_*`` (after the last: the first).

    ``keys`` holds ids and numbers only. Rows are dealt by range, neighbours found inside each
    range; between ranges the first row of the next one is used, a table with one row per range.
    """
    spark = keys.sparkSession
    scratch = Scratch(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    first = dealt.groupBy("part").agg(F.min(F.struct(*dict.fromkeys([*order, *carry]))).alias("f"))
    one = W.orderBy("part")  # one row per range
    first = first.select("part", F.lead("f").over(one).alias("after"), F.first("f").over(one).alias("start")).select("part", F.coalesce("after", "start").alias("after"))
    w = W.partitionBy("part").orderBy(*dict.fromkeys([*order, *carry]))
    own = dealt.select("*", F.lead(F.struct(*carry)).over(w).alias("own"))
    own = own.join(F.broadcast(first), "part")
    return own.select(*keys.columns, *(F.when(F.col("own").isNull(), F.col(f"after.{c}")).otherwise(F.col(f"own.{c}")).alias(f"next_{c}") for c in carry))


def edited_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow each other by doc_id (null first), then by a hash of the text; rows equal in
    doc_id and text count as one in that order and each get its result. A null text is empty. A
    lone document is its own next. The texts are dealt once, by row key, and read twice.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64(F.lit(7), "text").alias("h"), "text")
    uid = F.struct("doc_id", "h").alias("uid")
    keys = scratch.save(d.select("doc_id", "h", F.length("text").cast("bigint").alias("n_chars"), digest(canonical(F.col("text"))).alias("fingerprint")))
    each = collisions(keys.select(uid, "fingerprint"), d.select(uid, "text"), scratch)
    if not each.isEmpty():
        keys = scratch.save(keys.withColumn("uid", uid).join(each, "uid", "left").select("doc_id", "h", "n_chars", F.concat_ws("-", "fingerprint", "n").alias("fingerprint")))
    distinct = keys.distinct()
    keyed = next_of(distinct.select("doc_id", "h", "n_chars", "fingerprint"), ["doc_id", "h"], ["doc_id", "h", "fingerprint"])
    keyed = scratch.save(keyed)
    texts = d.select(uid, "text")
    want = keyed.select(F.struct(F.col("next_doc_id").alias("doc_id"), F.col("next_h").alias("h")).alias("uid"), F.struct("doc_id", "h").alias("before"), F.floor(F.col("n_chars") / 4).cast("int").alias("k"))
    heads = texts.join(want, "uid").select(F.col("before").alias("uid"), F.expr("substring(text, 1, k)").alias("head"))
    if keys.count() > keyed.count():
        heads = heads.groupBy("uid").agg(F.first("head").alias("head"))
    info = keyed.select(F.struct("doc_id", "h").alias("uid"), "n_chars", "fingerprint", "next_fingerprint")
    df = texts.join(heads, "uid").join(info, "uid")
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) AS int)), head)"))
    df = df.withColumn("edited_canon", canonical(F.col("edited")))
    df = df.withColumn("edited_digest", digest(F.col("edited_canon")))
    # equal digests are believed only after the canonical bytes were compared
    same = F.when(F.col("edited_digest") == F.substring_index("fingerprint", "-", 1), canonical(F.col("text")) == F.col("edited_canon")).otherwise(False)
    df = df.withColumn("same", same)
    other = F.when(F.col("edited_digest") == F.col("fingerprint"), F.concat("edited_digest", F.lit("-e"))).otherwise(F.col("edited_digest"))
    df = df.withColumn("edited_fingerprint", F.when(F.col("same"), F.col("fingerprint")).otherwise(other))
    return df.select(
        F.col("uid.doc_id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        F.col("same").cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
