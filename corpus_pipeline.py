"""A corpus pipeline: each stage calls one training-data operator and acts on what it finds.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.

In every stage a null text counts as empty and stays (it is neither toxic nor a copy, holds no
benchmark passage, no secret and no token); an empty table gives an empty table; texts of any length
are taken whole; rows are judged each by itself, so rows that repeat and ids that tie get what their
text deserves, but of one text repeated under one id ``near_dedup`` keeps one row; further columns are
carried along under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, minhash_dedup, secrets, toxicity
from weftgraph.llm._util import Scratch, table

#: Removed ids up to this number (8 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST = 1_000_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of the documents at hand."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, _row (all columns), so that no column of the documents meets one of an operator's names."""
    return docs.select("doc_id", "text", F.struct("*").alias("_row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: that of the least id."""
    found = Scratch(spark).save(minhash_dedup.linked_rows(docs, k=5, percent=80).select("doc_id", "h", "n_shingles", "kept"))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    if gone.limit(BROADCAST + 1).count() <= BROADCAST:
        gone = F.broadcast(gone)
    out = whole_rows(docs).withColumn("_hash", minhash_dedup.row_hash("text"))
    out = out.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_anti")
    twice = found.where("kept AND (doc_id IS NOT NULL OR n_shingles > 0)").groupBy("doc_id", "h").count().where("count > 1")
    if not twice.isEmpty():  # one text repeated under one id, or without id; rows that have neither id nor words all stay
        bare = F.col("doc_id").isNull() & F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == "", F.lit(True))
        out = out.where(bare).unionByName(out.where(~bare).dropDuplicates(["doc_id", "_hash"]))
    return out.select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stand in benchmark passages go."""
    found = decontam.contamination(whole_rows(docs), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where("NOT contaminated").select("_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; the documents stay."""
    found = secrets.redact(secrets.find_secrets(whole_rows(docs)))
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")))
    return found.select(row.alias("_row")).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left."""
    out = bpe.encode_texts(docs)
    return out.drop("text").withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

#: SQL cannot express the learned and tokenizing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
