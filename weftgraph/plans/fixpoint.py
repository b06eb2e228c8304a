"""Loops over DataFrames: each round is checkpointed to the shared folder, so lineage stays short
and a lost executor costs at most a round."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of more rows on the left side of ``meet`` gets its partner by broadcast.
HOT = 500_000


def folder(spark: SparkSession) -> str:
    """The checkpoint folder: what spark.checkpoint.dir names; a temporary one only if it is unset and the master is local."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "weftgraph-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def spot(spark: SparkSession) -> str:
    """A new folder there that goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


#: A plan whose size is estimated at more bits than this is written as a table: no real table is that large.
UNREAL = 70


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in that folder; it keeps the partitioning, so the next join may need no shuffle.

    It keeps the size estimate too, and a join multiplies those of its sides: where a loop joins a table
    with itself the number of digits doubles each round, until planning alone takes minutes. Beyond UNREAL
    the rows go to a Parquet table there instead, whose size is known again.
    """
    folder(df.sparkSession)
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= UNREAL or not _fit_for_parquet(df):
        return df.checkpoint()
    return written(df)


def _fit_for_parquet(df: DataFrame) -> bool:
    return not any("void" in f.dataType.simpleString() for f in df.schema)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in that folder: what loops read again and again and only some columns of, such as arcs.
    Checkpoints hold whole serialised rows, which take several times as long to read."""
    if not _fit_for_parquet(df):
        return checkpoint(df)
    path = spot(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of two or three numbers up to which a loop's state is broadcast to its arcs (some 50 MB); beyond it they meet by shuffle.
STATE = 1_000_000
#: Rows up to which a set of ids alone is broadcast (some 300 MB in an executor, a third of that sent).
IDS = 6_000_000


def handy(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if its counted ``rows`` are few."""
    return F.broadcast(df) if rows <= STATE else df


#: A table is broadcast to one of this many times its rows or more; others are met by shuffle, which costs no more and passes no driver.
WORTH = 8


def pays(rows: int, other: DataFrame, most: int | None = None) -> bool:
    """Whether ``rows`` rows, at most ``most`` (STATE), should be broadcast to ``other``."""
    return rows <= (STATE if most is None else most) and rows * WORTH <= other.count()


def lent(df: DataFrame, rows: int, other: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` of ``rows`` rows, marked for its join with ``other``: broadcast if that pays, hashed after a shuffle elsewhere."""
    return F.broadcast(df) if pays(rows, other, most) else df.hint("shuffle_hash")


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], changed: Callable[[DataFrame, DataFrame], bool], limit: int | None = None) -> tuple[DataFrame, int, bool]:
    """Apply ``step`` until ``changed(old, new)`` is false or ``limit`` rounds are done: state, rounds, settled."""
    state, n = checkpoint(state), 0
    while limit is None or n < limit:
        new = checkpoint(step(state, n))
        n += 1
        if not changed(state, new):
            return new, n, True
        state = new
    return state, n, False


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """The keys of more than HOT rows of ``left`` (so at most rows / HOT of them), counted before the shuffle."""
    return checkpoint(left.groupBy(key).count().where(F.col("count") > HOT).select(key))


def meet(left: DataFrame, right: DataFrame, key: str, many: DataFrame | None = None) -> DataFrame:
    """``left.join(right, key)`` for a ``right`` of one row per key. Rows of hot keys (``many``, counted here if
    not given) stay where they are and meet broadcast partners, so that no task gets all rows of such a key."""
    many = hot_keys(left, key) if many is None else many
    if many.isEmpty():
        return left.join(right, key)
    few, many = F.broadcast(right.join(F.broadcast(many), key, "left_semi")), F.broadcast(many)
    return left.join(few, key).unionByName(left.join(many, key, "left_anti").join(right, key))
