"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftgraph.session import ship


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; every operator takes a path, this is only the default."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (so any store that Spark reads will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a worker holds as Python objects at a time.
ROWS = 512


def slices(batches, rows: int = ROWS):
    """Arrow batches of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """Run ``make() -> fn(dict of column lists) -> dict of column lists`` over Arrow batches.

    ``make`` is called once per partition, so models are built there and not per row. Only ROWS
    rows at a time become Python objects.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        fn = make()
        for batch in slices(batches):
            out = fn(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where none is set and the master is local (tests)."""
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "weftgraph-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Parquet tables in the shared checkpoint folder: they cut lineage and outlive executors.

    Results are lazy and may read them at any later time, so they go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-case A-Z only; ``lower`` does just that where every character is one byte."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(_translated(col))


def _translated(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shipped(df: DataFrame) -> DataFrame:
    """The same frame, after making sure that workers can import this package."""
    ship(df.sparkSession)
    return df
