"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these characters only (ASCII white space).
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or one in the warehouse where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


class Durable:
    """A DataFrame written once to the shared folder and read back, so that no later action recomputes it.

    Unlike DataFrame.checkpoint() the plan runs once, and the copy is columnar. `drop()` removes the files
    when nothing that is still to run reads them. `rows` (of those where `counted` holds) is counted by the write.
    """

    def __init__(self, df: DataFrame, name: str = "t", counted: Column | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1) if counted is None else F.when(counted, 1)).alias("n")).write.parquet(self.path)
        self.rows = seen.get.get("n", 0)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    return Durable(df, name).df


def is_training(doc_id: str = "doc_id"):
    """Rows that a model may learn from: crc32 of the id as text, modulo 5, is not 0 (a null id: not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))
