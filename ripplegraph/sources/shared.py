"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; where none is set, a local one, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """After a large shuffle: its files go now, not at the driver's next garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


class Grown:
    """A table in the shared folder that rounds append to, bucketed and sorted by its keys.

    A join on the keys reads it as it lies: however many rounds there are, there
    is one table to join with, and it is never shuffled.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str]):
        self.spark, self.keys = spark, keys
        self.table = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark).rstrip('/')}/{self.table}"
        self.parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def append(self, df: DataFrame) -> None:
        dealt = df.repartition(self.parts, *self.keys)
        dealt.write.mode("append").option("path", self.path).format("parquet").bucketBy(self.parts, *self.keys).sortBy(*self.keys).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> DataFrame:
        """The rows, without the catalog's entry."""
        out = self.spark.read.schema(self.read().schema).parquet(self.path)
        self.spark.sql(f"DROP TABLE {self.table}")
        return out
