"""Snapshots of the fact tables, with schema and extractor versions.

A snapshot is a folder of Parquet tables; the current one is named by the last
row of a small log that is written after the tables.  Readers thus never see a
half-written index, and the previous snapshot stays for comparison.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..schema import struct

SCHEMA_VERSION, EXTRACTOR_VERSION = 8, "2"
TABLES = {"files": schema.FILE_HASHES, "nodes": schema.NODES, "refs": schema.REFS, "contract_refs": schema.CONTRACT_REFS, "edges": schema.EDGES, "packages": schema.PACKAGES}
_LOG = "snapshot string, at double, schema_version int, extractor_version string, config string"


class NotIndexedError(LookupError):
    """A query on a project that was never indexed is an error, never an empty report."""


class Store:
    """Versioned tables of one project under a path that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def log(self) -> list:
        if not self._exists(f"{self.path}/log"):
            return []
        return self.spark.read.schema(struct(_LOG)).parquet(f"{self.path}/log").orderBy("at").collect()

    def usable(self, config: str | None = None) -> bool:
        """Whether the current snapshot may be built upon: no older schema, the same extractor, the same configuration."""
        log = self.log()
        if not log:
            return False
        last = log[-1]
        return last.snapshot != "" and last.schema_version >= SCHEMA_VERSION and last.extractor_version == EXTRACTOR_VERSION and config in (None, last.config)

    def read(self, table: str) -> DataFrame:
        log = self.log()
        if not log or log[-1].snapshot == "":
            raise NotIndexedError(f"{self.path} holds no index; run index() first")
        return self.spark.read.schema(struct(TABLES[table])).parquet(f"{self.path}/{log[-1].snapshot}/{table}")

    def read_or_empty(self, table: str, config: str | None = None) -> DataFrame:
        return self.read(table) if self.usable(config) else self.spark.createDataFrame([], struct(TABLES[table]))

    def write(self, tables: dict[str, DataFrame], config: str = "") -> None:
        name = f"snapshot-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{table}")
        self._note(name, config)

    def clear(self) -> None:
        """Forget the index; the log, and so the versions, stay."""
        self._note("", "")

    def _note(self, snapshot: str, config: str) -> None:
        row = [(snapshot, time.time(), SCHEMA_VERSION, EXTRACTOR_VERSION, config)]
        self.spark.createDataFrame(row, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Hashed files whose (file, hash) isn't cached."""
    return files.join(cached.select("file", "content_hash"), ["file", "content_hash"], "left_anti")


def deleted(cached: DataFrame, seen: DataFrame) -> DataFrame:
    """Cached files that the scan did not see."""
    return cached.join(seen.select("file"), "file", "left_anti")


def replaced(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a per-file table: those of replaced and deleted files make way for new ones."""
    return old.join(gone.select("file").distinct(), "file", "left_anti").unionByName(new)


def upserted(nodes: DataFrame) -> DataFrame:
    """One node for each id: paths that several files declare keep the last file's."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("file", "line")).alias("n")).select("id", "n.*")
