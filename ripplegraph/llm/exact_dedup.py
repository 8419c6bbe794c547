"""Exact dedup by a persistent digest index, bucketed and sorted by the digest.

Texts are equal when identical after each run of ASCII white space becomes one
space.  ``DigestIndex`` is a table (digest, keep_id) bucketed and sorted by
digest.  ``deduplicate`` shrinks a batch to one row for each digest (with
map-side partial aggregation, so a group of any size leaves each task as one
row), anti-joins that with the index by sort-merge on the common bucketing,
appends what is new and labels every row of the batch.

Main path: DataFrame operations only.  The join that hands labels back to the
rows may meet a digest that a third of all rows share; the rows are narrow
there and adaptive execution splits that partition.

Results: one row for each input row.  Of rows repeated with the same id and
text, one is kept at most.  Null text is empty text.  A row with a null id never
becomes the kept one unless all ids of its group are null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """The index as a bucketed table of the session's catalog; ``location`` makes it outlive the catalog."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None, location: str | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(self.table):
            place = f"LOCATION '{location}'" if location else ""
            spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {place}"
            )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Rows (digest, keep_id) of new digests; they are dealt and sorted as the table is."""
        rows.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.table)


def deduplicate(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for each row of df; index gets the digests it lacked.

    keep_id is the smallest id of the text's group in the first batch that held
    the text; kept marks that row.  group_size counts the rows of this batch.
    """
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), digest(F.col(text_col)).alias("digest")).groupBy("digest", "row_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = stored(rows, "digests")  # texts are read and hashed once; from here on rows are narrow
    groups = rows.groupBy("digest").agg(F.min("row_id").alias("first_id"), F.sum("copies").alias("group_size"))
    index.append(groups.join(index.read(), "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id")))
    # Read back, so that the join below has a shuffle of its own on either side, which adaptive execution can split.
    labels = stored(groups.join(index.read(), "digest").select("digest", "keep_id", "group_size"), "labels")
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return rows.join(labels, "digest").select("digest", "row_id", "keep_id", "group_size", each).select(
        F.col("row_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "digest",
    )
