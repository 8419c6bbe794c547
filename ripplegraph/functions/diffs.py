"""Unified diffs as touched line ranges, in column expressions over the diff's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def diff_touches(lines: DataFrame) -> DataFrame:
    """(diff_id, file, start, end) from (diff_id, pos, line): start from 1, end exclusive.

    Only lines that begin with '+++ ' or '@@ ' matter.  A hunk without a count,
    or with count 0, touches one line; hunks of /dev/null touch nothing.
    """
    raw = F.trim(F.element_at(F.split(F.substring("line", 5, 1 << 30), "\t"), 1))
    path = F.when(raw.isin("", "/dev/null"), "").otherwise(F.regexp_replace(raw, "^[ab]/", ""))
    header = F.when(F.col("line").startswith("+++ "), path)
    current = F.last(header, ignorenulls=True).over(Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    # An empty path (not null) stands for no file, so that an earlier one isn't carried over.
    hunks = lines.withColumn("file", current).where(F.col("line").startswith("@@ ") & (F.col("file") != ""))
    parts = F.regexp_extract("line", r"^@@ (?:[^+\s]\S*\s+)*\++(\d+)(?:,(\d+))?(?:\s|$)", 0)
    start = F.greatest(F.lit(1), F.regexp_extract("line", r"^@@ (?:[^+\s]\S*\s+)*\++(\d+)", 1).try_cast("int"))
    count = F.regexp_extract("line", r"^@@ (?:[^+\s]\S*\s+)*\++\d+,(\d+)", 1)
    size = F.greatest(F.lit(1), F.when(count == "", 1).otherwise(count.try_cast("int")))
    return hunks.where(parts != "").select("diff_id", "file", start.alias("start"), (start + size).alias("end"))


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    """One diff text as (diff_id, pos, line)."""
    one = spark.createDataFrame([(0, text)], "diff_id int, text string")
    return one.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
