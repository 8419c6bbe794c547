"""Usage roll-ups by day, week or month."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import grouped, percent_bar, period_bucket

EVENTS = "ts long, command string, source string, client string, client_version string, duration_ms long, success boolean"


def record(spark: SparkSession, path: str, command: str, source: str, client: str, client_version: str | None, duration_ms: int, success: bool) -> None:
    """Append one event to the usage log; nothing when RIPPLEGRAPH_NO_USAGE is set."""
    if "RIPPLEGRAPH_NO_USAGE" not in os.environ:
        row = [(int(time.time()), command, source, client, client_version, duration_ms, success)]
        spark.createDataFrame(row, EVENTS).coalesce(1).write.mode("append").parquet(path)


def rollup(events: DataFrame, period: str, latest: int = 12) -> DataFrame:
    """(bucket, runs, succeeded): the latest buckets, newest first."""
    rows = events.select(period_bucket(F.col("ts"), period).alias("bucket"), "success")
    totals = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("succeeded"))
    return totals.orderBy(F.desc("bucket")).limit(latest)


def breakdown(events: DataFrame, period: str, by: str, latest: int = 12) -> DataFrame:
    """(bucket, by, runs) of the latest buckets in one aggregation, most runs first, ties by name."""
    each = events.select(period_bucket(F.col("ts"), period).alias("bucket"), by).groupBy("bucket", by).agg(F.count(F.lit(1)).alias("runs"))
    kept = each.select("bucket").distinct().orderBy(F.desc("bucket")).limit(latest)
    return each.join(kept, "bucket", "left_semi").orderBy(F.desc("bucket"), F.desc("runs"), by)


def lines(events: DataFrame, period: str, latest: int = 12) -> DataFrame:
    """(bucket, part, runs, name, text) of the roll-up: a heading for each bucket, then its clients and its commands."""
    totals = rollup(events, period, latest)
    failed = F.col("runs") - F.col("succeeded")
    calls = F.concat("bucket", F.lit("  "), grouped(F.col("runs")), F.lit(" calls"), F.when(failed > 0, F.concat(F.lit(", "), failed.cast("string"), F.lit(" failed"))).otherwise(""))
    out = totals.select("bucket", F.lit(0).alias("part"), "runs", F.lit("").alias("name"), calls.alias("text"))
    for part, by in ((1, "client"), (2, "command")):
        each = breakdown(events, period, by, latest)
        whole = F.sum("runs").over(Window.partitionBy("bucket"))
        share = F.lpad(F.format_number(F.col("runs") / whole * 100, 1), 5, " ")
        text = F.concat(F.lit(f"  {by} "), F.coalesce(by, F.lit("")), F.lit("  "), percent_bar(F.col("runs"), whole), F.lit("  "), grouped(F.col("runs")), F.lit("  "), share, F.lit("%"))
        out = out.unionByName(each.select("bucket", F.lit(part).alias("part"), "runs", F.coalesce(by, F.lit("")).alias("name"), text.alias("text")))
    return out


def ordered(rows: DataFrame) -> DataFrame:
    """Newest bucket first, most runs first, ties by name."""
    return rows.orderBy(F.desc("bucket"), "part", F.desc("runs"), "name")
