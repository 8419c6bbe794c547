"""Shaping of impact reports: filters, counts, groups, affected tests, event wiring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: entries that a summary shows of each file.
GROUP_LIMIT = 3


def filter_confidence(dependents: DataFrame, least: int) -> DataFrame:
    """Hide weak dependents; what was reached, and the contracts, stay as they are."""
    return dependents.where(F.col("confidence") >= least)


def without_chains(dependents: DataFrame) -> DataFrame:
    return dependents.withColumn("via", F.array().cast("array<string>"))


def counts(dependents: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row: direct, indirect, tests, api, events, database."""
    tests = F.count_distinct(F.when(F.col("is_test"), F.col("path")))
    of = dependents.agg(F.count_if(F.col("bucket") == "direct").alias("direct"), F.count_if(F.col("bucket") == "indirect").alias("indirect"), tests.alias("tests"))
    kinds = {"api": "ApiRoute", "events": "Event", "database": "Table"}
    return of.crossJoin(contracts.agg(*[F.count_if(F.col("contract_kind") == k).alias(n) for n, k in kinds.items()]))


def affected_tests(dependents: DataFrame) -> DataFrame:
    """Test dependents, one row for each path; the indirect one wins."""
    return dependents.where("is_test").groupBy("path").agg(F.max_by(F.struct("file", "line", "confidence", "via"), "bucket").alias("d")).select("path", "d.*")


def summary_by_file(dependents: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(file, count, shown): indirect dependents by file with the first few by line and path."""
    by = Window.partitionBy("file")
    rows = dependents.where("bucket = 'indirect'").withColumns({"n": F.row_number().over(by.orderBy("line", "path")), "count": F.count(F.lit(1)).over(by)})
    shown = F.array_sort(F.collect_list(F.struct("line", "path", "confidence", "via")))
    return rows.where(F.col("n") <= limit).groupBy("file", "count").agg(shown.alias("shown"))


def event_wiring(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(event, produced, consumed) of every declared event."""
    events = nodes.where("kind = 'Contract' AND contract_kind = 'Event'").select(F.col("id").alias("to_id"), F.col("qualified_path").alias("event"))
    sides = edges.where(F.col("kind").isin("Produces", "Consumes")).select("to_id", "kind")
    found = events.join(sides, "to_id", "left").groupBy("event")
    return found.agg(F.coalesce(F.bool_or(F.col("kind") == "Produces"), F.lit(False)).alias("produced"), F.coalesce(F.bool_or(F.col("kind") == "Consumes"), F.lit(False)).alias("consumed"))


def event_losses(before: DataFrame, after: DataFrame) -> DataFrame:
    """(event, lost_producer, lost_consumer) of events wired on both sides before and not any more."""
    now = after.select("event", F.col("produced").alias("p"), F.col("consumed").alias("c"))
    rows = before.where("produced AND consumed").join(now, "event", "left")
    lost = rows.select("event", (~F.coalesce("p", F.lit(False))).alias("lost_producer"), (~F.coalesce("c", F.lit(False))).alias("lost_consumer"))
    return lost.where("lost_producer OR lost_consumer")
