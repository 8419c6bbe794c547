"""Contracts across projects, and how surely two projects are linked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_project(touched: DataFrame, nodes: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """(project, contract_kind, contract_id, link) for each other project that has a touched contract.

    ``touched`` is (contract_kind, contract_id), ``nodes`` has a project column,
    ``links`` is (produces, consumes).  Links are a workspace file's few lines.
    """
    theirs = nodes.where("kind = 'Contract'").where(F.col("project") != source)
    theirs = theirs.select("project", "contract_kind", F.col("qualified_path").alias("contract_id")).distinct()
    return link_tiers(touched.distinct().join(theirs, ["contract_kind", "contract_id"]), links, source)


def link_tiers(matches: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """matches with link: declared (a link names the contract and the other project), strong (the projects alone), weak."""
    ours, other = F.lit(source), F.col("project")
    our_contract, their_contract = F.concat(ours, F.lit(":"), F.col("contract_id")), F.concat(other, F.lit(":"), F.col("contract_id"))
    # A link holds either way round; each pair of ends that would link a match is an equality key.
    ends = [(our_contract, other, 2), (our_contract, their_contract, 2), (their_contract, ours, 2), (ours, other, 1)]
    asked = F.explode(F.array(*[F.struct(a.alias("x"), b.alias("y"), F.lit(t).alias("t")) for a, b, t in ends])).alias("e")
    both = links.select(F.col("produces").alias("x"), F.col("consumes").alias("y"))
    both = both.unionByName(links.select(F.col("consumes").alias("x"), F.col("produces").alias("y"))).distinct().withColumn("linked", F.lit(1))
    keys = matches.columns
    met = matches.select(*keys, asked).select(*keys, "e.x", "e.y", "e.t").join(both, ["x", "y"], "left")
    rated = met.groupBy(*keys).agg(F.max(F.when(F.col("linked") == 1, F.col("t")).otherwise(0)).alias("t"))
    return rated.select(*keys, F.element_at(F.array(F.lit("weak"), F.lit("strong"), F.lit("declared")), F.col("t") + 1).alias("link"))
