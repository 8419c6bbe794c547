"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, release, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("v", "u")
    least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    return both.where("u > v").join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    least = down.groupBy("v").agg(F.min("u").alias("m"))
    moved = down.join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("v"), F.col("m")))


def labels(edges: DataFrame, most_rounds: int | None = None) -> tuple[DataFrame, bool]:
    """Stored (node, component), and whether the labels are final: with most_rounds they may be finer than the components, never coarser.

    ``edges`` has two columns of longs.  Every step is an aggregation with
    map-side combining and a join; nothing is gathered for one node.  A round is
    two steps whose results are written; the number of rounds grows with the
    logarithm of the longest chain.
    """
    spark = edges.sparkSession
    edges = edges.toDF("a", "b").where("a <> b")
    before, rounds = None, 0
    while True:
        # Written between the steps: each reads its links several times, and both in one plan would multiply that.
        large = stored(_large_star(edges), "stars")
        if rounds:
            discard(spark, edges)
        edges = stored(_small_star(large).where("a <> b").distinct(), "stars")
        discard(spark, large)
        release(spark)  # plans, generated code and blocks of finished rounds else fill the driver
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.xxhash64("a", "b") % 1_000_003).cast("long")), F.lit(0))).first()
        rounds += 1
        if now == before or now[0] == 0 or rounds == most_rounds:
            both = edges.union(edges.select("b", "b")).toDF("node", "component")
            out = stored(both.groupBy("node").agg(F.min("component").alias("component")), "components")
            discard(spark, edges)
            return out, now == before or now[0] == 0
        before = now


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable, for each node with a link to another one."""
    return labels(edges)[0]
