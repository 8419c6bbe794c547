"""Names to symbols: tiered, scoped and default-export joins.

All results are candidate rows with explicit priorities; the lowest priority of
a request wins and the number of survivors sets the confidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contains_run, last_two, parent_path, short_name
from ..schema import EXACT, HEURISTIC, PROBABLE
from ..sources.shared import Grown, stored


def with_names(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"short": short_name(F.col("qualified_path")), "two": last_two(F.col("qualified_path")), "parent": parent_path(F.col("qualified_path"))})


#: What a request may see of its candidates, before tiers and counts are taken.
Sight = Callable[[DataFrame], DataFrame]
#: Columns of a candidate that a Sight may look at.
SEEN = ("node_kind", "node_language", "node_package")


def _with_sight(nodes: DataFrame, allow: Sight | None) -> list[str]:
    return [c for c in SEEN if c in nodes.columns] if allow else []


def resolve_names(requests: DataFrame, nodes: DataFrame, keys: list[str], scope: list[str] | None = None, allow: Sight | None = None) -> DataFrame:
    """(keys..., id, tier, confidence): hits of requests (keys..., name) in the first tier that has any.

    Tier 1 is the exact path (always exact), tier 2 the last two segments, tier 3
    the last one; several hits of tiers 2 and 3 are all kept as heuristic.
    ``scope`` names columns that request and node must share; ``allow`` drops
    candidates (request and SEEN columns) that a request doesn't see.
    """
    scope = scope or []
    more = _with_sight(nodes, allow)
    n = with_names(nodes).select(F.col("id").alias("node_id"), "qualified_path", "two", "short", *scope, *more)
    tiers = []
    for tier, column in enumerate(("qualified_path", "two", "short"), 1):
        named = n.select("node_id", F.col(column).alias("name"), *scope, *more).where("name IS NOT NULL")
        tiers.append(requests.join(named, ["name", *scope]).withColumn("tier", F.lit(tier)))
    hits = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    hits = (allow(hits) if allow else hits).select(*keys, "node_id", "tier")
    best = Window.partitionBy(*keys)
    first = hits.withColumn("best", F.min("tier").over(best)).where("tier = best").drop("best").distinct()
    many = F.count(F.lit(1)).over(best) > 1
    confidence = F.when((F.col("tier") > 1) & many, HEURISTIC).otherwise(EXACT)
    return first.withColumn("confidence", confidence).withColumnRenamed("node_id", "id")


def prefer(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Concrete hand-written symbols, else those not generated, else all; one is exact, several probable."""
    rank = F.when(~F.col("is_generated") & ~F.col("is_abstract"), 0).when(~F.col("is_generated"), 1).otherwise(2)
    by = Window.partitionBy(*keys)
    kept = candidates.withColumn("choice", rank).withColumn("best", F.min("choice").over(by)).where("choice = best").drop("choice", "best").distinct()
    return kept.withColumn("confidence", F.when(F.count(F.lit(1)).over(by) > 1, PROBABLE).otherwise(EXACT))


def in_module(requests: DataFrame, nodes: DataFrame, keys: list[str], scope: list[str] | None = None, allow: Sight | None = None) -> DataFrame:
    """Symbols named by requests (keys..., module, name) under a module.

    The path must end in the name's segments, and the module's segments must be
    neighbours in front of them.  The short name and the module's last segment are
    the equality keys (a symbol has one row for each segment in front of its name,
    so a common short name meets its own module's requests only); the rest is a
    residual condition.
    """
    scope = scope or []
    r = requests.withColumns({"short": short_name(F.col("name")), "key": short_name(F.col("module"))})
    front_parts = F.filter(F.split("qualified_path", "::"), lambda x, i: i < F.size(F.split("qualified_path", "::")) - 1)
    n = with_names(nodes).select(F.col("id"), "qualified_path", "short", "is_generated", "is_abstract", *scope, *_with_sight(nodes, allow), F.explode(F.array_distinct(front_parts)).alias("key"))
    ends = F.concat(F.lit("::"), F.col("qualified_path")).endswith(F.concat(F.lit("::"), F.col("name")))
    front = F.col("qualified_path").substr(F.lit(1), F.length("qualified_path") - F.length("name") - 2)
    hit = r.join(n, ["short", "key", *scope]).where(ends & contains_run(front, F.col("module")))
    hit = allow(hit) if allow else hit
    return prefer(hit.select(*keys, "id", "is_generated", "is_abstract"), keys).select(*keys, "id", "confidence")


def default_export(requests: DataFrame, nodes: DataFrame, keys: list[str], scope: list[str] | None = None, allow: Sight | None = None) -> DataFrame:
    """Default-export symbols under the modules of requests (keys..., module); the name is ignored."""
    scope = scope or []
    flagged = with_names(nodes).where("is_default_export").select("id", F.col("parent").alias("owner"), *scope, *_with_sight(nodes, allow))
    # The module's last segment is the equality key among the owner's segments.
    flagged = flagged.withColumn("key", F.explode(F.split("owner", "::")))
    r = requests.withColumn("key", short_name(F.col("module")))
    hit = r.join(flagged, ["key", *scope]).where(contains_run(F.col("owner"), F.col("module")))
    hit = (allow(hit) if allow else hit).select(*keys, "id").distinct()
    many = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    return hit.withColumn("confidence", F.when(many, PROBABLE).otherwise(EXACT))


def module_scope(requests: DataFrame, nodes: DataFrame, keys: list[str], scope: list[str] | None = None, allow: Sight | None = None) -> DataFrame:
    """Module nodes of requests (keys..., module): the exact owner alone, else owners that contain it."""
    scope = scope or []
    modules = with_names(nodes).where("kind = 'Module'").select("id", F.col("parent").alias("owner"), *scope, *_with_sight(nodes, allow)).withColumn("key", F.explode(F.array_distinct(F.split("owner", "::"))))
    hit = requests.withColumn("key", short_name(F.col("module"))).join(modules, ["key", *scope]).where(contains_run(F.col("owner"), F.col("module")))
    hit = (allow(hit) if allow else hit).select(*keys, "id", F.when(F.col("owner") == F.col("module"), 0).otherwise(1).alias("choice")).distinct()
    by = Window.partitionBy(*keys)
    kept = hit.withColumn("best", F.min("choice").over(by)).where("choice = best").select(*keys, "id")
    return kept.withColumn("confidence", F.when(F.count(F.lit(1)).over(by) > 1, PROBABLE).otherwise(EXACT))


def bare_name_hint(path: str, nodes: DataFrame) -> DataFrame:
    """One row (hint): sorted paths that the last segment of an unresolved path could mean."""
    spark = nodes.sparkSession
    request = spark.createDataFrame([(0, path.rsplit("::", 1)[-1])], "request int, name string")
    hits = resolve_names(request, nodes, ["request"]).join(nodes.select("id", "qualified_path"), "id")
    return hits.agg(F.array_sort(F.collect_set("qualified_path")).alias("hint"))


def reexport_targets(requests: DataFrame, reexports: DataFrame) -> DataFrame:
    """(module, name, target_module, target_name): where re-exported names come from, over any number of barrels.

    A barrel re-exports rows of its own name, or everything ('*') but a default.
    Exact barrel paths are preferred to modules that contain the asked one.
    Visited (module, name) pairs are not followed again.
    """
    rows = stored(reexports.select("barrel", F.col("name").alias("as_name"), "origin", "to_module").distinct().withColumn("key", F.explode(F.array_distinct(F.split("barrel", "::")))), "barrels")
    keys = ["module", "name", "m", "n"]
    # Rows with a name meet by key and name, so a barrel of many names costs each request its own rows only.
    named, every = rows.where("as_name <> '*'").withColumn("n", F.col("as_name")), rows.where("as_name = '*'")
    seen = Grown(requests.sparkSession, "targets", keys)
    seen.append(requests.select("module", "name").distinct().select("module", "name", F.col("module").alias("m"), F.col("name").alias("n"), F.lit(0).alias("hop")))
    hop = 0
    while not (front := seen.read().where(F.col("hop") == hop).drop("hop")).isEmpty():
        asked = front.withColumn("key", short_name(F.col("m")))
        columns = [*keys, "barrel", "origin", "to_module"]
        by_name = asked.join(named, ["key", "n"]).select(*columns)
        by_star = asked.where("n <> 'default'").join(every, "key").select(*columns)
        hit = by_name.unionByName(by_star).where(contains_run(F.col("barrel"), F.col("m")))
        hit = hit.withColumn("choice", F.when(F.col("barrel") == F.col("m"), 0).otherwise(1))
        best = F.min("choice").over(Window.partitionBy(*keys))
        step = hit.withColumn("best", best).where("choice = best").select("module", "name", F.col("to_module").alias("m"), F.coalesce("origin", "n").alias("n")).distinct()
        hop += 1
        seen.append(step.join(seen.read().select(*keys), keys, "left_anti").withColumn("hop", F.lit(hop)))
    return seen.close().where("hop > 0").select("module", "name", F.col("m").alias("target_module"), F.col("n").alias("target_name")).distinct()
