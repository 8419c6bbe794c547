"""Reverse reachability with weakest-link confidence, level by level.

A node is claimed at its first hop.  Among that hop's edges the strongest
min(confidence so far, edge) wins, ties by the smaller id of the node it came
from.  Nodes reached at heuristic confidence are reported but not followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BOTH_WAYS_KINDS, CONTRACT_EDGE_KINDS, EXACT, HEURISTIC, REVERSED_KINDS
from ..sources.shared import Grown, stored


def traversable(edges: DataFrame) -> DataFrame:
    """(at, next, confidence): from a changed node to what depends on it; a hop takes the strongest of parallel edges."""
    back = edges.where(F.col("kind").isin(*REVERSED_KINDS, *BOTH_WAYS_KINDS)).select(F.col("to_id").alias("at"), F.col("from_id").alias("next"), "confidence")
    ahead = edges.where(F.col("kind").isin(*BOTH_WAYS_KINDS)).select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), "confidence")
    return back.unionByName(ahead)


#: Edges at one node that a bucket holds; nodes with more are dealt over several buckets.
HUB_EDGES = 1_000_000


def adjacency(nodes: DataFrame, edges: DataFrame) -> tuple[Grown, DataFrame]:
    """Table (at, part, next, confidence, at_path) bucketed by at and part, and the nodes (at, parts) with several parts.

    A node of very many edges is dealt over parts by the other end; such nodes are
    at most edges / HUB_EDGES.
    """
    steps = stored(traversable(edges), "steps")
    hubs = steps.limit(0).select("at", F.lit(1).alias("parts"))
    if steps.count() > HUB_EDGES:  # else no node has so many
        hubs = stored(steps.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / HUB_EDGES).cast("int").alias("parts")).where("parts > 1"), "hubs")
    names = nodes.select(F.col("id").alias("at"), F.col("qualified_path").alias("at_path"))
    rows = steps.join(F.broadcast(hubs), "at", "left").join(names, "at", "left")
    part = F.pmod(F.xxhash64("next"), F.coalesce("parts", F.lit(1))).cast("int")
    out = Grown(nodes.sparkSession, "adjacency", ["at", "part"])
    out.append(rows.select("at", part.alias("part"), "next", "confidence", "at_path"))
    return out, hubs


def next_hop(frontier: DataFrame, steps: DataFrame, hubs: DataFrame, seen: DataFrame, hop: int) -> DataFrame:
    """The nodes that a frontier reaches first; neither the adjacency nor the table of seen nodes is shuffled."""
    # A dependent's chain names the nodes between it and the seed, nearest to the seed first.
    at = frontier.where(F.col("confidence") > HEURISTIC).select(F.col("id").alias("at"), F.col("confidence").alias("so_far"), "hop", "via")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    at = at.join(F.broadcast(hubs), "at", "left").select("at", "so_far", "hop", "via", parts)
    chain = F.when(F.col("hop") == 0, F.col("via")).otherwise(F.concat("via", F.array("at_path"))).alias("chain")
    met = at.join(steps, ["at", "part"]).select("next", (-F.least("so_far", "confidence")).alias("weak"), "at", chain)
    found = met.groupBy("next").agg(F.min(F.struct("weak", "at", "chain")).alias("c")).withColumnRenamed("next", "id")
    found = found.join(seen.select("id"), "id", "left_anti")
    return found.select("id", F.lit(hop).alias("hop"), (-F.col("c.weak")).alias("confidence"), F.col("c.at").alias("parent"), F.col("c.chain").alias("via"))


def reach(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(id, hop, confidence, parent, via) of all nodes reached from seeds (id); seeds are not dependents.

    The adjacency is written once, bucketed by the node that a hop starts from, with
    that node's path; what was reached is one table, bucketed by id.  Each hop is one
    job that shuffles its frontier only and appends to that table, so neither the
    plan nor the number of joins grows with depth.
    """
    start = seeds.select("id").distinct().withColumns({"hop": F.lit(0), "confidence": F.lit(EXACT), "parent": F.lit(None).cast("string"), "via": F.array().cast("array<string>")})
    if most_hops == 1:  # one join with the edges as they are
        start, steps = stored(start, "seeds"), traversable(edges).withColumns({"part": F.lit(0), "at_path": F.lit(None).cast("string")})
        return next_hop(start, steps, start.limit(0).select(F.col("id").alias("at"), F.lit(1).alias("parts")), start, 1)
    steps, hubs = adjacency(nodes, edges)
    reached = Grown(nodes.sparkSession, "reached", ["id"])
    reached.append(start)
    hop = 0
    while most_hops is None or hop < most_hops:
        frontier = reached.read().where(F.col("hop") == hop)
        if frontier.isEmpty():
            break
        hop += 1
        reached.append(next_hop(frontier, steps.read(), hubs, reached.read(), hop))
    steps.close()
    return reached.close().where("hop > 0")


def dependents(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(bucket, path, file, line, confidence, via, is_test, id): one row for each path and bucket.

    Paths that several nodes share fold to the weakest confidence and the lowest
    id of the earliest hop.  Nodes without a row keep their id as path, '' and 0.
    """
    facts = nodes.select("id", "qualified_path", "file", "line", "is_test")
    rows = reached.join(facts, "id", "left").withColumns({"path": F.coalesce("qualified_path", "id"), "bucket": F.when(F.col("hop") == 1, "direct").otherwise("indirect")})
    first = F.min(F.struct("hop", "id", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), "via", F.coalesce("is_test", F.lit(False)).alias("is_test")))
    folded = rows.groupBy("bucket", "path").agg(F.min("confidence").alias("confidence"), first.alias("kept"))
    return folded.select("bucket", "path", "kept.file", "kept.line", "confidence", "kept.via", "kept.is_test", "kept.id")


def contracts_touched(nodes: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """(contract_kind, contract_id) of contracts at contract edges out of the touched nodes (id), seeds included."""
    links = edges.where(F.col("kind").isin(*CONTRACT_EDGE_KINDS)).join(touched.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    contracts = nodes.where("kind = 'Contract'").select(F.col("id").alias("to_id"), "contract_kind", F.col("qualified_path").alias("contract_id"))
    return links.select("to_id").distinct().join(contracts, "to_id").select("contract_kind", "contract_id").distinct()


def file_seeds(nodes: DataFrame, file: str) -> DataFrame:
    """Symbols of a file but for its module node; contracts declared there count."""
    return nodes.where((F.col("file") == file) & (F.col("kind") != "Module")).select("id")


def diff_seeds(nodes: DataFrame, touches: DataFrame) -> DataFrame:
    """Symbols whose lines meet a touched range (start inclusive, end exclusive) of their file."""
    t = touches.select(F.col("file").alias("t_file"), "start", "end")
    overlap = (F.col("file") == F.col("t_file")) & (F.col("line") < F.col("end")) & (F.col("start") <= F.greatest("line", "end_line"))
    return nodes.where("kind <> 'Module'").join(t, overlap, "left_semi").select("id")
