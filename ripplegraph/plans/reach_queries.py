"""Queries on traversal and reports, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import render, report, traverse
from ..schema import EXACT
from ..sources.shared import stored
from .graphs import fk_edges, fk_nodes, fk_sql, seed, table


def _dependents(spark: SparkSession, d: str, weighed: bool = False, most_hops: int | None = None) -> DataFrame:
    nodes = stored(fk_nodes(spark, d), "nodes")  # ids are digests: worked out once
    return traverse.dependents(nodes, traverse.reach(nodes, fk_edges(spark, d, weighed), seed(spark), most_hops))


def direct_dependents(spark, d):
    return _dependents(spark, d, most_hops=1).where("bucket = 'direct'").select("path", "file", "line", "confidence")


def indirect_dependents(spark, d):
    return _dependents(spark, d).where("bucket = 'indirect'").select("path", "file", "line", "confidence")


def weakest_link_confidence(spark, d):
    return _dependents(spark, d, True).select("bucket", "path", "confidence")


def heuristic_stop(spark, d):
    """Heuristic arrivals are in the result; nothing is reached through them alone."""
    nodes = fk_nodes(spark, d)
    reached = traverse.reach(nodes, fk_edges(spark, d, True), seed(spark))
    return reached.groupBy("hop", "confidence").agg(F.count(F.lit(1)).alias("n"))


def explain_via(spark, d):
    return _dependents(spark, d, True).select("bucket", "path", F.concat_ws(" -> ", "via").alias("via"))


def min_confidence_filter(spark, d):
    return report.filter_confidence(_dependents(spark, d, True), EXACT).select("bucket", "path", "confidence")


def explain_off(spark, d):
    return report.without_chains(_dependents(spark, d, True)).select("path", F.size("via").alias("via_length"))


def summary_by_file(spark, d):
    rows = report.summary_by_file(_dependents(spark, d))
    return rows.select("file", "count", F.concat_ws(",", F.transform("shown", lambda x: x["path"])).alias("shown"))


def affected_tests(spark, d):
    return report.affected_tests(_dependents(spark, d)).select("path", "file", "line", "confidence")


def report_counts(spark, d):
    return report.counts(_dependents(spark, d, True), contracts_touched(spark, d))


def _report(spark, d, lines):
    return lines(stored(_dependents(spark, d, True), "dependents"), stored(contracts_touched(spark, d), "touched"))


def report_text(spark, d):
    """A whole report's lines with their places, chains included."""
    return _report(spark, d, render.text_lines)


def report_summary(spark, d):
    return _report(spark, d, render.summary_lines)


def bucket_fold(spark, d):
    """Nodes that share a path (market segment) fold to the weakest confidence within a bucket."""
    nodes = fk_nodes(spark, d)
    folded = nodes.withColumn("qualified_path", F.concat(F.lit("file::"), F.col("file")))
    reached = traverse.reach(nodes, fk_edges(spark, d, True), seed(spark))
    return traverse.dependents(folded, reached).select("bucket", "path", "confidence", "id")


def cyclic_reach(spark, d):
    """Parts and suppliers that order lines join are linked both ways: a cyclic graph."""
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = F.concat(F.lit("part::"), F.col("l_partkey").cast("string")), F.concat(F.lit("supplier::"), F.col("l_suppkey").cast("string"))
    one = pairs.select(part.alias("from_id"), supplier.alias("to_id"), F.lit("Calls").alias("kind"), F.lit(EXACT).alias("confidence"))
    edges = one.unionByName(one.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "kind", "confidence"))
    nodes = edges.select(F.col("from_id").alias("id"), F.col("from_id").alias("qualified_path")).distinct()
    start = spark.createDataFrame([("supplier::1",)], "id string")
    return traverse.reach(nodes, edges, start).select("id", "hop")


CYCLIC_SQL = """
WITH RECURSIVE p AS (SELECT DISTINCT 'part::' || l_partkey a, 'supplier::' || l_suppkey b FROM lineitem),
e AS (SELECT a f, b t FROM p UNION ALL SELECT b, a FROM p),
r(id, hop) USING KEY (id) AS (
  SELECT 'supplier::1', 0
  UNION
  SELECT DISTINCT e.f, r.hop + 1 FROM r JOIN e ON e.t = r.id WHERE e.f NOT IN (SELECT id FROM recurring.r)
)
SELECT id, hop FROM r WHERE hop > 0
"""


def implements_both_ways(spark, d):
    """Implements edges carry a change either way: nation to region as specs, two hops from a nation."""
    nodes = fk_nodes(spark, d).where("file IN ('region', 'nation')")
    edges = fk_edges(spark, d).join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").withColumn("kind", F.lit("Implements"))
    start = nodes.where("qualified_path = 'nation::NATION_0'").select("id")
    return traverse.reach(nodes, edges, start).join(nodes.select("id", "qualified_path"), "id").select("qualified_path", "hop")


IMPLEMENTS_SQL = """
SELECT 'region::' || r_name qualified_path, 1 hop FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_0'
UNION ALL SELECT 'nation::' || b.n_name, 2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name = 'NATION_0' AND b.n_name <> 'NATION_0'
"""


def _event_graph(spark, d, where="true"):
    """Users and event types: purchases and signups produce, views and clicks consume, errors read."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "Produces").when(F.col("event_type").isin("view", "click"), "Consumes").otherwise("Reads")
    e = table(spark, d, "events").where(where)
    edges = e.select(F.concat(F.lit("customer::"), F.col("user_id").cast("string")).alias("from_id"), F.concat(F.lit("event::"), "event_type", F.lit("::"), (F.col("user_id") % 50).cast("string")).alias("to_id"), kind.alias("kind"), F.lit(EXACT).alias("confidence")).distinct()
    nodes = edges.select(F.col("to_id").alias("id")).distinct().select("id", F.lit("Contract").alias("kind"), F.when(F.col("id").startswith("event::error"), "Table").otherwise("Event").alias("contract_kind"), F.col("id").alias("qualified_path"))
    return nodes, edges


def contracts_touched(spark, d):
    nodes, edges = _event_graph(spark, d)
    users = table(spark, d, "customer").where("c_nationkey = 3").select(F.concat(F.lit("customer::"), F.col("c_custkey").cast("string")).alias("id"))
    return traverse.contracts_touched(nodes, edges, users)


CONTRACTS_SQL = """
SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'Table' ELSE 'Event' END contract_kind, 'event::' || event_type || '::' || (user_id % 50) contract_id
FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey = 3
"""


def _bucket_graph(spark, d, where):
    """One event contract for each user bucket; types are sides."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "Produces").otherwise("Consumes")
    e = table(spark, d, "events").where(where).where("event_type <> 'error'")
    edges = e.select(F.col("user_id").cast("string").alias("from_id"), F.concat(F.lit("bucket::"), (F.col("user_id") % 97).cast("string")).alias("to_id"), kind.alias("kind"), F.lit(EXACT).alias("confidence"))
    nodes = spark.range(97).select(F.concat(F.lit("bucket::"), F.col("id").cast("string")).alias("id"), F.lit("Contract").alias("kind"), F.lit("Event").alias("contract_kind"), F.concat(F.lit("bucket::"), F.col("id").cast("string")).alias("qualified_path"))
    return nodes, edges


_FIRST_HALF, _SECOND_HALF = "ts < timestamp_ntz '2024-01-16 00:00:00'", "ts >= timestamp_ntz '2024-01-16 00:00:00'"


def event_wiring(spark, d):
    return report.event_wiring(*_bucket_graph(spark, d, "true"))


def event_loss(spark, d):
    """The first half of the month against the second; buckets that only one kind of event reaches there lose a side."""
    return report.event_losses(report.event_wiring(*_bucket_graph(spark, d, _FIRST_HALF)), report.event_wiring(*_bucket_graph(spark, d, _SECOND_HALF)))


def _wiring_sql(where: str) -> str:
    return f"""SELECT 'bucket::' || b.range AS event, coalesce(bool_or(event_type IN ('purchase', 'signup')), false) produced, coalesce(bool_or(event_type NOT IN ('purchase', 'signup')), false) consumed
FROM range(97) b LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error' AND {where.replace("timestamp_ntz", "TIMESTAMP")}) e ON e.user_id % 97 = b.range GROUP BY b.range"""


LOSS_SQL = f"""
WITH b AS ({_wiring_sql(_FIRST_HALF)}), a AS ({_wiring_sql(_SECOND_HALF)})
SELECT event, NOT coalesce(a.produced, false) lost_producer, NOT coalesce(a.consumed, false) lost_consumer
FROM b LEFT JOIN a USING (event) WHERE b.produced AND b.consumed AND NOT (coalesce(a.produced, false) AND coalesce(a.consumed, false))
"""


def file_seed_filter(spark, d):
    return traverse.file_seeds(fk_nodes(spark, d), "BUILDING")


def diff_overlap(spark, d):
    """Documents stacked by source are symbols of a file; every seventh one's middle is touched."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    end = F.sum("n").over(Window.partitionBy("source").orderBy("doc_id"))
    placed = docs.withColumn("end_line", end.cast("int")).withColumn("line", (F.col("end_line") - F.col("n") + 1).cast("int"))
    nodes = placed.select(F.col("doc_id").cast("string").alias("id"), F.lit("Function").alias("kind"), F.col("source").alias("file"), "line", "end_line")
    middle = (F.col("line") + F.floor((F.col("end_line") - F.col("line")) / 2)).cast("int")
    touches = placed.where("doc_id % 7 = 0").select(F.col("source").alias("file"), middle.alias("start"), (F.col("end_line") + 2).alias("end"))
    return traverse.diff_seeds(nodes, touches).select(F.col("id").cast("long").alias("doc_id"))


OVERLAP_SQL = """
WITH p AS (SELECT doc_id, source, length(text) n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) e FROM documents),
s AS (SELECT doc_id, source, e - n + 1 l, e FROM p),
t AS (SELECT source, l + (e - l) // 2 a, e + 2 b FROM s WHERE doc_id % 7 = 0)
SELECT doc_id FROM s WHERE EXISTS (SELECT 1 FROM t WHERE t.source = s.source AND s.l < t.b AND t.a <= greatest(s.l, s.e))
"""


def _with(body: str, weighed: bool = False) -> str:
    return f"WITH {fk_sql(weighed)}\n{body}"


#: Lines that both kinds of report share; x holds the entries of a section.
_MARK = "CASE c WHEN 2 THEN '' WHEN 1 THEN ' [probable]' ELSE ' [heuristic]' END"
_LINES = f"""
k AS ({CONTRACTS_SQL}),
shared AS (
  SELECT CASE contract_kind WHEN 'ApiRoute' THEN 2 WHEN 'Event' THEN 3 ELSE 4 END section, '' file, 0 AS "at", contract_id AS name, 0 part, '  ' || contract_id AS text FROM k
  UNION ALL SELECT 5, '', -1, '', 0, '  ' || count(DISTINCT path) FILTER (is_test) || ' affected tests' FROM d)
"""


def _entry_sql(section: str, where: str) -> str:
    own = f"SELECT {section}, '', 0, path, 0, '  ' || path || '  ' || file || ':' || line || {_MARK} FROM d WHERE {where}"
    return f"{own} UNION ALL SELECT {section}, '', 0, path, 1, '    via ' || via FROM d WHERE via <> '' AND {where}"


TEXT_SQL = _with(f"""SELECT * FROM shared UNION ALL {_entry_sql("CASE bucket WHEN 'direct' THEN 0 ELSE 1 END", "true")} UNION ALL {_entry_sql("5", "is_test")}
UNION ALL SELECT h.i, '', -2, '', 0, h.t FROM (VALUES (0, 'DIRECT'), (1, 'INDIRECT'), (2, 'API'), (3, 'EVENTS'), (4, 'DATABASE'), (5, 'TESTS')) h(i, t)""", True).replace("\nSELECT * FROM shared", f", {_LINES}\nSELECT * FROM shared")

SUMMARY_SQL = _with(f"""SELECT * FROM shared UNION ALL {_entry_sql("0", "bucket = 'direct'")}
UNION ALL SELECT DISTINCT 1, file, -1, '', 0, '  ' || file || ' (' || n || ')' FROM g
UNION ALL SELECT 1, file, line, path, 0, '    ' || path || '  (line ' || line || ')' || {_MARK} FROM g WHERE r <= 3
UNION ALL SELECT DISTINCT 1, file, 2147483647, '', 0, '    ... ' || (n - 3) || ' more' FROM g WHERE n > 3
UNION ALL SELECT 0, '', -2, '', 0, 'DIRECT (' || count(*) || ')' FROM d WHERE bucket = 'direct'
UNION ALL SELECT 1, '', -2, '', 0, 'INDIRECT (' || count(*) || ' across ' || count(DISTINCT file) || CASE WHEN count(DISTINCT file) = 1 THEN ' file)' ELSE ' files)' END FROM g
UNION ALL SELECT 2, '', -2, '', 0, 'API (' || count(*) || ')' FROM k WHERE contract_kind = 'ApiRoute'
UNION ALL SELECT 3, '', -2, '', 0, 'EVENTS (' || count(*) || ')' FROM k WHERE contract_kind = 'Event'
UNION ALL SELECT 4, '', -2, '', 0, 'DATABASE (' || count(*) || ')' FROM k WHERE contract_kind = 'Table'
UNION ALL SELECT 5, '', -2, '', 0, 'TESTS'""", True).replace("\nSELECT * FROM shared", f", {_LINES}, g AS (SELECT *, count(*) OVER (PARTITION BY file) n, row_number() OVER (PARTITION BY file ORDER BY line, path) r FROM d WHERE bucket = 'indirect')\nSELECT * FROM shared")


QUERIES = {f.__name__: f for f in (direct_dependents, indirect_dependents, weakest_link_confidence, heuristic_stop, explain_via, explain_off, min_confidence_filter, summary_by_file, affected_tests, report_counts, report_text, report_summary, bucket_fold, cyclic_reach, implements_both_ways, contracts_touched, event_wiring, event_loss, file_seed_filter, diff_overlap)}

ORACLES = {
    "direct_dependents": _with("SELECT path, file, line, c confidence FROM d WHERE bucket = 'direct'"),
    "indirect_dependents": _with("SELECT path, file, line, c confidence FROM d WHERE bucket = 'indirect'"),
    "weakest_link_confidence": _with("SELECT bucket, path, c confidence FROM d", True),
    "heuristic_stop": _with("SELECT hop, c confidence, count(*) n FROM d GROUP BY ALL", True),
    "explain_via": _with("SELECT bucket, path, via FROM d", True),
    "explain_off": _with("SELECT path, 0 via_length FROM d", True),
    "min_confidence_filter": _with("SELECT bucket, path, c confidence FROM d WHERE c >= 2", True),
    "summary_by_file": _with("SELECT file, n AS count, string_agg(path, ',' ORDER BY line, path) shown FROM (SELECT *, count(*) OVER (PARTITION BY file) n, row_number() OVER (PARTITION BY file ORDER BY line, path) r FROM d WHERE bucket = 'indirect') WHERE r <= 3 GROUP BY file, n"),
    "affected_tests": _with("SELECT path, file, line, c confidence FROM d WHERE is_test"),
    "report_counts": _with(f"""SELECT count(*) FILTER (bucket = 'direct') direct, count(*) FILTER (bucket = 'indirect') indirect, count(DISTINCT path) FILTER (is_test) tests, k.*
FROM d, (SELECT count(*) FILTER (contract_kind = 'ApiRoute') api, count(*) FILTER (contract_kind = 'Event') events, count(*) FILTER (contract_kind = 'Table') AS "database" FROM ({CONTRACTS_SQL})) k GROUP BY ALL""", True),
    "report_text": TEXT_SQL,
    "report_summary": SUMMARY_SQL,
    "bucket_fold": _with("SELECT bucket, 'file::' || file path, min(c) confidence, min_by(id, (hop, id)) id FROM d GROUP BY ALL", True),
    "cyclic_reach": CYCLIC_SQL,
    "implements_both_ways": IMPLEMENTS_SQL,
    "contracts_touched": CONTRACTS_SQL,
    "event_wiring": _wiring_sql("true"),
    "event_loss": LOSS_SQL,
    "file_seed_filter": f"WITH {fk_sql()} SELECT id FROM n WHERE file = 'BUILDING'",
    "diff_overlap": OVERLAP_SQL,
}
