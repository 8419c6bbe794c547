"""Queries on incremental ingest and usage roll-ups, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..operators import usage
from ..sources import files, store
from .graphs import table


def _cached(docs):
    """Hashes of nine in ten documents, every thirteenth altered."""
    key = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.where("doc_id % 10 <> 0").select(F.col("doc_id").cast("string").alias("file"), F.sha2(key, 256).alias("content_hash"))


def _scanned(docs):
    return store.hashed(docs.where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content")))


_INGEST = """c AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) h FROM documents WHERE doc_id % 10 <> 0),
s AS (SELECT doc_id, sha256(text) h FROM documents WHERE doc_id % 11 <> 0)"""


def hash_skip(spark, d):
    docs = table(spark, d, "documents")
    return store.changed(_scanned(docs), _cached(docs)).select("file", "content_hash")


def prune_missing(spark, d):
    docs = table(spark, d, "documents")
    return store.deleted(_cached(docs), _scanned(docs)).select("file")


def index_stats(spark, d):
    docs = table(spark, d, "documents")
    seen, cached = _scanned(docs), _cached(docs)
    new = store.changed(seen, cached)
    counts = seen.agg(F.count(F.lit(1)).alias("seen")).crossJoin(new.agg(F.count(F.lit(1)).alias("indexed"))).crossJoin(store.deleted(cached, seen).agg(F.count(F.lit(1)).alias("pruned")))
    return counts.select("indexed", (F.col("seen") - F.col("indexed")).alias("skipped"), "pruned")


def replace_file(spark, d):
    """Per-file rows after a run: changed and deleted files' rows make way for the new ones."""
    docs = table(spark, d, "documents")
    seen, cached = _scanned(docs), _cached(docs)
    new = store.changed(seen, cached)
    gone = new.select("file").unionByName(store.deleted(cached, seen).select("file"))
    return store.replaced(cached, new.select("file", "content_hash"), gone)


def node_upsert(spark, d):
    """Customers that share a segment and nation declare one path; the last file wins."""
    nodes = table(spark, d, "customer").select(F.concat_ws("::", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("id"), F.col("c_name").alias("file"), F.col("c_custkey").alias("line"))
    return store.upserted(nodes)


def duplicate_content(spark, d):
    docs = store.hashed(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")))
    return docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_FILES = ["src/{n}/lib.rs", "src/{n}.ts", "a/{n}/__init__.py", "{n}_test.go", "src/{n}.kt", "node_modules/{n}.js", "src/{n}.swift", "x/{n}.hpp", "gen/{n}.py", "README.md"]


def _named(spark, d):
    return table(spark, d, "nation").select(F.replace(F.element_at(F.array(*map(F.lit, _FILES)), (F.col("n_nationkey") % 10 + 1).cast("int")), F.lit("{n}"), F.col("n_name")).alias("file"))


def scan_routing(spark, d):
    """Files that are not pruned or excluded, with adapter and module path."""
    kept = files.routed(files.pruned(_named(spark, d), files.Config(exclude=["gen/**"])))
    return kept.select("file", "language", columns.module_path(F.col("file"), F.col("language")).alias("module"))


ROUTING_SQL = """
SELECT file, language, CASE k WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN 'a::' || n_name WHEN 3 THEN n_name || '_test' WHEN 4 THEN n_name WHEN 6 THEN 'src::' || n_name ELSE 'x::' || n_name END AS module
FROM (SELECT n_name, n_nationkey % 10 k, replace(['src/{n}/lib.rs', 'src/{n}.ts', 'a/{n}/__init__.py', '{n}_test.go', 'src/{n}.kt', '', 'src/{n}.swift', 'x/{n}.hpp', '', ''][n_nationkey % 10 + 1], '{n}', n_name) file,
      ['rust', 'typescript', 'python', 'go', 'kotlin', '', 'swift', 'cpp', '', ''][n_nationkey % 10 + 1] AS language FROM nation)
WHERE k NOT IN (5, 8, 9)
"""


def _usage(spark, d):
    e = table(spark, d, "events")
    return e.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("command"), (F.col("user_id") % 9).cast("string").alias("client"), (F.col("event_type") != "error").alias("success"))


def _usage_query(period):
    def q(spark, d):
        return usage.rollup(_usage(spark, d), period)

    q.__name__ = f"usage_{period}"
    return q


_FORMAT = {"daily": "%Y-%m-%d", "weekly": "%Y-W%W", "monthly": "%Y-%m"}


def _usage_sql(period):
    return f"SELECT strftime(date_trunc('second', ts), '{_FORMAT[period]}') bucket, count(*) runs, count(*) FILTER (event_type <> 'error') succeeded FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 12"


def usage_by_client(spark, d):
    return usage.breakdown(_usage(spark, d), "weekly", "client")


def usage_by_command(spark, d):
    return usage.breakdown(_usage(spark, d), "daily", "command")


def _breakdown_sql(period, column, name):
    return f"WITH e AS (SELECT strftime(ts, '{_FORMAT[period]}') bucket, {column} {name} FROM events), k AS (SELECT DISTINCT bucket FROM e ORDER BY 1 DESC LIMIT 12) SELECT bucket, {name}, count(*) runs FROM e WHERE bucket IN (FROM k) GROUP BY ALL"


QUERIES = {f.__name__: f for f in (hash_skip, prune_missing, index_stats, replace_file, node_upsert, duplicate_content, scan_routing, *map(_usage_query, _FORMAT), usage_by_client, usage_by_command)}
ORACLES = {
    "hash_skip": f"WITH {_INGEST} SELECT s.doc_id::VARCHAR file, s.h content_hash FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = s.doc_id AND c.h = s.h)",
    "prune_missing": f"WITH {_INGEST} SELECT doc_id::VARCHAR file FROM c WHERE doc_id NOT IN (SELECT doc_id FROM s)",
    "index_stats": f"WITH {_INGEST}, j AS (SELECT count(*) n, count(*) FILTER (c.h = s.h) same FROM s LEFT JOIN c USING (doc_id)) SELECT n - same indexed, same skipped, (SELECT count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM s)) pruned FROM j",
    "replace_file": f"WITH {_INGEST} SELECT doc_id::VARCHAR file, h content_hash FROM s",
    "node_upsert": "SELECT c_mktsegment || '::' || c_nationkey id, max_by(c_name, (c_name, c_custkey)) file, max_by(c_custkey, (c_name, c_custkey)) line FROM customer GROUP BY 1",
    "duplicate_content": "SELECT sha256(text) content_hash, count(*) n, min(doc_id) AS \"first\" FROM documents GROUP BY 1 HAVING count(*) > 1",
    "scan_routing": ROUTING_SQL,
    **{f"usage_{p}": _usage_sql(p) for p in _FORMAT},
    "usage_by_client": _breakdown_sql("weekly", "(user_id % 9)::VARCHAR", "client"),
    "usage_by_command": _breakdown_sql("daily", "event_type", "command"),
}
