"""Dependency graphs laid over the star schema, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stable_id
from ..schema import EXACT

SEED = "region::ASIA"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, path) -> object:
    return stable_id(F.lit("star"), path, F.lit(kind), "|")


def fk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer, supplier and order rows as symbols; files are tables (customers: market segments)."""

    def rows(name, label, key, file=None, test=None):
        t = table(spark, sf_dir, name)
        path = F.concat(F.lit(f"{label}::"), F.col(key).cast("string"))
        number = next(c for c in t.columns if c.endswith("key"))
        return t.select(node_id("Type", path).alias("id"), F.lit("Type").alias("kind"), F.lit(None).cast("string").alias("contract_kind"), path.alias("qualified_path"), (F.col(file) if file else F.lit(label)).alias("file"), (F.col(number) + 1).cast("int").alias("line"), (F.col(number) + 1).cast("int").alias("end_line"), (test if test is not None else F.lit(False)).alias("is_test"))

    return (
        rows("region", "region", "r_name")
        .unionByName(rows("nation", "nation", "n_name"))
        .unionByName(rows("supplier", "supplier", "s_suppkey"))
        .unionByName(rows("customer", "customer", "c_custkey", file="c_mktsegment"))
        .unionByName(rows("orders", "order", "o_orderkey", test=F.col("o_orderstatus") == "F"))
    )


def fk_edges(spark: SparkSession, sf_dir: str, weighed: bool = False) -> DataFrame:
    """Foreign keys from dependent to dependency; with weights, by market segment and order priority."""
    path = lambda label, c: node_id("Type", F.concat(F.lit(f"{label}::"), F.col(c).cast("string")))
    t = lambda n: table(spark, sf_dir, n)
    segment = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 0).when(F.col("c_mktsegment") == "AUTOMOBILE", 1).otherwise(2)
    priority = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    exact = F.lit(EXACT)

    def edges(df, a, b, confidence=exact):
        return df.select(a.alias("from_id"), b.alias("to_id"), F.lit("References").alias("kind"), confidence.cast("int").alias("confidence"))

    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        edges(nations, path("nation", "n_name"), path("region", "r_name"))
        .unionByName(edges(customers, path("customer", "c_custkey"), path("nation", "n_name"), segment if weighed else exact))
        .unionByName(edges(suppliers, path("supplier", "s_suppkey"), path("nation", "n_name")))
        .unionByName(edges(t("orders"), path("order", "o_orderkey"), path("customer", "o_custkey"), priority if weighed else exact))
        .unionByName(edges(t("lineitem").select("l_orderkey", "l_suppkey").distinct(), path("order", "l_orderkey"), path("supplier", "l_suppkey")))
    )


def seed(spark: SparkSession, path: str = SEED) -> DataFrame:
    return spark.createDataFrame([(path,)], "p string").select(node_id("Type", F.col("p")).alias("id"))


_ID = "sha256('star|' || {p} || '|Type')"


def _p(label: str, c: str) -> str:
    return f"('{label}::' || {c}::VARCHAR)"


def fk_sql(weighed: bool = False) -> str:
    """The same nodes and edges for DuckDB, as CTEs n and e."""
    i = lambda label, c: _ID.format(p=_p(label, c))
    segment = "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 2 END" if weighed else "2"
    priority = "CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END" if weighed else "2"
    return f"""
n AS (
  SELECT {i("region", "r_name")} id, {_p("region", "r_name")} path, 'region' file, r_regionkey + 1 line, false is_test FROM region
  UNION ALL SELECT {i("nation", "n_name")}, {_p("nation", "n_name")}, 'nation', n_nationkey + 1, false FROM nation
  UNION ALL SELECT {i("supplier", "s_suppkey")}, {_p("supplier", "s_suppkey")}, 'supplier', s_suppkey + 1, false FROM supplier
  UNION ALL SELECT {i("customer", "c_custkey")}, {_p("customer", "c_custkey")}, c_mktsegment, c_custkey + 1, false FROM customer
  UNION ALL SELECT {i("order", "o_orderkey")}, {_p("order", "o_orderkey")}, 'order', o_orderkey + 1, o_orderstatus = 'F' FROM orders
), e AS (
  SELECT {i("nation", "n_name")} f, {i("region", "r_name")} t, 2 c FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {i("customer", "c_custkey")}, {i("nation", "n_name")}, {segment} FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT {i("supplier", "s_suppkey")}, {i("nation", "n_name")}, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT {i("order", "o_orderkey")}, {i("customer", "o_custkey")}, {priority} FROM orders
  UNION ALL SELECT DISTINCT {i("order", "l_orderkey")}, {i("supplier", "l_suppkey")}, 2 FROM lineitem
), h0 AS (SELECT id, 2 c, NULL::VARCHAR par, '' via FROM n WHERE path = '{SEED}'
)""" + "".join(_hop_sql(k) for k in (1, 2, 3, 4)) + """, d AS (
  SELECT r.*, n.path, n.file, n.line, n.is_test, CASE WHEN hop = 1 THEN 'direct' ELSE 'indirect' END bucket
  FROM (SELECT 1 hop, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3 UNION ALL SELECT 4, * FROM h4) r JOIN n ON n.id = r.id
)"""


def _hop_sql(k: int) -> str:
    """Hop k: the strongest edge, ties by the id it comes from; heuristic nodes aren't followed."""
    seen = " UNION ALL ".join(f"SELECT id FROM h{j}" for j in range(k))
    chain = "''" if k == 1 else "CASE WHEN h.via = '' THEN p.path ELSE h.via || ' -> ' || p.path END"
    return f""", h{k} AS (
  SELECT id, c, par, via FROM (
    SELECT e.f id, least(h.c, e.c) c, h.id par, {chain} via,
           row_number() OVER (PARTITION BY e.f ORDER BY least(h.c, e.c) DESC, h.id) r
    FROM h{k - 1} h JOIN e ON e.t = h.id JOIN n p ON p.id = h.id
    WHERE h.c > 0 AND e.f NOT IN ({seen})
  ) WHERE r = 1
)"""
