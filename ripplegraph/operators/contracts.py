"""Contract references: synthesis of missing contract nodes and links to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stable_id
from .resolve import resolve_names

_KINDS = {"produces": "Produces", "consumes": "Consumes", "reads": "Reads", "writes": "Writes"}


def synthesised(contract_refs: DataFrame, nodes: DataFrame, project: str) -> DataFrame:
    """Contract nodes for routes and tables that are referenced but not declared; events are never made up."""
    wanted = contract_refs.where(F.col("contract_kind").isin("ApiRoute", "Table")).select("contract_kind", F.col("contract_id").alias("qualified_path")).distinct()
    known = nodes.where("kind = 'Contract'").select("contract_kind", "qualified_path")
    new = wanted.join(known, ["contract_kind", "qualified_path"], "left_anti")
    node_id = stable_id(F.lit(project), F.col("qualified_path"), F.concat(F.lit("Contract:"), F.col("contract_kind")))
    plain = {"kind": F.lit("Contract"), "file": F.lit(""), "line": F.lit(0), "end_line": F.lit(0), "language": F.lit("")}
    flags = {c: F.lit(False) for c in ("is_test", "is_generated", "is_default_export", "is_abstract")}
    out = new.withColumns({"id": node_id, **plain, **flags, "method": F.lit(None).cast("struct<owner: string, signature: string>")})
    return out.select("id", "kind", "contract_kind", "qualified_path", "file", "line", "end_line", "language", "is_test", "is_generated", "is_default_export", "is_abstract", "method")


def contract_edges(contract_refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from symbols (tiers over all nodes) to contracts (exact path); refs without both are dropped, unknown roles too."""
    role = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    refs = contract_refs.where(F.col("role").isin(*_KINDS)).select("contract_kind", "contract_id", "symbol_name", F.element_at(role, F.col("role")).alias("kind")).distinct()
    symbols = resolve_names(refs.select(F.col("symbol_name").alias("name")).distinct().select("name", F.col("name").alias("symbol_name")), nodes, ["symbol_name"])
    contracts = nodes.where("kind = 'Contract'").select("contract_kind", F.col("qualified_path").alias("contract_id"), F.col("id").alias("to_id"))
    hit = refs.join(contracts, ["contract_kind", "contract_id"]).join(symbols, "symbol_name")
    return hit.select(F.col("id").alias("from_id"), "to_id", "kind", "confidence").distinct()
