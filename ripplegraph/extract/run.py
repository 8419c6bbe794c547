"""Adapters as one table function: each file is parsed once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import module_path, stable_id
from ..sources.files import Config, is_manifest, parse_cargo
from . import braces, python

SYMBOL = "struct<kind: string, path: string, line: int, end_line: int, is_test: boolean, is_default_export: boolean, is_abstract: boolean, owner: string, signature: string, contract_kind: string>"
REF = "struct<source: string, name: string, kind: string, tag: string, module: string>"
CONTRACT = "struct<kind: string, contract_id: string, symbol: string, role: string>"
SCHEMA = f"file string, language string, generated boolean, symbols array<{SYMBOL}>, refs array<{REF}>, contracts array<{CONTRACT}>"

ADAPTERS = {
    "rust": braces.rust,
    "typescript": braces.script,
    "python": python.extract,
    "go": braces.go,
    "kotlin": lambda file, module, text, config: braces.plain("kotlin", file, module, text),
    "swift": lambda file, module, text, config: braces.plain("swift", file, module, text),
    "cpp": braces.cpp,
}

#: Frameworks of which one must be configured for an adapter's routes; Python's adapter tells its own apart.
ROUTE_FRAMEWORKS = {"rust": {"axum"}, "typescript": {"express", "fastify"}, "go": {"net/http"}}


def extracted(files: DataFrame, config: Config, aliases: list | None = None) -> DataFrame:
    """One row for each file (file, language, content): its symbols, references and contract references."""
    settings = config.__dict__ | {"aliases": aliases or []}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, language, module, text in zip(b["file"], b["language"], b["module"], b["content"], strict=True):
                x = ADAPTERS[language](file, module, text or "", settings)
                if language in ROUTE_FRAMEWORKS and not ROUTE_FRAMEWORKS[language] & set(settings["api_frameworks"]):
                    x.contracts = [c for c in x.contracts if c.kind != "ApiRoute"]
                rows.append((file, language, x.generated, [s.__dict__ for s in x.symbols], [r.__dict__ for r in x.refs], [c.__dict__ for c in x.contracts]))
            yield pd.DataFrame(rows, columns=["file", "language", "generated", "symbols", "refs", "contracts"])

    named = files.withColumn("module", module_path(F.col("file"), F.col("language")))
    return named.select("file", "language", "module", "content").mapInPandas(work, SCHEMA)


def nodes_of(rows: DataFrame, project: str) -> DataFrame:
    s = rows.select("file", "language", "generated", F.explode("symbols").alias("s"))
    kind = F.when(F.col("s.kind") == "Contract", F.concat(F.lit("Contract:"), "s.contract_kind")).otherwise(F.col("s.kind"))
    method = F.when(F.col("s.owner").isNotNull(), F.struct(F.col("s.owner").alias("owner"), F.col("s.signature").alias("signature")))
    return s.select(
        stable_id(F.lit(project), F.col("s.path"), kind).alias("id"), "s.kind", "s.contract_kind", F.col("s.path").alias("qualified_path"), "file", "s.line", "s.end_line", "language",
        "s.is_test", F.col("generated").alias("is_generated"), "s.is_default_export", "s.is_abstract", method.alias("method"),
    )


def refs_of(rows: DataFrame) -> DataFrame:
    return rows.select("file", F.explode("refs").alias("r")).select("file", F.col("r.source").alias("from_qualified_path"), F.col("r.name").alias("to_name"), "r.kind", F.col("r.tag").alias("target_tag"), F.col("r.module").alias("target_module"))


def contract_refs_of(rows: DataFrame) -> DataFrame:
    return rows.select("file", F.explode("contracts").alias("c")).select("file", F.col("c.kind").alias("contract_kind"), "c.contract_id", F.col("c.symbol").alias("symbol_name"), "c.role")


def packages_of(files: DataFrame) -> DataFrame:
    """Package rows of the manifests among files."""
    ddl = "language string, root string, name string, import_name string, module_root string, source_root string, dependencies array<struct<package: string, import_name: string, dev_only: boolean>>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [p for f, t in zip(b["file"], b["content"], strict=True) if (p := parse_cargo(f, t))]
            yield pd.DataFrame(found, columns=["language", "root", "name", "import_name", "module_root", "source_root", "dependencies"])

    return files.where(is_manifest(F.col("file"))).select("file", "content").mapInPandas(work, ddl)
