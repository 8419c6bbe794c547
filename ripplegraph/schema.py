"""Schemas of the fact tables and the closed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the data model.
NODE_KINDS = ("Module", "Type", "Function", "Field", "Trait", "Contract")
CONTRACT_KINDS = ("ApiRoute", "Event", "Table", "Test")
EDGE_KINDS = ("Calls", "References", "Implements", "Contains", "Imports", "Produces", "Consumes", "Reads", "Writes")
ROLES = ("produces", "consumes", "reads", "writes")
HEURISTIC, PROBABLE, EXACT = 0, 1, 2
CONFIDENCE_NAMES = ("Heuristic", "Probable", "Exact")
#: Kinds followed from a changed symbol to its dependents, and those followed both ways.
REVERSED_KINDS = ("Calls", "References", "Imports", "Produces", "Consumes", "Reads", "Writes")
BOTH_WAYS_KINDS = ("Implements",)
CONTRACT_EDGE_KINDS = ("Produces", "Consumes", "Reads", "Writes")

SOURCE_FILES = "project_id string, file string, content string"
NODES = (
    "id string, kind string, contract_kind string, qualified_path string, file string, line int, end_line int, language string, "
    "is_test boolean, is_generated boolean, is_default_export boolean, is_abstract boolean, method struct<owner: string, signature: string>"
)
REFS = "file string, from_qualified_path string, to_name string, kind string, target_tag string, target_module string"
CONTRACT_REFS = "file string, contract_kind string, contract_id string, symbol_name string, role string"
EDGES = "from_id string, to_id string, kind string, confidence int"
PACKAGES = "language string, root string, name string, import_name string, module_root string, source_root string, dependencies array<struct<package: string, import_name: string, dev_only: boolean>>"
FILE_HASHES = "file string, content_hash string"
DIFF_TOUCHES = "file string, start int, end int"
USAGE_EVENTS = "ts bigint, command string, source string, client string, client_version string, duration_ms bigint, success boolean"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
