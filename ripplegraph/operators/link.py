"""The linker: references to edges, as an ordered relational program.

Each request is a distinct (from node's scope, tag, module, name); scope first,
then uniqueness: language and package visibility restrict the candidates before
tiers and counts are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_under, starts_with_run
from ..schema import EXACT, PROBABLE
from ..sources.shared import stored
from . import contracts, packages, resolve

MODULE = "<module>"


def reexports(refs: DataFrame) -> DataFrame:
    """(barrel, name, origin, to_module) from import rows named x, * or a as b."""
    rows = refs.where((F.col("kind") == "Imports") & (F.col("to_name") != MODULE))
    pair = F.split("to_name", " as ")
    barrel = F.regexp_replace("from_qualified_path", "(^|::)<module>$", "")
    return rows.select(barrel.alias("barrel"), F.element_at(pair, -1).alias("name"), F.when(F.size(pair) > 1, F.element_at(pair, 1)).alias("origin"), F.col("target_module").alias("to_module")).distinct()


def _requests(refs: DataFrame, nodes: DataFrame, pk: DataFrame) -> DataFrame:
    """(from_id, kind, language, package, as_test, tag, module, name, inside, request) for each reference and from node."""
    asked = refs.select(F.col("from_qualified_path").alias("name")).distinct().select("name", F.col("name").alias("from_qualified_path"))
    sources = resolve.resolve_names(asked, nodes, ["from_qualified_path"]).select("from_qualified_path", F.col("id").alias("from_id"))
    owner = packages.owners(nodes.select("language", "file").distinct(), pk).withColumnRenamed("root", "package")
    facts = nodes.select(F.col("id").alias("from_id"), F.col("qualified_path").alias("from_path"), "language", F.col("file").alias("from_file"), "is_test")
    rows = refs.join(sources, "from_qualified_path").join(facts, "from_id").join(owner.withColumnRenamed("file", "from_file"), ["language", "from_file"], "left")
    rows = rows.join(pk.select("language", F.col("root").alias("package"), "source_root"), ["language", "package"], "left")
    scoped = F.col("target_tag").isin("Module", "ModuleDefault")
    as_test = F.col("package").isNotNull() & (F.col("is_test") | ~is_under(F.col("from_file"), F.col("source_root")) | scoped)
    rows = rows.withColumn("as_test", F.coalesce(as_test, F.lit(False)))
    moved = packages.rewrite_imports(rows.where(scoped), pk)
    rows = moved.unionByName(rows.where(~scoped))
    tag = F.when((F.col("target_tag") == "Module") & (F.col("target_module") == ""), "Unscoped").otherwise(F.col("target_tag"))
    rows = rows.select("from_id", "kind", "language", "package", "as_test", tag.alias("tag"), F.col("target_module").alias("module"), F.col("to_name").alias("name"), starts_with_run(F.col("from_path"), F.col("target_module")).alias("inside")).distinct()
    key = ["language", "package", "as_test", "tag", "module", "name", "inside"]
    return rows.withColumn("request", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key]))


def _sight(seen: DataFrame) -> resolve.Sight:
    """What requests (language, package, as_test) see: contracts; of their language, nodes without a package and those of visible ones.

    Candidates meet by name first; only they are held against visibility, so no
    node is copied for a scope.
    """
    mark = seen.select(F.col("language").alias("s_language"), F.col("package").alias("s_package"), F.col("as_test").alias("s_test"), F.col("target").alias("s_target")).distinct().withColumn("seen", F.lit(True))

    def allow(hits: DataFrame) -> DataFrame:
        same = (F.col("language") == F.col("s_language")) & (F.col("package") == F.col("s_package")) & (F.col("as_test") == F.col("s_test")) & (F.col("node_package") == F.col("s_target"))
        free = F.col("package").isNull() | F.col("node_package").isNull() | F.coalesce("seen", F.lit(False))
        return hits.join(mark, same, "left").where((F.col("node_kind") == "Contract") | ((F.col("node_language") == F.col("language")) & free))

    return allow


def link(nodes: DataFrame, refs: DataFrame, contract_refs: DataFrame, pk: DataFrame) -> DataFrame:
    """Distinct edges (from_id, to_id, kind, confidence)."""
    nodes, pk = stored(nodes, "nodes"), stored(pk, "packages")
    rows = stored(_requests(refs, nodes, pk), "requests")
    asks = rows.select("request", "language", "package", "as_test", "tag", "module", "name", "inside").distinct()
    owner = packages.owners(nodes.select("language", "file").distinct(), pk).withColumnRenamed("root", "node_package")
    universe = stored(nodes.join(owner, ["language", "file"], "left").withColumns({"node_kind": F.col("kind"), "node_language": F.col("language")}).drop("language"), "universe")
    allow, scope = _sight(stored(packages.visible(pk), "visible")), ["language", "package", "as_test"]

    def tiers(q: DataFrame) -> DataFrame:
        return resolve.resolve_names(q.select("request", *scope, "name"), universe, ["request"], allow=allow).select("request", "id", "confidence")

    opaque = tiers(asks.where("tag = 'Opaque'")).withColumn("confidence", F.least("confidence", F.lit(PROBABLE)))
    unscoped = tiers(asks.where("tag = 'Unscoped'"))

    barrels = stored(reexports(refs), "reexports")
    scoped = asks.where("tag = 'Module'")
    declared = resolve.in_module(scoped.where(F.col("name") != MODULE).select("request", *scope, "module", "name"), universe, ["request"], allow=allow)
    modules = resolve.module_scope(scoped.where(F.col("name") == MODULE).select("request", *scope, "module"), universe, ["request"], allow=allow)
    default = asks.where("tag = 'ModuleDefault'")
    direct_default = resolve.default_export(default.select("request", *scope, "module"), universe, ["request"], allow=allow)
    # Re-exported names: where they come from, looked up like direct ones.
    wanted = scoped.where(F.col("name") != MODULE).select("request", *scope, "module", "name").unionByName(default.select("request", *scope, "module", F.lit("default").alias("name")))
    targets = stored(resolve.reexport_targets(wanted, barrels), "targets")
    met = wanted.join(targets, ["module", "name"]).select("request", *scope, F.col("target_module").alias("module"), F.col("target_name").alias("name"))
    via_name = resolve.in_module(met.where("name <> 'default'").withColumn("hop", F.concat_ws("\x00", "module", "name")), universe, ["request", "hop"], allow=allow)
    via_default = resolve.default_export(met.where("name = 'default'").withColumn("hop", F.col("module")), universe, ["request", "hop"], allow=allow)
    through = via_name.select("request", "id").unionByName(via_default.select("request", "id")).distinct()
    renamed = scoped.join(barrels.where("origin IS NOT NULL AND origin <> name").select(F.col("barrel").alias("module"), "name").distinct(), ["module", "name"], "left_semi").where("NOT inside").select("request")

    # Declarations first; renames at the exact barrel first for importers outside; re-exports where nothing else is.
    choice = declared.join(renamed.withColumn("r", F.lit(1)), "request", "left").select("request", "id", F.when(F.col("r") == 1, 2).otherwise(0).alias("choice"))
    choice = choice.unionByName(modules.select("request", "id", F.lit(0).alias("choice"))).unionByName(direct_default.select("request", "id", F.lit(0).alias("choice"))).unionByName(through.select("request", "id", F.lit(1).alias("choice")))
    by = Window.partitionBy("request")
    kept = choice.withColumn("best", F.min("choice").over(by)).where("choice = best AND choice < 2").select("request", "id").distinct()
    named = kept.withColumn("confidence", F.when(F.count(F.lit(1)).over(by) > 1, PROBABLE).otherwise(EXACT))

    hits = opaque.unionByName(unscoped).unionByName(named)
    calls = rows.select("from_id", "kind", "request").join(hits, "request").select("from_id", F.col("id").alias("to_id"), "kind", "confidence")
    methods = nodes.where("method IS NOT NULL").select("language", F.col("method.owner").alias("owner"), F.element_at(F.split("qualified_path", "::"), -1).alias("name"), F.col("method.signature").alias("signature"), "id", "is_abstract")
    specs, own = methods.where("is_abstract AND language = 'go'").drop("is_abstract"), methods.where("NOT is_abstract AND language = 'go'").drop("is_abstract")
    return calls.unionByName(packages.implementations(specs, own)).unionByName(contracts.contract_edges(contract_refs, nodes)).distinct()
