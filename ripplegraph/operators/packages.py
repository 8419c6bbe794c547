"""Package ownership, visibility and import rewriting, and structural interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_under
from ..schema import EXACT
from ..sources.shared import Grown, release, stored


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(language, file, root): the deepest package root that holds each file.

    A file's ancestors are few, so they are exploded and joined by equality.
    """
    parts = F.split("file", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = files.select("language", "file", F.explode(ancestors).alias("root"))
    return up.join(packages.select("language", "root").distinct(), ["language", "root"]).groupBy("language", "file").agg(F.max_by("root", F.length("root")).alias("root"))


def closure(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(package, target): reflexive, transitive closure of links (package, target) over nodes (package)."""
    step = stored(links.select("package", "target").distinct(), "links")
    pairs = Grown(nodes.sparkSession, "closure", ["package", "target"])
    pairs.append(nodes.select("package", F.col("package").alias("target")).distinct().withColumn("hop", F.lit(0)))
    hop = 0
    while not (last := pairs.read().where(F.col("hop") == hop)).isEmpty():
        new = last.join(step.select(F.col("package").alias("target"), F.col("target").alias("next")), "target").select("package", F.col("next").alias("target")).distinct()
        hop += 1
        pairs.append(new.join(pairs.read().select("package", "target"), ["package", "target"], "left_anti").withColumn("hop", F.lit(hop)))
    return pairs.close().select("package", "target")


def visible(packages: DataFrame) -> DataFrame:
    """(language, package, target, as_test): roots that code of a package sees; tests also see direct dev dependencies' closures."""
    flat = packages.select("language", F.col("root").alias("package"), F.explode("dependencies").alias("d"))
    named = packages.select("language", F.col("name").alias("dep"), F.col("root").alias("target"))
    links = flat.select("language", "package", F.col("d.package").alias("dep"), F.col("d.dev_only").alias("dev")).join(named, ["language", "dep"])
    key = F.concat_ws("\x00", "language", "package"), F.concat_ws("\x00", "language", "target")
    keyed = links.select(key[0].alias("package"), key[1].alias("target"), "dev")
    nodes = packages.select(F.concat_ws("\x00", "language", "root").alias("package"))
    normal = stored(closure(keyed.where("NOT dev"), nodes), "visible")
    dev = keyed.where("dev").select("package", F.col("target").alias("via")).join(normal.select(F.col("package").alias("via"), "target"), "via").select("package", "target")
    both = normal.withColumn("as_test", F.lit(False)).unionByName(normal.unionByName(dev).distinct().withColumn("as_test", F.lit(True)))
    part = lambda c, i: F.element_at(F.split(c, "\x00"), i)
    return both.select(part("package", 1).alias("language"), part("package", 2).alias("package"), part("target", 2).alias("target"), "as_test")


def rewrite_imports(refs: DataFrame, packages: DataFrame) -> DataFrame:
    """refs (language, package, target_module, ...) with the first segment replaced where it names the own package or a dependency."""
    own = packages.select("language", F.col("root").alias("package"), F.col("import_name").alias("first"), "module_root")
    deps = packages.select("language", F.col("root").alias("package"), F.explode("dependencies").alias("d")).select("language", "package", F.col("d.import_name").alias("first"), F.col("d.package").alias("dep"))
    named = packages.select("language", F.col("name").alias("dep"), "module_root")
    names = own.unionByName(deps.join(named, ["language", "dep"]).select("language", "package", "first", "module_root")).dropDuplicates(["language", "package", "first"])
    seg = F.split("target_module", "::")
    rest = F.array_join(F.slice(seg, 2, 1 << 20), "::")
    joined = refs.withColumn("first", F.element_at(seg, 1)).join(names, ["language", "package", "first"], "left")
    whole = F.concat_ws("::", F.nullif("module_root", F.lit("")), F.nullif(rest, F.lit("")))
    return joined.withColumn("target_module", F.when(F.col("module_root").isNotNull(), whole).otherwise(F.col("target_module"))).drop("first", "module_root")


#: A spec that more types have than this gets no marks of its types.
MARKED = 4096


def _candidates(specs: DataFrame, methods: DataFrame) -> DataFrame:
    """(language, interface, type, wanted): every type that can have all specs of an interface, and few others.

    An interface meets the types that have its rarest name.  Each carries 16-bit
    marks of the types that have its next rarest name; a type without a mark among
    them is out before it becomes a row.
    """
    key, whole = ["language", "name", "signature"], ["language", "interface"]
    counts = methods.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    by_name = specs.join(counts, key, "left").groupBy(*whole, "name").agg(F.bool_or(F.col("signature").isNull()).alias("open"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.array_sort(F.collect_set("signature")).alias("signatures"))
    ranks = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("n", "name", "signatures"))))
    names = by_name.groupBy(*whole).agg(F.bool_or("open").alias("open"), F.size(ranks).cast("long").alias("wanted"), F.slice(ranks, 1, 2).alias("two"))
    names = names.where("NOT open AND wanted > 0").select(*whole, "wanted", F.get("two", F.lit(0)).alias("rare"), F.get("two", F.lit(1)).alias("next")).where("rare.n > 0")
    names = stored(names, "rarest")
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 16)).cast("int")
    marks = methods.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.collect_set(mark("type")).alias("marks")).where(F.col("n") <= MARKED)
    # Names with several signatures go without marks.
    second = F.when(F.size("next.signatures") == 1, F.struct(F.col("next.name").alias("name"), F.get("next.signatures", F.lit(0)).alias("signature"))).alias("second")
    asked = names.select(*whole, "wanted", F.col("rare.name").alias("name"), F.explode("rare.signatures").alias("signature"), second)
    marked = marks.select(F.col("language").alias("m_language"), F.col("name").alias("m_name"), F.col("signature").alias("m_signature"), "marks")
    asked = asked.join(marked, (F.col("language") == F.col("m_language")) & (F.col("second.name") == F.col("m_name")) & (F.col("second.signature") == F.col("m_signature")), "left").drop("second", "m_language", "m_name", "m_signature")
    met = asked.join(methods.select(*key, "type", mark("type").alias("mark")), key).where(F.col("marks").isNull() | F.array_contains("marks", F.col("mark")))
    return met.select(*whole, "type", "wanted").distinct()


def implementations(specs: DataFrame, methods: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence): methods of types that have every spec of an interface, to those specs.

    ``specs`` and ``methods`` are (language, owner, name, signature, id).  An
    interface with an unknown signature has no implementations.  Division: the
    types that have an interface's rarest names are its candidates; they meet its
    other specs, and those with as many distinct names met as there are stay.
    """
    s = stored(specs.select("language", F.col("owner").alias("interface"), "name", "signature", F.col("id").alias("to_id")), "specs")
    m = stored(methods.select("language", F.col("owner").alias("type"), "name", "signature", F.col("id").alias("from_id")), "methods")
    release(s.sparkSession)
    pairs = stored(_candidates(s, m), "candidates")
    release(s.sparkSession)
    met = pairs.join(s, ["language", "interface"]).join(m, ["language", "type", "name", "signature"])
    full = met.groupBy("language", "interface", "type", "wanted").agg(F.size(F.collect_set("name")).alias("n"), F.collect_set(F.struct("from_id", "to_id")).alias("hits")).where("n = wanted")
    hit = full.select(F.explode("hits").alias("hit")).select("hit.from_id", "hit.to_id")
    return hit.select("from_id", "to_id", F.lit("Implements").alias("kind"), F.lit(EXACT).alias("confidence")).distinct()


def under(files: DataFrame, root: str) -> DataFrame:
    return files.where(is_under(F.col("file"), F.lit(root)))
