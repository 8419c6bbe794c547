"""Queries on name resolution, packages, contracts and projects, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, sqltext
from ..functions.changes import change_target
from ..functions.diffs import diff_touches
from ..operators import contracts, packages, resolve, workspace
from ..schema import EXACT
from ..sources.shared import stored
from .graphs import table


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols brand::type::name_key; names repeat, so short names are ambiguous."""
    p = table(spark, d, "part")
    path = F.concat_ws("::", F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_type", F.lit(" "), F.lit("_")), F.replace("p_name", F.lit(" "), F.lit("_")))
    rows = p.groupBy(path.alias("qualified_path")).agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("size"))
    return rows.select(columns.stable_id(F.lit("parts"), "qualified_path", F.lit("Function"), "|").alias("id"), F.lit("Function").alias("kind"), F.lit(None).cast("string").alias("contract_kind"), "qualified_path", F.when(F.col("k") % 2 == 0, "go").otherwise("rust").alias("language"), (F.col("size") % 5 == 0).alias("is_generated"), (F.col("size") % 7 == 0).alias("is_abstract"), (F.col("size") % 11 == 0).alias("is_default_export"))


PARTS = """
s AS (SELECT sha256('parts|' || path || '|Function') id, *, string_split(path, '::') seg FROM (
  SELECT replace(p_brand, '#', '') || '::' || replace(p_type, ' ', '_') || '::' || replace(p_name, ' ', '_') path,
         CASE WHEN min(p_partkey) % 2 = 0 THEN 'go' ELSE 'rust' END lang, min(p_size) % 5 = 0 gen, min(p_size) % 7 = 0 abs, min(p_size) % 11 = 0 def
  FROM part GROUP BY 1))
"""


def _resolved(spark, d, name) -> DataFrame:
    nodes = part_symbols(spark, d)
    asked = nodes.select(name.alias("name")).distinct().select("name", F.col("name").alias("asked"))
    return resolve.resolve_names(asked, nodes, ["asked"]).select("asked", "id", "tier", "confidence")


def resolve_exact(spark, d):
    return _resolved(spark, d, F.col("qualified_path"))


def resolve_last_two(spark, d):
    return _resolved(spark, d, columns.last_two(F.col("qualified_path")))


def resolve_short(spark, d):
    return _resolved(spark, d, columns.short_name(F.col("qualified_path")))


def _tier_sql(asked: str) -> str:
    return f"""WITH {PARTS}, a AS (SELECT DISTINCT {asked} asked FROM s), h AS (
  SELECT asked, id, 1 tier FROM a JOIN s ON path = asked
  UNION ALL SELECT asked, id, 2 FROM a JOIN s ON seg[-2] || '::' || seg[-1] = asked
  UNION ALL SELECT asked, id, 3 FROM a JOIN s ON seg[-1] = asked),
b AS (SELECT *, min(tier) OVER (PARTITION BY asked) m FROM h),
c AS (SELECT DISTINCT asked, id, tier FROM b WHERE tier = m)
SELECT *, CASE WHEN tier > 1 AND count(*) OVER (PARTITION BY asked) > 1 THEN 0 ELSE 2 END confidence FROM c"""


def bare_name_hint(spark, d):
    nodes = part_symbols(spark, d)
    hint = resolve.bare_name_hint("missing::" + "part_1", nodes.withColumn("qualified_path", F.regexp_replace("qualified_path", "::[^:]*$", "::part_1")))
    return hint.select(F.concat_ws(",", "hint").alias("hint"))


HINT_SQL = f"WITH {PARTS} SELECT string_agg(DISTINCT p, ',' ORDER BY p) hint FROM (SELECT regexp_replace(path, '::[^:]*$', '::part_1') p FROM s)"


def _scoped_requests(nodes: DataFrame) -> DataFrame:
    brand = F.element_at(columns.segments(F.col("qualified_path")), 1)
    return nodes.select(brand.alias("module"), columns.short_name(F.col("qualified_path")).alias("name"), "language").distinct()


def module_scoped_resolve(spark, d):
    nodes = part_symbols(spark, d)
    return resolve.in_module(_scoped_requests(nodes), nodes, ["module", "name", "language"], ["language"])


SCOPED_SQL = f"""
WITH {PARTS}, r AS (SELECT DISTINCT seg[1] m, seg[-1] name, lang FROM s),
h AS (SELECT r.*, s.id, CASE WHEN NOT gen AND NOT abs THEN 0 WHEN NOT gen THEN 1 ELSE 2 END ch
      FROM r JOIN s ON s.seg[-1] = r.name AND s.lang = r.lang AND contains('::' || array_to_string(s.seg[:-2], '::') || '::', '::' || r.m || '::')),
b AS (SELECT *, min(ch) OVER (PARTITION BY m, name, lang) best FROM h)
SELECT m AS module, name, lang AS language, id, CASE WHEN count(*) OVER (PARTITION BY m, name, lang) > 1 THEN 1 ELSE 2 END confidence FROM b WHERE ch = best
"""


def default_export_resolve(spark, d):
    nodes = part_symbols(spark, d)
    asked = nodes.select(F.element_at(columns.segments(F.col("qualified_path")), 1).alias("module")).distinct()
    return resolve.default_export(asked, nodes, ["module"])


DEFAULT_SQL = f"""
WITH {PARTS}, r AS (SELECT DISTINCT seg[1] m FROM s),
h AS (SELECT DISTINCT m, id FROM r JOIN s ON def AND contains('::' || array_to_string(seg[:-2], '::') || '::', '::' || m || '::'))
SELECT m AS module, id, CASE WHEN count(*) OVER (PARTITION BY m) > 1 THEN 1 ELSE 2 END confidence FROM h
"""


def module_scope_resolve(spark, d):
    """Brands and brand::type pairs own module nodes; requests name brands and types."""
    paths = part_symbols(spark, d).select(columns.segments(F.col("qualified_path")).alias("s"))
    owner = paths.select(F.concat_ws("::", F.col("s")[0], F.col("s")[1]).alias("o")).where("substring(o, 1, 7) <> 'Brand11'").union(paths.select(F.col("s")[0]).where("s[0] LIKE 'Brand1%'")).distinct()
    nodes = owner.select(F.col("o").alias("id"), F.lit("Module").alias("kind"), F.concat("o", F.lit("::<module>")).alias("qualified_path"))
    asked = paths.select(F.col("s")[0].alias("module")).union(paths.select(F.col("s")[1])).distinct()
    return resolve.module_scope(asked, nodes, ["module"])


MODULE_SQL = f"""
WITH {PARTS}, o AS (SELECT DISTINCT seg[1] || '::' || seg[2] o FROM s WHERE substring(seg[1], 1, 7) <> 'Brand11' UNION SELECT DISTINCT seg[1] FROM s WHERE seg[1] LIKE 'Brand1%'),
r AS (SELECT DISTINCT seg[1] m FROM s UNION SELECT DISTINCT seg[2] FROM s),
h AS (SELECT DISTINCT m, o, CASE WHEN o = m THEN 0 ELSE 1 END ch FROM r JOIN o ON contains('::' || o || '::', '::' || m || '::')),
b AS (SELECT *, min(ch) OVER (PARTITION BY m) best FROM h)
SELECT m AS module, o AS id, CASE WHEN count(*) OVER (PARTITION BY m) > 1 THEN 1 ELSE 2 END confidence FROM b WHERE ch = best
"""


def reexport_closure(spark, d):
    """Nations re-export everything to their region's barrel, customers by name to their nation's; cyclic barrels end."""
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("barrel"), F.lit("*").alias("name"), F.lit(None).cast("string").alias("origin"), F.col("n_name").alias("to_module"))
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("barrel"), F.concat(F.lit("c"), (F.col("c_custkey") % 10).cast("string")).alias("name"), F.col("c_name").alias("origin"), F.col("c_mktsegment").alias("to_module"))
    back = named.select(F.col("to_module").alias("barrel"), F.col("origin").alias("name"), F.lit(None).cast("string").alias("origin"), F.col("barrel").alias("to_module"))
    asked = r.select(F.col("r_name").alias("module"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("c"), i.cast("string")))).alias("name"))
    return resolve.reexport_targets(asked, up.unionByName(named).unionByName(back))


REEXPORT_SQL = """
WITH RECURSIVE x AS (
  SELECT r_name b, '*' nm, NULL::VARCHAR o, n_name t FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT n_name, 'c' || (c_custkey % 10), c_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT c_mktsegment, c_name, NULL, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
w(module, name, m, n) AS (
  SELECT r_name, 'c' || i.range, r_name, 'c' || i.range FROM region, range(10) i
  UNION
  SELECT w.module, w.name, x.t, coalesce(x.o, w.n) FROM w JOIN x ON x.b = w.m AND (x.nm = w.n OR (x.nm = '*' AND w.n <> 'default')))
SELECT DISTINCT module, name, m target_module, n target_name FROM w WHERE NOT (m = module AND n = name)
"""


def contract_synthesis(spark, d):
    """Nation tables are read by suppliers; those of even keys are declared already."""
    n = table(spark, d, "nation")
    declared = n.where("n_nationkey % 2 = 0").select(F.lit("Contract").alias("kind"), F.lit("Table").alias("contract_kind"), F.col("n_name").alias("qualified_path"))
    refs = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.element_at(F.array(F.lit("Table"), F.lit("Event")), (F.col("s_suppkey") % 3 == 0).cast("int") + 1).alias("contract_kind"), F.col("n_name").alias("contract_id"))
    return contracts.synthesised(refs, declared, "star").select("contract_kind", "qualified_path", "file", "line")


SYNTH_SQL = """
SELECT DISTINCT 'Table' contract_kind, n_name qualified_path, '' file, 0 line FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0 AND n_nationkey % 2 <> 0
"""


def contract_links(spark, d):
    """Parts by short name read or write tables named after their type; ambiguous names link heuristically."""
    nodes = part_symbols(spark, d)
    kind = F.element_at(columns.segments(F.col("qualified_path")), 2)
    refs = nodes.select(F.lit("Table").alias("contract_kind"), kind.alias("contract_id"), columns.short_name(F.col("qualified_path")).alias("symbol_name"), F.when(F.col("is_generated"), "writes").when(F.col("is_abstract"), "unknown").otherwise("reads").alias("role"))
    tables = nodes.where("is_abstract").select(kind.alias("t")).distinct().select(F.col("t").alias("id"), F.lit("Contract").alias("kind"), F.lit("Table").alias("contract_kind"), F.concat(F.lit("db::"), "t").alias("qualified_path"))
    exact = tables.withColumn("qualified_path", F.col("id"))
    return contracts.contract_edges(refs, nodes.select("id", "kind", "contract_kind", "qualified_path").unionByName(exact))


CONTRACT_LINK_SQL = f"""
WITH {PARTS}, t AS (SELECT DISTINCT seg[2] t FROM s WHERE abs),
r AS (SELECT DISTINCT seg[2] c, seg[-1] name, CASE WHEN gen THEN 'Writes' ELSE 'Reads' END kind FROM s WHERE gen OR NOT abs),
h AS (SELECT r.c, r.name, r.kind, s.id FROM r JOIN s ON s.seg[-1] = r.name)
SELECT DISTINCT h.id from_id, h.c to_id, h.kind, CASE WHEN (SELECT count(*) FROM s WHERE s.seg[-1] = h.name) > 1 THEN 0 ELSE 2 END confidence FROM h JOIN t ON t.t = h.c
"""


def interface_division(spark, d):
    """Interfaces are orders' sets of parts; types are customers with all those parts among their orders."""
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("name")).distinct()
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    methods = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("owner"), "name").distinct()
    s = line.select(F.lit("x").alias("language"), F.col("l_orderkey").cast("string").alias("owner"), "name", F.lit("()").alias("signature"), F.concat_ws("/", F.col("l_orderkey").cast("string"), "name").alias("id"))
    m = methods.select(F.lit("x").alias("language"), "owner", "name", F.lit("()").alias("signature"), F.concat_ws("/", F.lit("c"), "owner", "name").alias("id"))
    return packages.implementations(s, m)


DIVISION_SQL = """
WITH l AS (SELECT DISTINCT l_orderkey o, l_partkey n FROM lineitem), w AS (SELECT o, count(*) parts FROM l GROUP BY o),
m AS (SELECT DISTINCT o_custkey c, n FROM l JOIN orders ON o = o_orderkey),
p AS (SELECT l.o, m.c FROM l JOIN m USING (n) JOIN w USING (o) GROUP BY l.o, m.c, parts HAVING count(*) = parts)
SELECT 'c/' || p.c || '/' || l.n from_id, p.o || '/' || l.n to_id, 'Implements' kind, 2 confidence FROM p JOIN l ON l.o = p.o
"""


def _trade(spark, d) -> DataFrame:
    """Packages are nations; one depends on the nations that supply its orders."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where("c_nationkey < s_nationkey").select(F.col("c_nationkey").cast("string").alias("package"), F.col("s_nationkey").cast("string").alias("target"), (F.col("l_linenumber") % 2 == 0).alias("dev"))


def package_closure(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("package"))
    return packages.closure(_trade(spark, d).where("NOT dev"), nodes)


_TRADE_SQL = """t AS (SELECT DISTINCT c_nationkey::VARCHAR p, s_nationkey::VARCHAR g, l_linenumber % 2 = 0 dev FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey),
w(package, target) AS (SELECT n_nationkey::VARCHAR, n_nationkey::VARCHAR FROM nation UNION SELECT w.package, t.g FROM w JOIN t ON t.p = w.target AND NOT t.dev)"""
CLOSURE_SQL = f"WITH RECURSIVE {_TRADE_SQL} SELECT package, target FROM w"


def package_visibility(spark, d):
    deps = _trade(spark, d).distinct().groupBy("package").agg(F.collect_list(F.struct(F.concat(F.lit("n"), "target").alias("package"), F.col("target").alias("import_name"), F.col("dev").alias("dev_only"))).alias("dependencies"))
    rows = table(spark, d, "nation").select(F.lit("rust").alias("language"), F.col("n_nationkey").cast("string").alias("root"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    pk = rows.join(deps.withColumnRenamed("package", "root"), "root", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<struct<package: string, import_name: string, dev_only: boolean>>")))
    return packages.visible(stored(pk, "packages"))


VISIBLE_SQL = f"""WITH RECURSIVE {_TRADE_SQL}
SELECT 'rust' AS language, package, target, false as_test FROM w
UNION SELECT 'rust', package, target, true FROM w
UNION SELECT 'rust', t.p, w.target, true FROM t JOIN w ON w.package = t.g WHERE t.dev"""


def import_rewrite(spark, d):
    """References by customers' nations to modules that start with a nation's name."""
    deps = _trade(spark, d).where("NOT dev").select("package", "target").distinct().groupBy("package").agg(F.collect_list(F.struct(F.concat(F.lit("n"), "target").alias("package"), F.concat(F.lit("use"), "target").alias("import_name"), F.lit(False).alias("dev_only"))).alias("dependencies"))
    rows = table(spark, d, "nation").select(F.lit("rust").alias("language"), F.col("n_nationkey").cast("string").alias("root"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("use"), F.col("n_nationkey").cast("string")).alias("import_name"), F.concat(F.lit("crates::"), "n_name").alias("module_root"))
    pk = stored(rows.join(deps.withColumnRenamed("package", "root"), "root", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<struct<package: string, import_name: string, dev_only: boolean>>"))), "packages")
    refs = table(spark, d, "customer").select(F.lit("rust").alias("language"), F.col("c_nationkey").cast("string").alias("package"), F.concat(F.lit("use"), (F.col("c_custkey") % 25).cast("string"), F.lit("::"), "c_mktsegment").alias("target_module"), "c_custkey")
    return packages.rewrite_imports(refs, pk).select("c_custkey", "target_module")


REWRITE_SQL = f"""WITH RECURSIVE {_TRADE_SQL}
SELECT c_custkey, CASE WHEN c_custkey % 25 = c_nationkey OR EXISTS (SELECT 1 FROM t WHERE NOT dev AND p = c_nationkey::VARCHAR AND g = (c_custkey % 25)::VARCHAR)
  THEN 'crates::' || (SELECT n_name FROM nation WHERE n_nationkey = c_custkey % 25) || '::' || c_mktsegment ELSE 'use' || (c_custkey % 25) || '::' || c_mktsegment END target_module
FROM customer"""


def owner_longest_prefix(spark, d):
    """Page paths under package roots that are the first one or two parts of other pages' paths."""
    path = F.regexp_replace("url", "^https?://", "")
    pages = table(spark, d, "pages").select("page_id", path.alias("file"), F.lit("x").alias("language"))
    parts = F.split("file", "/")
    roots = pages.where("page_id % 3 = 0").select("language", F.array_join(F.slice(parts, 1, 1), "/").alias("root")).union(pages.where("page_id % 5 = 0").select("language", F.array_join(F.slice(parts, 1, 2), "/"))).distinct()
    return packages.owners(pages, roots).select("file", "root")


OWNER_SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') f FROM pages),
r AS (SELECT string_split(f, '/')[1] r FROM p WHERE page_id % 3 = 0 UNION SELECT array_to_string(string_split(f, '/')[1:2], '/') FROM p WHERE page_id % 5 = 0)
SELECT f AS file, arg_max(r, length(r)) root FROM (SELECT DISTINCT f FROM p) JOIN r ON starts_with(f, r || '/') GROUP BY f
"""


def _regions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Contracts are part types by a supplier's region; regions are projects."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = rows.select(F.col("r_name").alias("project"), F.lit("Contract").alias("kind"), F.lit("ApiRoute").alias("contract_kind"), F.concat_ws("/", "p_type", (F.col("p_size") % 4).cast("string")).alias("qualified_path")).distinct()
    return nodes, spark.createDataFrame([("ASIA", "EUROPE"), ("ASIA:STANDARD/1", "AFRICA"), ("AMERICA", "ASIA:SMALL/2")], "produces string, consumes string")


def cross_project(spark, d):
    nodes, links = _regions(spark, d)
    touched = nodes.where("project = 'ASIA'").select("contract_kind", F.col("qualified_path").alias("contract_id"))
    return workspace.cross_project(touched, nodes, links, "ASIA")


CROSS_SQL = """
WITH c AS (SELECT DISTINCT r_name p, p_type || '/' || (p_size % 4) i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
l(a, b) AS (VALUES ('ASIA', 'EUROPE'), ('ASIA:STANDARD/1', 'AFRICA'), ('AMERICA', 'ASIA:SMALL/2'))
SELECT o.p project, 'ApiRoute' contract_kind, o.i contract_id,
  CASE WHEN EXISTS (SELECT 1 FROM l WHERE (a = 'ASIA:' || o.i AND b IN (o.p, o.p || ':' || o.i)) OR (b = 'ASIA:' || o.i AND a IN (o.p, o.p || ':' || o.i)) OR (a = o.p || ':' || o.i AND b IN ('ASIA', 'ASIA:' || o.i)) OR (b = o.p || ':' || o.i AND a IN ('ASIA', 'ASIA:' || o.i))) THEN 'declared'
       WHEN EXISTS (SELECT 1 FROM l WHERE (a = 'ASIA' AND b = o.p) OR (b = 'ASIA' AND a = o.p)) THEN 'strong' ELSE 'weak' END link
FROM c JOIN c o ON c.p = 'ASIA' AND o.i = c.i AND o.p <> 'ASIA'
"""


def link_tier(spark, d):
    """Every pair of a region and a literal contract under three literal links."""
    r = table(spark, d, "region").select(F.col("r_name").alias("project"))
    ids = spark.createDataFrame([("STANDARD/1",), ("SMALL/2",), ("OTHER",)], "contract_id string")
    links = spark.createDataFrame([("ASIA", "EUROPE"), ("ASIA:STANDARD/1", "AFRICA"), ("AMERICA:SMALL/2", "ASIA:SMALL/2"), ("EUROPE", "ASIA:OTHER")], "produces string, consumes string")
    rows = r.where("project <> 'ASIA'").join(F.broadcast(ids), F.lit(True))
    return workspace.link_tiers(rows, links, "ASIA")


LINK_SQL = """
WITH i(contract_id) AS (VALUES ('STANDARD/1'), ('SMALL/2'), ('OTHER'))
SELECT r_name project, contract_id, CASE WHEN (r_name, contract_id) IN (('AFRICA', 'STANDARD/1'), ('AMERICA', 'SMALL/2'), ('EUROPE', 'OTHER')) THEN 'declared' WHEN r_name = 'EUROPE' THEN 'strong' ELSE 'weak' END link
FROM region, i WHERE r_name <> 'ASIA'
"""


DIFF = """--- a/src/a.rs
+++ b/src/a.rs
@@ -1,2 +1,3 @@ fn a
+x
@@ -9 +10 @@
@@ -20,4 +21,0 @@
--- a/gone.rs
+++ /dev/null
@@ -1,9 +0,0 @@
--- /dev/null
+++ b/new/b.go\t2024-01-01
@@ -0,0 +1,7 @@
+++ plain.py
@@ -3,1 +0,0 @@"""


def diff_parse(spark, d):
    """One literal diff; its files get the names of regions, so that the query has a diff for each."""
    text = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("diff_id"), F.replace(F.lit(DIFF), F.lit("src/"), F.concat("r_name", F.lit("/"))).alias("text"))
    return diff_touches(text.select("diff_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")))


DIFF_SQL = """
WITH t(f, a, b) AS (VALUES ('a.rs', 1, 4), ('a.rs', 10, 11), ('a.rs', 21, 22), ('b.go', 1, 8), ('plain.py', 1, 2))
SELECT r_regionkey diff_id, CASE f WHEN 'a.rs' THEN r_name || '/a.rs' WHEN 'b.go' THEN 'new/b.go' ELSE f END file, a AS "start", b AS "end" FROM region, t
"""


def change_parse(spark, d):
    n = table(spark, d, "nation")
    name = F.col("n_name")
    text = F.element_at(F.array(F.concat(F.lit("rename a::"), name), F.concat(F.lit("rename  x to "), name), F.concat(F.lit("remove variant a::"), name, F.lit("::V")), F.concat(F.lit("remove field "), name, F.lit(".f")), F.concat(F.lit("change signature of "), name), F.concat(F.lit("remove "), name), F.concat(F.lit("drop "), name)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return n.select("n_nationkey", change_target(text).alias("target"))


CHANGE_SQL = """
SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN 'a::' || n_name WHEN 1 THEN 'x' WHEN 2 THEN n_name || '::V' WHEN 6 THEN NULL ELSE n_name END target FROM nation
"""

STATEMENTS = ["SELECT a FROM {t} JOIN other ON x", "INSERT INTO {t}(a) VALUES ('from where')", "update {t} set a = 1", "DELETE FROM s.{t}", "select 1", ""]


def sql_tables_word_rule(spark, d):
    n = table(spark, d, "nation")
    text = F.replace(F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("n_nationkey") % 6 + 1).cast("int")), F.lit("{t}"), F.col("n_name"))
    return n.select("n_nationkey", F.explode(sqltext.word_rule_tables(text)).alias("x")).select("n_nationkey", F.col("x.table").alias("table_name"), F.col("x.role").alias("role"))


WORD_RULE_SQL = """
WITH s AS (SELECT n_nationkey, replace(['SELECT a FROM {t} JOIN other ON x', 'INSERT INTO {t}(a) VALUES (''from where'')', 'update {t} set a = 1', 'DELETE FROM s.{t}', 'select 1', ''][n_nationkey % 6 + 1], '{t}', n_name) q FROM nation),
w AS (SELECT n_nationkey, list_filter(regexp_split_to_array(q, '[^A-Za-z0-9_]+'), lambda x: x <> '') w FROM s),
p AS (SELECT n_nationkey, unnest(w) a, unnest(w[2:] || [NULL]) b FROM w)
SELECT n_nationkey, b table_name, CASE WHEN upper(a) IN ('FROM', 'JOIN') THEN 'reads' ELSE 'writes' END AS "role" FROM p WHERE upper(a) IN ('FROM', 'JOIN', 'INTO', 'UPDATE') AND b IS NOT NULL
"""


def signature_normalise(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.lit("( ctx.Context, "), "p_name", F.lit(".T ) [] pkg. "), "p_brand")
    return p.select("p_partkey", columns.normalised_type(text).alias("signature"))


SIGNATURE_SQL = r"SELECT p_partkey, regexp_replace(regexp_replace('( ctx.Context, ' || p_name || '.T ) [] pkg. ' || p_brand, '\s', '', 'g'), '\w+\.', '', 'g') signature FROM part"


def route_graph(spark, d):
    """Links of pages as routes that they consume."""
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")
    return table(spark, d, "pages").select("page_id", href).select("page_id", F.concat(F.lit("GET "), "href").alias("route")).distinct()


ROUTE_SQL = """SELECT DISTINCT page_id, 'GET ' || h route FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) h FROM pages)"""


def stable_ids(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", columns.stable_id(F.lit("star"), F.concat_ws("::", "p_brand", "p_name"), F.lit("Type"), "|").alias("id"), columns.fingerprint(F.lit("missed"), F.lit("go"), F.concat(F.lit(" A  "), "p_name")).alias("fingerprint"))


IDS_SQL = r"SELECT p_partkey, sha256('star|' || p_brand || '::' || p_name || '|Type') id, substring(sha256('missed|go|' || trim(regexp_replace(lower(' A  ' || p_name), '\s+', ' ', 'g'))), 1, 16) fingerprint FROM part"


def ref_confidence_by_tag(spark, d):
    """Opaque requests are capped at probable; module requests of several hits are probable, of none dropped."""
    nodes = part_symbols(spark, d)
    short = columns.short_name(F.col("qualified_path"))
    opaque = resolve.resolve_names(nodes.select(short.alias("name")).distinct().select("name", F.col("name").alias("asked")), nodes, ["asked"])
    scoped = resolve.in_module(_scoped_requests(nodes).select("module", "name").distinct(), nodes, ["module", "name"])
    a = opaque.select(F.lit("Opaque").alias("tag"), F.least("confidence", F.lit(EXACT - 1)).alias("confidence"))
    return a.unionByName(scoped.select(F.lit("Module").alias("tag"), "confidence")).groupBy("tag", "confidence").agg(F.count(F.lit(1)).alias("n"))


TAG_SQL = f"""
WITH {PARTS}, o AS (SELECT CASE WHEN count(*) OVER (PARTITION BY seg[-1]) > 1 THEN 0 ELSE 1 END c FROM s),
r AS (SELECT DISTINCT seg[1] m, seg[-1] name FROM s),
h AS (SELECT r.*, s.id, CASE WHEN NOT gen AND NOT abs THEN 0 WHEN NOT gen THEN 1 ELSE 2 END ch FROM r JOIN s ON s.seg[-1] = r.name AND contains('::' || array_to_string(s.seg[:-2], '::') || '::', '::' || r.m || '::')),
b AS (SELECT *, min(ch) OVER (PARTITION BY m, name) best FROM h), k AS (SELECT CASE WHEN count(*) OVER (PARTITION BY m, name) > 1 THEN 1 ELSE 2 END c FROM b WHERE ch = best)
SELECT 'Opaque' tag, c confidence, count(*) n FROM o GROUP BY ALL UNION ALL SELECT 'Module', c, count(*) FROM k GROUP BY ALL
"""


QUERIES = {f.__name__: f for f in (resolve_exact, resolve_last_two, resolve_short, bare_name_hint, module_scoped_resolve, default_export_resolve, module_scope_resolve, reexport_closure, contract_synthesis, contract_links, interface_division, package_closure, package_visibility, import_rewrite, owner_longest_prefix, cross_project, link_tier, diff_parse, change_parse, sql_tables_word_rule, signature_normalise, route_graph, stable_ids, ref_confidence_by_tag)}
ORACLES = {
    "resolve_exact": _tier_sql("path"),
    "resolve_last_two": _tier_sql("seg[-2] || '::' || seg[-1]"),
    "resolve_short": _tier_sql("seg[-1]"),
    "bare_name_hint": HINT_SQL,
    "module_scoped_resolve": SCOPED_SQL,
    "default_export_resolve": DEFAULT_SQL,
    "module_scope_resolve": MODULE_SQL,
    "reexport_closure": REEXPORT_SQL,
    "contract_synthesis": SYNTH_SQL,
    "contract_links": CONTRACT_LINK_SQL,
    "interface_division": DIVISION_SQL,
    "package_closure": CLOSURE_SQL,
    "package_visibility": VISIBLE_SQL,
    "import_rewrite": REWRITE_SQL,
    "owner_longest_prefix": OWNER_SQL,
    "cross_project": CROSS_SQL,
    "link_tier": LINK_SQL,
    "diff_parse": DIFF_SQL,
    "change_parse": CHANGE_SQL,
    "sql_tables_word_rule": WORD_RULE_SQL,
    "signature_normalise": SIGNATURE_SQL,
    "route_graph": ROUTE_SQL,
    "stable_ids": IDS_SQL,
    "ref_confidence_by_tag": TAG_SQL,
}
