"""Joins that must not grow with the square of a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplegraph.operators import packages, resolve


def test_reexports_of_a_barrel_meet_by_name(spark, monkeypatch):
    """300 names asked of a barrel of 300 names: each meets its own row and the star's, not all 300."""
    plans, real = [], resolve.Grown.append
    monkeypatch.setattr(resolve.Grown, "append", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(self, df))
    names = spark.range(300).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    rows = names.select(F.lit("a::b").alias("barrel"), "name", F.concat(F.lit("o"), "name").alias("origin"), F.lit("c").alias("to_module"))
    more = spark.createDataFrame([("b", "*", None, "d"), ("x::a::b", "n1", None, "e"), ("a::b", "default", "Main", "c")], "barrel string, name string, origin string, to_module string")
    asked = names.select(F.lit("a::b").alias("module"), "name").unionByName(spark.createDataFrame([("b", "n1"), ("b", "default"), ("a::b", "default")], "module string, name string"))
    got = {tuple(r) for r in resolve.reexport_targets(asked, rows.unionByName(more)).collect()}
    # 'b' exactly is preferred to modules that contain it; a default is not among '*'.
    want = {("a::b", f"n{i}", "c", f"on{i}") for i in range(300)} | {("b", "n1", "d", "n1"), ("b", "default", "c", "Main"), ("a::b", "default", "c", "Main")}
    assert got == want
    joins = [line for plan in plans for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any(" OR " in line for line in joins)  # names are a key, not a condition on all rows of a barrel


def test_division_meets_types_by_rare_names(spark):
    """400 interfaces share a name that 400 types have; each has a rare name of its own."""
    ids = spark.range(400).select(F.col("id").cast("string").alias("k"))

    def rows(owner, name, signature="()"):
        return ids.select(F.lit("go").alias("language"), F.concat(F.lit(owner), "k").alias("owner"), name.alias("name"), F.lit(signature).alias("signature"), F.concat_ws("/", F.lit(owner), "k", name, F.lit(signature)).alias("id"))

    common, own = F.lit("common"), F.concat(F.lit("own"), "k")
    specs = rows("I", common).unionByName(rows("I", own)).unionByName(rows("I", own, "(int)").where("owner = 'I7'"))
    more = spark.createDataFrame([("go", "Open", "common", None, "Open/common"), ("go", "One", "own5", "()", "One/own5"), ("go", "None", "absent", "()", "None/absent"), ("rust", "R", "own5", "()", "R/own5")], specs.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    methods = rows("T", common).unionByName(rows("T", own)).unionByName(rows("U", own, "(int)").where("owner = 'U7'")).unionByName(rows("U", common).where("owner = 'U7'"))
    got = {(r.from_id, r.to_id) for r in packages.implementations(specs.unionByName(more), methods).collect()}
    want = {(f"T/{k}/{n}/()", f"I/{k}/{n}/()") for k in range(400) for n in ("common", f"own{k}")}
    assert got == want | {("T/5/own5/()", "One/own5"), ("U/7/own7/(int)", "I/7/own7/(int)"), ("U/7/common/()", "I/7/common/()")}
    named = lambda df, who: df.select("language", F.col("owner").alias(who), "name", "signature")
    assert packages._candidates(named(specs, "interface"), named(methods, "type")).count() <= 402
