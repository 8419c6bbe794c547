"""Random graphs, paths and diffs against short plain versions of the rules."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplegraph.extract import braces, python
from ripplegraph.functions import columns, sqltext
from ripplegraph.functions.changes import ChangeError, parse_change
from ripplegraph.functions.diffs import diff_lines, diff_touches
from ripplegraph.operators import traverse
from ripplegraph.sources import files


def plain_reach(edges, seeds):
    adjacency = {}
    for a, b, c in edges:
        adjacency.setdefault(b, []).append((a, c))
    seen, frontier, out, hop = set(seeds), {s: (2, []) for s in seeds}, {}, 0
    while frontier:
        hop, found = hop + 1, {}
        for at in sorted(frontier):
            conf, chain = frontier[at]
            if conf == 0:
                continue
            for to, c in adjacency.get(at, []):
                if to in seen:
                    continue
                new = (-min(conf, c), at, chain if hop == 1 else [*chain, at])
                found[to] = min(found.get(to, new), new)
        frontier = {n: (-w, chain) for n, (w, _, chain) in found.items()}
        out |= {n: (hop, -w, at, chain) for n, (w, at, chain) in found.items()}
        seen |= set(found)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reach_on_random_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", rng.choice([0, 1, 2, 2])) for _ in range(90)]
    e = spark.createDataFrame([(a, b, "Calls", c) for a, b, c in edges], "from_id string, to_id string, kind string, confidence int")
    nodes = spark.createDataFrame([(f"n{i:02}", f"n{i:02}") for i in range(n)], "id string, qualified_path string")
    got = traverse.reach(nodes, e, spark.createDataFrame([("n00",), ("n01",)], "id string"))
    assert {r.id: (r.hop, r.confidence, r.parent, r.via) for r in got.collect()} == plain_reach(edges, {"n00", "n01"})


def test_segment_runs(spark):
    rng = random.Random(1)
    paths = ["::".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    rows = [(h, "::".join(rng.choice("ab") for _ in range(rng.randrange(1, 3)))) for h in paths]
    df = spark.createDataFrame(rows, "h string, n string").select("h", "n", columns.contains_run(F.col("h"), F.col("n")).alias("x"))
    for r in df.collect():
        h, n = r.h.split("::"), r.n.split("::")
        assert r.x == any(h[i : i + len(n)] == n for i in range(len(h)))


def test_weekly_labels(spark):
    import datetime

    day = datetime.datetime(2019, 12, 25, tzinfo=datetime.UTC)
    stamps = [int((day + datetime.timedelta(days=k)).timestamp()) for k in range(800)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts long").select("ts", columns.period_bucket(F.col("ts"), "weekly").alias("w"))
    for r in df.collect():
        assert r.w == datetime.datetime.fromtimestamp(r.ts, datetime.UTC).strftime("%Y-W%W")


def test_diff_rules(spark):
    text = "+++ b/x.rs\t2024\n@@ -1 +0,0 @@\n@@ -5,2 +7,3 @@ fn\n+++ /dev/null\n@@ -1 +1 @@\n+++ \n@@ -1 +1 @@\n+++ a/y.rs\n@@ bad @@\n@@ -1,1 +4 @@"
    got = {(r.file, r.start, r.end) for r in diff_touches(diff_lines(spark, text)).collect()}
    assert got == {("x.rs", 1, 2), ("x.rs", 7, 10), ("y.rs", 4, 5)}


def test_change_grammar():
    assert parse_change("rename a::b to c").target == "a::b"
    assert parse_change("remove variant a::E::V").target == "E::V"
    assert parse_change("remove field a::T.f").target == "a::T"
    assert parse_change("change  signature of f").target == "f"
    for bad in ("", "rename", "remove variant V", "remove field T", "delete x"):
        with pytest.raises(ChangeError):
            parse_change(bad)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc \"'{}();/*\n#<>=.:!", max_size=200))
def test_extractors_take_any_text(text):
    for f in (braces.rust, braces.script, braces.go, braces.cpp):
        f("src/x.rs", "x", text, {})
    for language in ("kotlin", "swift"):
        braces.plain(language, "a/x", "a::x", text)
    python.extract("x.py", "x", text)


def test_sql_text_rules():
    assert sqltext.quoted_rule_tables("SELECT 'from x' FROM \"a b\".c -- from d\n JOIN `e` /* join f */") == [("a b.c", "reads"), ("e", "reads")]
    assert sqltext.quoted_rule_tables("DELETE FROM t; INSERT INTO u VALUES (1); UPDATE v SET x = 1") == [("t", "writes"), ("u", "writes"), ("v", "writes")]
    assert sqltext.unescape_go(r"a\tb\x41\101é\"") == 'a\tbAAé"'


def test_globs_aliases_and_manifests():
    import re

    for glob, yes, no in (("**/*.rs", ["a.rs", "x/y/a.rs"], ["a.rsx"]), ("gen/**", ["gen/a/b"], ["agen/a"]), ("*.{ts,js}", ["a.ts"], ["b/a.ts"])):
        p = re.compile(files.glob_regex(glob))
        assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)
    aliases = files.path_aliases('{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "x/*"], "@/deep/*": ["d/*"],}}}')
    assert files.resolve_alias("@/deep/a", aliases) == "d/a" and files.resolve_alias("@/b", aliases) == "src/b" and files.resolve_alias("react", aliases) is None
    p = files.parse_cargo("crates/my-lib/Cargo.toml", '[package]\nname = "my-lib"\n[dependencies]\nx-y = "1"\nren = { package = "real" }\n[dev-dependencies]\nd = "1"\n')
    assert (p["import_name"], p["source_root"], p["module_root"]) == ("my_lib", "crates/my-lib/src", "crates::my-lib::src")
    assert p["dependencies"] == [{"package": "x-y", "import_name": "x_y", "dev_only": False}, {"package": "real", "import_name": "ren", "dev_only": False}, {"package": "d", "import_name": "d", "dev_only": True}]
