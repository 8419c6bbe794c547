"""Reports as text and JSON, project folders with their own settings, the command line and the tools."""

from __future__ import annotations

import io
import json

import pytest

from ripplegraph.__main__ import call_tool, parser, run, serve
from ripplegraph.engine import Engine
from ripplegraph.operators import render, usage
from ripplegraph.sources import files as sources

TREE = {
    ".gitignore": "# made by a build\nbuild/\n*.gen.py\n!keep.gen.py\n/only_top.py\n",
    "settings.toml": '[index]\nexclude = ["vendored/**"]\n[detectors.api]\nframeworks = ["flask"]\n',
    "tsconfig.json": '{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["web/*"]}} }',
    "pay/__init__.py": "def charge(x):\n    return x\n",
    "pay/service.py": "from pay import charge\n\n\ndef checkout(cart):\n    return charge(cart)\n\n\ndef refund(cart):\n    return charge(cart)\n",
    "pay/app.py": "from pay.service import checkout, refund\n\n\ndef a():\n    checkout(1)\n\n\ndef b():\n    checkout(2)\n\n\ndef c():\n    refund(1)\n\n\ndef d():\n    refund(2)\n",
    "tests/test_app.py": "from pay.app import a\n\n\ndef test_a():\n    a()\n",
    "build/out.py": "from pay import charge\n\n\ndef out():\n    charge(1)\n",
    "pay/x.gen.py": "def made():\n    pass\n",
    "pay/keep.gen.py": "def kept():\n    pass\n",
    "only_top.py": "def top():\n    pass\n",
    "vendored/v.py": "def v():\n    pass\n",
    ".hidden.py": "def hidden():\n    pass\n",
    "web/tool.ts": "export function tool() { return 1; }\n",
    "web/use.ts": "import { tool } from '@/tool';\nexport function use() { return tool(); }\n",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "pay/latin.py").write_bytes(b"# caf\xe9\ndef f():\n    pass\n")
    (root / "logo.png").write_bytes(bytes(range(256)))
    return root


def command(spark, *words, diff=""):
    out = io.StringIO()
    run(spark, parser().parse_args([str(w) for w in words]), out, lambda: diff)
    return out.getvalue()


@pytest.fixture(scope="module")
def indexed(spark, project):
    return json.loads(command(spark, "index", project, "--config-file", "settings.toml", "--json"))


def test_folder_is_indexed_with_its_own_settings(spark, project, indexed):
    assert (indexed["files_indexed"], indexed["files_unreadable"]) == (7, 1)
    engine = Engine(spark, f"{project}/.ripplegraph", project.name)
    paths = {r.qualified_path for r in engine.store.read("nodes").collect()}
    assert {"pay::charge", "pay::keep.gen::kept"} <= paths
    assert not any(p.rsplit("::", 1)[-1] in ("out", "made", "top", "v", "hidden") for p in paths)
    assert {r.path for r in engine.query_symbol("web::tool::tool")[0].collect()} == {"web::use::use"}
    again = command(spark, "index", project, "--config-file", "settings.toml")
    assert again.startswith("Indexed 0 files (7 unchanged, skipped), 1 unreadable files left out")


def test_text_report_is_ordered(spark, project, indexed):
    text = command(spark, "change", "remove pay::charge", "--project", project, "--explain")
    lines = text.splitlines()
    assert [x for x in lines if not x.startswith(" ")] == list(render.HEADINGS)
    direct = lines[lines.index("DIRECT") + 1 : lines.index("INDIRECT")]
    assert [x.split()[0] for x in direct if " pay::" in x] == ["pay::service::checkout", "pay::service::refund"]
    assert "  pay::service::checkout  pay/service.py:4" in direct
    indirect = lines[lines.index("INDIRECT") + 1 : lines.index("API")]
    named = [x.split()[0] for x in indirect if not x.startswith("    ")]
    assert named == sorted(named) and {"pay::app::a", "tests::test_app::test_a"} <= set(named)
    assert indirect[indirect.index("  tests::test_app::test_a  tests/test_app.py:4") + 1] == "    via pay::service::checkout -> pay::app::a"
    assert lines[lines.index("TESTS") + 1 :][:2] == ["  1 affected tests", "  tests::test_app::test_a  tests/test_app.py:4"]


def test_json_holds_what_the_text_holds(spark, project, indexed):
    report = json.loads(command(spark, "change", "remove pay::charge", "--project", project, "--json"))
    assert list(report) == ["direct", "indirect", "api", "events", "database", "tests", "affected_tests"]
    first = next(d for d in report["direct"] if d["path"] == "pay::service::checkout")
    assert first == {"path": "pay::service::checkout", "file": "pay/service.py", "line": 4, "confidence": "Exact"}
    assert report["tests"] == len(report["affected_tests"]) == 1 and report["api"] == []


def test_summary_groups_by_file_and_counts_the_rest(spark, project, indexed):
    text = command(spark, "change", "remove pay::charge", "--project", project, "--summary")
    summary = json.loads(command(spark, "change", "remove pay::charge", "--project", project, "--summary", "--json"))
    groups = {g["file"]: g for g in summary["indirect_by_file"]}
    assert list(groups) == sorted(groups)
    shown = groups["pay/app.py"]["shown"]
    assert len(shown) == 3 and [d["line"] for d in shown] == sorted(d["line"] for d in shown)
    hidden = groups["pay/app.py"]["count"] - 3
    assert f"    ... {hidden} more" in text.splitlines() and hidden >= 1
    assert f"INDIRECT ({summary['counts']['indirect']} across {len(groups)} files)" in text.splitlines()


def test_workspace_and_diff(spark, project, indexed, tmp_path):
    file = tmp_path / "workspace.toml"
    file.write_text(f'[[projects]]\nid = "shop"\npath = "{project}"\n[[projects]]\nid = "other"\npath = "never-indexed"\n')
    diff = "+++ b/pay/__init__.py\n@@ -1 +1 @@\n"
    report = json.loads(command(spark, "diff", "--project", project, "--workspace", file, "--json", diff=diff))
    assert report["cross_project"] == [] and {"pay::service::checkout"} <= {d["path"] for d in report["direct"]}
    with pytest.raises(KeyError):
        command(spark, "diff", "--project", tmp_path, "--cache-dir", f"{project}/.ripplegraph", "--workspace", file, diff=diff)


def test_cross_project_lines(spark):
    rows = [("web", "ApiRoute", "POST /x", "weak"), ("app", "Event", "Paid", "declared")]
    matches, out = spark.createDataFrame(rows, "project string, contract_kind string, contract_id string, link string"), io.StringIO()
    render.write_text(render.cross_project_lines(matches), out)
    assert out.getvalue() == "  [Declared] app (Event: Paid)\n  [Weak] web (ApiRoute: POST /x)\n"


def test_empty_report(spark):
    rows = spark.createDataFrame([], "bucket string, path string, file string, line int, confidence int, via array<string>, is_test boolean, id string")
    contracts = spark.createDataFrame([], "contract_kind string, contract_id string")
    text, whole = io.StringIO(), io.StringIO()
    render.write_text(render.summary_lines(rows, contracts), text)
    render.write_json(render.json_fields(rows, contracts), whole)
    assert text.getvalue().splitlines() == ["DIRECT (0)", "INDIRECT (0 across 0 files)", "API (0)", "EVENTS (0)", "DATABASE (0)", "TESTS", "  0 affected tests"]
    assert json.loads(whole.getvalue()) == {"direct": [], "indirect": [], "api": [], "events": [], "database": [], "tests": 0, "affected_tests": []}


@pytest.mark.parametrize(
    ("file", "rules", "ignored"),
    [
        ("a/b.py", [("", "b.py")], True),
        ("a/b.py", [("", "/b.py")], False),
        ("a/b.py", [("", "b.py"), ("a", "!b.py")], False),
        ("out/a/b.py", [("", "out/\n!out/a/b.py")], True),
        ("out", [("", "out/")], False),
        ("a/x/y/b.py", [("", "a/**/b.py")], True),
        ("a/b.py", [("c", "b.py")], False),
        ("ab/c.py", [("a", "c.py")], False),
        ("a/#b", [("", "\\#b")], True),
    ],
)
def test_ignore_rules(file, rules, ignored):
    assert sources.is_ignored(file, rules) is ignored


def test_tools_answer_lines(spark, project, indexed, tmp_path):
    log = str(tmp_path / "usage")
    asked = [
        {"id": 1, "method": "initialize", "params": {"clientInfo": {"name": "editor", "version": "2"}}},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "file", "arguments": {"path": "pay/service.py", "project_path": str(project)}}},
        {"id": 4, "method": "tools/call", "params": {"name": "change", "arguments": {"description": "paint it", "project_path": str(project)}}},
        {"id": 5, "method": "nothing"},
    ]
    out = io.StringIO()
    serve(spark, io.StringIO("\n".join(map(json.dumps, asked)) + "\n{\n"), out, log)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, 5, None]
    assert {t["name"] for t in answers[1]["result"]["tools"]} == {"index", "file", "change", "diff"}
    found = json.loads(answers[2]["result"]["content"][0]["text"])
    assert "pay::app::a" in {d["path"] for d in found["direct"]}
    assert "error" in json.loads(answers[3]["result"]["content"][0]["text"])
    assert answers[4]["error"]["code"] == -32601 and answers[5]["error"]["code"] == -32700
    events = spark.read.parquet(log)
    assert {(r.command, r.source, r.client, r.success) for r in events.collect()} == {("file", "mcp", "editor", True), ("change", "mcp", "editor", False)}
    text = command(spark, "--usage-log", log, "gain", "--daily")
    assert text.splitlines()[0].endswith("2 calls, 1 failed") and any("editor" in x and "100.0%" in x for x in text.splitlines())
    assert call_tool(spark, "diff", {}, log, ("x", None)) == {"error": "missing argument: diff, project_path"}


def test_usage_log_can_be_turned_off(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("RIPPLEGRAPH_NO_USAGE", "1")
    usage.record(spark, str(tmp_path / "u"), "index", "cli", "cli", None, 1, True)
    assert not (tmp_path / "u").exists()
