"""Command line: index a project, then ask what a file, a change or a diff reaches.

``python -m ripplegraph serve`` answers the same as tools over JSON-RPC lines.
"""

from __future__ import annotations

import argparse
import io
import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path
from typing import IO

from pyspark.sql import SparkSession

from .engine import INDEX_FOLDER, Engine, UnresolvedError
from .functions.changes import ChangeError
from .operators import usage
from .schema import CONFIDENCE_NAMES, struct
from .sources import files as sources
from .sources.ship import ship_package
from .sources.store import NotIndexedError

#: Errors that are the caller's: told in one line, with exit code 1.
TOLD = (ChangeError, UnresolvedError, NotIndexedError, KeyError, OSError, ValueError)
TIERS = [n.lower() for n in CONFIDENCE_NAMES]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ripplegraph", description="What else is reached if this changes?")
    top.add_argument("--usage-log", default=str(Path.home() / INDEX_FOLDER / "usage"), help="folder of the usage log")
    sub = top.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="index a project")
    index.add_argument("path")
    index.add_argument("--force", action="store_true", help="forget the index first")
    index.add_argument("--config-file", help="the project's settings (TOML), as a path within it")
    asked = {"query": ("path", "what depends on a file"), "change": ("description", "what a described change reaches"), "diff": (None, "what a unified diff reaches")}
    for name, (argument, text) in asked.items():
        p = sub.add_parser(name, help=text)
        if argument:
            p.add_argument(argument)
        else:
            p.add_argument("--file", help="read the diff from here, not from standard input")
        p.add_argument("--project", default=".")
        p.add_argument("--workspace", help="a workspace file; also report other projects' contracts")
        p.add_argument("--min-confidence", choices=TIERS, default=TIERS[0])
        p.add_argument("--explain", action="store_true", help="show each chain")
        p.add_argument("--summary", action="store_true", help="counts, and indirect dependents by file")
    for name in ("index", *asked):
        sub.choices[name].add_argument("--cache-dir", help=f"the index's folder (<project>/{INDEX_FOLDER})")
    gain = sub.add_parser("gain", help="recorded usage")
    period = gain.add_mutually_exclusive_group()
    for name in ("daily", "weekly", "monthly"):
        period.add_argument(f"--{name}", dest="period", action="store_const", const=name)
    gain.set_defaults(period="monthly")
    for name in ("index", *asked, "gain"):
        sub.choices[name].add_argument("--json", action="store_true")
    sub.add_parser("serve", help="answer JSON-RPC lines on standard input")
    return top


def _root(path: str) -> str:
    return os.path.realpath(path)


def run(spark: SparkSession, args: argparse.Namespace, out: IO[str], diff: Callable[[], str] = sys.stdin.read) -> None:
    """One command; its report goes to ``out``."""
    if args.command == "index":
        root = _root(args.path)
        files = sources.scan(spark, root, os.path.basename(root))
        engine = Engine.over(files, args.cache_dir or f"{root}/{INDEX_FOLDER}", os.path.basename(root), args.config_file)
        _write_index(engine.index(files, args.force), args.json, out)
    elif args.command == "gain":
        _write_gain(spark, args, out)
    else:
        root = _root(args.project)
        engine = Engine(spark, args.cache_dir or f"{root}/{INDEX_FOLDER}", os.path.basename(root))
        options = {"min_confidence": TIERS.index(args.min_confidence), "explain": args.explain}
        if args.command == "query":
            file = os.path.relpath(os.path.join(root, args.path), root)
            found = engine.query_file(file.replace(os.sep, "/"), **options)
        elif args.command == "change":
            found = engine.change(args.description, **options)
        else:
            found = engine.diff(Path(args.file).read_text() if args.file else diff(), **options)
        cross = None
        if args.workspace:
            file = Path(_root(args.workspace))
            cross = engine.workspace_matches(found[1], file.read_text(), str(file.parent), root)
        Engine.write(found, out, args.summary, args.json, cross)


def _write_index(stats: dict, as_json: bool, out: IO[str]) -> None:
    if as_json:
        out.write(json.dumps(stats, indent=2) + "\n")
        return
    gone = f", {stats['files_pruned']} deleted files pruned" if stats["files_pruned"] else ""
    bad = f", {stats['files_unreadable']} unreadable files left out" if stats["files_unreadable"] else ""
    out.write(f"Indexed {stats['files_indexed']} files ({stats['files_skipped']} unchanged, skipped){gone}{bad}, {stats['symbols_indexed']} symbols, in {stats['duration_ms']}ms\n")
    for e in stats["lost_events"]:
        sides = " and ".join(s for s in ("producer", "consumer") if e[f"lost_{s}"])
        out.write(f"  warning: event {e['event']} lost its last {sides}\n")


def _write_gain(spark: SparkSession, args: argparse.Namespace, out: IO[str]) -> None:
    if not os.path.isdir(args.usage_log):
        out.write("[]\n" if args.json else "no usage recorded yet\n")
        return
    events = spark.read.schema(struct(usage.EVENTS)).parquet(args.usage_log)
    if args.json:
        out.write(json.dumps([r.asDict() for r in usage.rollup(events, args.period).collect()], indent=2) + "\n")  # 12 buckets at most
        return
    for r in usage.ordered(usage.lines(events, args.period)).toLocalIterator():
        out.write(r.text + "\n")


def _recorded(spark: SparkSession, args: argparse.Namespace, source: str, client: str, version: str | None, work: Callable[[], None]) -> None:
    """Run a command and note it in the usage log; a log that cannot be written never fails the command."""
    start, fine = time.monotonic(), False
    try:
        work()
        fine = True
    finally:
        if args.command != "gain":
            try:
                usage.record(spark, args.usage_log, "file" if args.command == "query" else args.command, source, client, version, int((time.monotonic() - start) * 1000), fine)
            except Exception as e:
                print(f"ripplegraph: usage was not recorded: {e}", file=sys.stderr)


# ---- tools over JSON-RPC lines ----

#: Tools: their command, and the arguments that stand for its own (all are strings but for the flags).
TOOLS = {
    "index": {"project_path": "path"},
    "file": {"path": "path", "project_path": "--project"},
    "change": {"description": "description", "project_path": "--project"},
    "diff": {"diff": None, "project_path": "--project"},
}
OPTIONS = {"cache_dir": "--cache-dir", "workspace_path": "--workspace", "min_confidence": "--min-confidence", "config_file": "--config-file"}
FLAGS = {"force": "--force", "explain": "--explain", "summary": "--summary"}


def _takes(tool: str) -> dict[str, dict]:
    own = {n: {"type": "string"} for n in TOOLS[tool]} | {"cache_dir": {"type": "string"}}
    if tool == "index":
        return own | {"config_file": {"type": "string"}, "force": {"type": "boolean"}}
    tier = {"type": "string", "enum": TIERS[::-1]}
    return own | {"workspace_path": {"type": "string"}, "min_confidence": tier, "explain": {"type": "boolean"}, "summary": {"type": "boolean"}}


def tool_list() -> list[dict]:
    texts = {"index": "Index a project, or index it again.", "file": "What depends on a file.", "change": "What a described change reaches.", "diff": "What a unified diff reaches."}
    return [{"name": t, "description": texts[t], "inputSchema": {"type": "object", "properties": _takes(t), "required": list(TOOLS[t])}} for t in TOOLS]


def call_tool(spark: SparkSession, tool: str, given: dict, log: str, client: tuple[str, str | None]) -> dict:
    """A tool's result object; an error is an object with ``error``."""
    if tool not in TOOLS:
        return {"error": f"Unknown tool: {tool}"}
    missing = [n for n in TOOLS[tool] if n not in given]
    if missing:
        return {"error": f"missing argument: {', '.join(missing)}"}
    words = ["--usage-log", log, "query" if tool == "file" else tool, "--json"]
    allowed = _takes(tool)
    for name, word in {**TOOLS[tool], **OPTIONS}.items():
        if word and word.startswith("--") and name in given and name in allowed:
            words.append(f"{word}={given[name]}")
    words += [word for name, word in FLAGS.items() if given.get(name) and name in allowed]
    words += ["--", *(str(given[n]) for n, word in TOOLS[tool].items() if word and not word.startswith("--"))]
    out = io.StringIO()
    try:
        args = parser().parse_args(words)
        _recorded(spark, args, "mcp", *client, lambda: run(spark, args, out, lambda: given["diff"]))
    except SystemExit:
        return {"error": "bad arguments"}
    except TOLD as e:
        return {"error": str(e)}
    return json.loads(out.getvalue())


def serve(spark: SparkSession, lines: IO[str], out: IO[str], log: str) -> None:
    """Answer requests, one JSON object a line, until the input ends."""
    client: tuple[str, str | None] = ("unknown", None)
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except json.JSONDecodeError:
            out.write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}) + "\n")
            continue
        method, params = request.get("method", ""), request.get("params") or {}
        if method == "notifications/initialized":
            continue
        answer = {"jsonrpc": "2.0", "id": request.get("id")}
        if method == "initialize":
            info = params.get("clientInfo") or {}
            client = (info.get("name") or "unknown", info.get("version"))
            answer["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "ripplegraph", "version": "0.1.0"}}
        elif method == "tools/list":
            answer["result"] = {"tools": tool_list()}
        elif method == "tools/call":
            result = call_tool(spark, params.get("name", ""), params.get("arguments") or {}, log, client)
            answer["result"] = {"content": [{"type": "text", "text": json.dumps(result, indent=2)}]}
        else:
            answer["error"] = {"code": -32601, "message": f"Unknown method: {method}"}
        out.write(json.dumps(answer) + "\n")
        out.flush()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("ripplegraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship_package(spark)
    if args.command == "serve":
        serve(spark, sys.stdin, sys.stdout, args.usage_log)
        return 0
    try:
        _recorded(spark, args, "cli", os.environ.get("RIPPLEGRAPH_CLIENT", "cli"), None, lambda: run(spark, args, sys.stdout))
    except TOLD as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
