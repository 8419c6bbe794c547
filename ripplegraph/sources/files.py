"""Project files, manifests and configuration."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import language_of

MANIFESTS = r"(^|/)Cargo\.toml$"


@dataclass
class Config:
    """Detector settings; ``parse`` lays a file's values over the defaults."""

    #: The defaults.
    api_frameworks: list[str] = field(default_factory=lambda: ["axum", "net/http", "fastapi", "flask", "express", "fastify"])
    event_strategy: str = "marker_trait"
    event_marker_trait: str = "Event"
    event_naming_suffix: str = "Event"
    database_macros: list[str] = field(default_factory=lambda: ["query", "query_as", "query_scalar"])
    exclude: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Config:
        import tomllib

        t = tomllib.loads(text)
        d, out = t.get("detectors", {}), cls()
        out.api_frameworks = d.get("api", {}).get("frameworks", out.api_frameworks)
        events = d.get("events", {})
        out.event_strategy = events.get("strategy", out.event_strategy)
        out.event_marker_trait = events.get("marker_trait", out.event_marker_trait)
        out.event_naming_suffix = events.get("naming_suffix", events.get("suffix", out.event_naming_suffix))
        out.database_macros = d.get("database", {}).get("macros", out.database_macros)
        out.exclude = t.get("index", {}).get("exclude", out.exclude)
        return out

    def digest(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


def glob_regex(glob: str) -> str:
    """A glob over relative paths as a regular expression: **, *, ?, [..] and {a,b}."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + glob[i : end + 1].replace("[!", "[^"), end
        elif c in "{}":
            out += "(?:" if c == "{" else ")"
        elif c == "," and "{" in glob[:i] and "}" in glob[i:]:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def scan(spark: SparkSession, root: str, project: str) -> DataFrame:
    """(project_id, file, content) of all files under a folder that Spark can read, paths relative and /-separated.

    The content of files that are not UTF-8 is null.  Spark's own listing hides
    names that begin with _ or . ; those that are sources or ignore files are read
    beside it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/"), "^" + re.escape(re.sub("^([a-z0-9]+):/+", r"\1:/", base)) + "/", "")
    rows = raw.select(relative.alias("file"), "content").unionByName(_hidden(spark, base))
    return rows.select(F.lit(project).alias("project_id"), "file", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def _hidden(spark: SparkSession, base: str) -> DataFrame:
    """(file, content) of files below a name that begins with _, and of .gitignore files, outside hidden folders."""
    from pyarrow import fs

    files, top = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", base))
    found = [i.path[len(top) :].strip("/") for i in files.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file]
    wanted = [(f,) for f in found if re.search(r"(^|/)(_|\.gitignore$)", f) and not re.search(r"(^|/)(node_modules|\.[^/]+)/", f)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, folder = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", base))
        for b in batches:
            for f in b["file"]:  # one file a batch, so that a task holds one at a time
                with source.open_input_stream(f"{folder}/{f}") as x:
                    yield pd.DataFrame({"file": [f], "content": [x.read()]})

    return spark.createDataFrame(wanted, "file string").mapInPandas(read, "file string, content binary")


def text_of(files: DataFrame, name: str) -> str | None:
    """The content of one file by its path."""
    row = files.where(F.col("file") == name).select("content").first()
    return row.content if row else None


def pruned(files: DataFrame, config: Config | None = None) -> DataFrame:
    """Files outside dependency folders, not hidden, that no exclude glob matches."""
    out = files.where(~F.col("file").rlike(r"(^|/)(node_modules/|\.[^/]+(/|$))"))
    for glob in config.exclude if config else []:
        out = out.where(~F.col("file").rlike(glob_regex(glob)))
    return out


@functools.lru_cache(maxsize=4096)
def ignore_rules(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern, negated, folders only) for each line of an ignore file, paths against its folder."""
    out = []
    for raw in text.splitlines():
        line = raw if raw.endswith("\\ ") else raw.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        line = line.removeprefix("\\")
        folder, line = line.endswith("/"), line.rstrip("/")
        if line:
            out.append((re.compile(glob_regex(line.lstrip("/") if "/" in line else f"**/{line}")), negated, folder))
    return out


def is_ignored(file: str, sources: list[tuple[str, str]]) -> bool:
    """Whether ignore files (folder, text) leave a file out: a folder that is left out takes all within it."""
    parts = file.split("/")
    nearest = sorted(sources, key=lambda x: -len(x[0]))
    for n in range(1, len(parts) + 1):
        path, within = "/".join(parts[:n]), n < len(parts)
        verdict = None
        for folder, text in nearest:
            if folder and not path.startswith(f"{folder}/"):
                continue
            rest = path[len(folder) + 1 :] if folder else path
            # The last line that matches decides, in the nearest file that has one.
            verdict = next((not negated for regex, negated, only in reversed(ignore_rules(text)) if (within or not only) and regex.match(rest)), None)
            if verdict is not None:
                break
        if verdict:
            return True
    return False


#: Ignore files up to which they are sent to all executors.
FEW_IGNORE_FILES = 1000


def unignored(files: DataFrame) -> DataFrame:
    """Files that no .gitignore of a folder above leaves out.

    Only paths meet the ignore files of their folders; contents aren't moved.
    """
    rules = files.where(F.col("file").rlike(r"(^|/)\.gitignore$") & F.col("content").isNotNull())
    rules = rules.select(F.regexp_replace("file", r"/?\.gitignore$", "").alias("folder"), F.col("content").alias("rules"))
    n = rules.limit(FEW_IGNORE_FILES + 1).count()
    if n == 0:
        return files
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))
    asked = files.select("file", F.explode(above).alias("folder")).join(F.broadcast(rules) if n <= FEW_IGNORE_FILES else rules, "folder")
    held = asked.groupBy("file").agg(F.collect_list(F.struct("folder", "rules")).alias("rules"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [is_ignored(f, [(r["folder"], r["rules"]) for r in rules]) for f, rules in zip(b["file"], b["rules"], strict=True)]
            yield b.loc[out, ["file"]]

    return files.join(held.mapInPandas(work, "file string"), "file", "left_anti")


def routed(files: DataFrame) -> DataFrame:
    """Files that an adapter takes, with their language."""
    return files.withColumn("language", language_of(F.col("file"))).where("language IS NOT NULL")


def is_manifest(file: Column) -> Column:
    return file.rlike(MANIFESTS)


def strip_jsonc(text: str) -> str:
    """JSON without // and /* */ comments and trailing commas; string contents stay."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def path_aliases(tsconfig: str) -> list[tuple[str, str, bool, str, str, bool]]:
    """(prefix, suffix, wildcard, target prefix, target suffix, wildcard): longest literal prefix first, first target only."""
    options = json.loads(strip_jsonc(tsconfig)).get("compilerOptions", {})
    base = options.get("baseUrl", ".").removeprefix("./").strip("/")
    out = []
    for pattern, targets in options.get("paths", {}).items():
        if targets:
            target = "/".join(x for x in (base if base != "." else "", targets[0].removeprefix("./")) if x)
            a, star, b = pattern.partition("*")
            c, star2, e = target.partition("*")
            out.append((a, b, bool(star), c, e, bool(star2)))
    return sorted(out, key=lambda x: -len(x[0]))


def resolve_alias(specifier: str, aliases: list[tuple]) -> str | None:
    for a, b, star, c, e, star2 in aliases:
        if not star and specifier == a:
            return c
        if star and specifier.startswith(a) and specifier.endswith(b) and len(specifier) >= len(a) + len(b):
            return c + (specifier[len(a) : len(specifier) - len(b)] + e if star2 else "")
    return None


def parse_workspace(text: str, base: str = "") -> tuple[list[tuple[str, str, str | None]], list[tuple[str, str]]]:
    """Projects (id, path, index folder or None; paths against the file's folder) and links (produces, consumes)."""
    import posixpath
    import tomllib

    t = tomllib.loads(text)
    under = lambda path: posixpath.normpath(posixpath.join(base, path))
    rows = [(p["id"], under(p["path"]), under(p["cache_dir"]) if "cache_dir" in p else None) for p in t.get("projects", [])]
    return rows, [(x["produces"], x["consumes"]) for x in t.get("links", [])]


def parse_cargo(file: str, text: str) -> dict | None:
    """A package row of a Cargo manifest; None for one without a package."""
    import posixpath
    import tomllib

    t = tomllib.loads(text)
    if "package" not in t:
        return None
    root = posixpath.dirname(file)
    name = t["package"]["name"]
    lib = t.get("lib", {})
    source = posixpath.dirname(lib.get("path", "src/lib.rs"))
    source_root = "/".join(x for x in (root, source) if x)
    deps = []

    def collect(tables: dict, dev: bool) -> None:
        for key, spec in tables.items():
            package = spec.get("package", key) if isinstance(spec, dict) else key
            deps.append({"package": package, "import_name": key.replace("-", "_"), "dev_only": dev})

    for part in (t, *t.get("target", {}).values()):
        collect(part.get("dependencies", {}), False)
        collect(part.get("build-dependencies", {}), False)
        collect(part.get("dev-dependencies", {}), True)
    module = re.sub(r"^src/|^src$", "", source_root).replace("/", "::")
    return {"language": "rust", "root": root, "name": name, "import_name": lib.get("name", name).replace("-", "_"), "module_root": module, "source_root": source_root, "dependencies": deps}
