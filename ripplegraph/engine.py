"""The engine's interface: index a project, then ask what a change reaches."""

from __future__ import annotations

import time
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import run as extract
from .functions.changes import parse_change
from .functions.diffs import diff_lines, diff_touches
from .operators import contracts, link, render, report, resolve, traverse, usage, workspace
from .schema import EDGES, struct
from .sources import files as sources
from .sources import store as st
from .sources.shared import stored


#: Where a project's index lies when no other folder is named.
INDEX_FOLDER = ".ripplegraph"


class UnresolvedError(LookupError):
    """A change whose target names no symbol; carries paths that its last segment could mean."""

    def __init__(self, path: str, hint: list[str]):
        super().__init__(f"no symbol matches {path!r}" + (f"; did you mean {', '.join(hint)}?" if hint else ""))
        self.hint = hint


class Engine:
    """One project's index under a path that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, project: str, config: sources.Config | None = None, aliases: list | None = None):
        self.spark, self.project = spark, project
        self.config, self.aliases = config or sources.Config(), aliases or []
        self.store = st.Store(spark, path)

    @classmethod
    def over(cls, files: DataFrame, path: str, project: str, config_file: str | None = None) -> Engine:
        """An engine with the settings among the project's files: a TOML file by its name, and tsconfig.json's aliases."""
        text = sources.text_of(files, config_file) if config_file else None
        found = sources.text_of(files, "tsconfig.json")
        return cls(files.sparkSession, path, project, sources.Config.parse(text) if text else None, sources.path_aliases(found) if found else None)

    # ---- indexing ----

    def index_folder(self, root: str, force: bool = False) -> dict:
        return self.index(sources.scan(self.spark, root, self.project), force)

    def index(self, files: DataFrame, force: bool = False) -> dict:
        """Index (file, content) rows; unchanged files are not parsed again.  Gives counters and lost events.

        Hidden, ignored and excluded files are left out; files whose content is
        null (not UTF-8) are counted as unreadable.
        """
        start = time.monotonic()
        if force:
            self.store.clear()
        digest = f"{self.config.digest()} {self.aliases}"
        old = {t: self.store.read_or_empty(t, digest) for t in st.TABLES}
        before = report.event_wiring(old["nodes"], old["edges"])
        wanted = sources.pruned(sources.unignored(files), self.config)
        unreadable = sources.routed(wanted).where("content IS NULL").count()
        kept = wanted.where("content IS NOT NULL")
        seen = stored(st.hashed(sources.routed(kept)), "seen")
        new, gone = st.changed(seen, old["files"]), st.deleted(old["files"], seen)
        rows = stored(extract.extracted(new, self.config, self.aliases), "extracted")
        dropped = stored(new.select("file").unionByName(gone.select("file")), "dropped")
        declared = st.replaced(old["nodes"].where("file <> ''"), extract.nodes_of(rows, self.project), dropped)
        refs = stored(st.replaced(old["refs"], extract.refs_of(rows), dropped), "refs")
        crefs = stored(st.replaced(old["contract_refs"], extract.contract_refs_of(rows), dropped), "contract-refs")
        nodes = stored(st.upserted(declared), "declared")
        nodes = stored(nodes.unionByName(contracts.synthesised(crefs, nodes, self.project)), "nodes")
        pk = extract.packages_of(kept)
        edges = stored(link.link(nodes, refs, crefs, pk).select("from_id", "to_id", "kind", F.col("confidence").cast("int").alias("confidence")), "edges")
        self.store.write({"files": seen.select("file", "content_hash"), "nodes": nodes, "refs": refs, "contract_refs": crefs, "edges": edges, "packages": pk}, digest)
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.filter("symbols", lambda s: s["kind"] != "Module"))), F.lit(0)).alias("s")).first()
        lost = report.event_losses(before, report.event_wiring(nodes, edges)).orderBy("event").collect()
        return {
            "files_indexed": counts.n, "files_skipped": seen.count() - counts.n, "files_pruned": gone.count(), "files_unreadable": unreadable, "symbols_indexed": counts.s, "edges": edges.count(),
            "lost_events": [r.asDict() for r in lost], "duration_ms": int((time.monotonic() - start) * 1000),
        }

    # ---- queries ----

    def _report(self, seeds: DataFrame, min_confidence: int = 0, explain: bool = True) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.store.read("nodes"), self.store.read("edges")
        seeds = stored(seeds.distinct(), "seeds")
        reached = traverse.reach(nodes, edges, seeds)
        rows = render.ordered(report.filter_confidence(traverse.dependents(nodes, reached), min_confidence))
        touched = traverse.contracts_touched(nodes, edges, seeds.select("id").unionByName(reached.select("id")))
        return (rows if explain else report.without_chains(rows)), touched

    def query_file(self, file: str, **options) -> tuple[DataFrame, DataFrame]:
        """(dependents, contracts) of a file's symbols; dependents in a report's order."""
        return self._report(traverse.file_seeds(self.store.read("nodes"), file), **options)

    def query_symbol(self, path: str, **options) -> tuple[DataFrame, DataFrame]:
        nodes = self.store.read("nodes")
        hits = stored(resolve.resolve_names(self.spark.createDataFrame([(0, path)], "request int, name string"), nodes, ["request"]), "hits")
        if hits.isEmpty():
            raise UnresolvedError(path, resolve.bare_name_hint(path, nodes).first().hint)
        return self._report(hits.select("id"), **options)

    def change(self, text: str, **options) -> tuple[DataFrame, DataFrame]:
        """What a change description reaches, e.g. 'remove variant a::E::V'."""
        return self.query_symbol(parse_change(text).target, **options)

    def diff(self, text: str, **options) -> tuple[DataFrame, DataFrame]:
        """What the new side of a unified diff reaches."""
        return self._report(traverse.diff_seeds(self.store.read("nodes"), diff_touches(diff_lines(self.spark, text))), **options)

    @staticmethod
    def summarize(dependents: DataFrame, limit: int = report.GROUP_LIMIT) -> DataFrame:
        """Indirect dependents by file, in the order of files."""
        return report.summary_by_file(dependents, limit).orderBy("file")

    @staticmethod
    def write(found: tuple[DataFrame, DataFrame], out: IO[str], summary: bool = False, as_json: bool = False, cross: DataFrame | None = None) -> None:
        """A report as text or JSON, whole or as a summary, with contracts of other projects when given."""
        rows, touched = stored(found[0], "dependents"), stored(found[1], "touched")
        if as_json:
            fields = render.summary_fields(rows, touched) if summary else render.json_fields(rows, touched)
            render.write_json(fields | ({} if cross is None else {"cross_project": render.cross_project_json(cross)}), out)
            return
        render.write_text(render.summary_lines(rows, touched) if summary else render.text_lines(rows, touched), out)
        if cross is not None:
            out.write("CROSS-PROJECT\n")
            render.write_text(render.cross_project_lines(cross), out)

    @staticmethod
    def affected_tests(dependents: DataFrame) -> DataFrame:
        return report.affected_tests(dependents)

    @staticmethod
    def cross_project(touched: DataFrame, projects: dict[str, Engine], links: DataFrame, source: str) -> DataFrame:
        """Touched contracts in other indexed projects; projects without an index are skipped."""
        all_nodes = None
        for name, engine in projects.items():
            try:
                nodes = engine.store.read("nodes").withColumn("project", F.lit(name))
            except st.NotIndexedError:
                continue
            all_nodes = nodes if all_nodes is None else all_nodes.unionByName(nodes)
        if source not in projects:
            raise KeyError(f"{source} is not a project of the workspace")
        return workspace.cross_project(touched, all_nodes, links, source).orderBy("project", "contract_kind", "contract_id")

    def workspace_matches(self, touched: DataFrame, text: str, base: str, here: str) -> DataFrame:
        """Touched contracts in the other projects of a workspace file's text; this project is the one at ``here``."""
        projects, links = sources.parse_workspace(text, base)
        source = next((p for p, path, _ in projects if path == here), None)
        if source is None:
            raise KeyError(f"{here} is not a project of the workspace")
        engines = {p: self if p == source else Engine(self.spark, index or f"{path}/{INDEX_FOLDER}", p) for p, path, index in projects}
        return self.cross_project(touched, engines, self.spark.createDataFrame(links, "produces string, consumes string"), source)

    @staticmethod
    def gain(events: DataFrame, period: str = "daily") -> DataFrame:
        return usage.rollup(events, period)


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], struct(EDGES))
