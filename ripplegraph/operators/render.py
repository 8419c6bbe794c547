"""Reports as ordered lines of text and as JSON.

A report's rows become lines where they lie; writers draw them in order, one
partition at a time, so a report of any size passes through bounded memory.
"""

from __future__ import annotations

import json
import textwrap
from typing import IO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import confidence_name
from . import report

#: What lines are sorted by: section, file group (summaries), place in it, name, part of an entry.
ORDER = ["section", "file", "at", "name", "part"]
#: Headings of the sections in order, and the contract kind that three of them list.
HEADINGS = ("DIRECT", "INDIRECT", "API", "EVENTS", "DATABASE", "TESTS")
LISTED = {"API": "ApiRoute", "EVENTS": "Event", "DATABASE": "Table"}
_HEAD, _GROUP, _LAST = -2, -1, 2**31 - 1


def ordered(dependents: DataFrame) -> DataFrame:
    """Direct dependents first, each bucket by path."""
    return dependents.orderBy("bucket", "path")


def _mark(confidence: Column) -> Column:
    return F.when(confidence == 2, "").otherwise(F.concat(F.lit(" ["), F.lower(confidence_name(confidence)), F.lit("]")))


def _row(section, text, file="", at=0, name="", part=0) -> list[Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    keys = (as_column(section).cast("int"), as_column(file), as_column(at).cast("int"), as_column(name), as_column(part).cast("int"), as_column(text))
    return [c.alias(n) for c, n in zip(keys, [*ORDER, "text"], strict=True)]


def _entries(rows: DataFrame, section) -> DataFrame:
    """A line for each dependent, and one for its chain when it has one."""
    where = F.when(F.col("file") == "", "").otherwise(F.concat(F.lit("  "), "file", F.lit(":"), F.col("line").cast("string")))
    own = F.struct(F.lit(0).alias("part"), F.concat(F.lit("  "), "path", where, _mark(F.col("confidence"))).alias("text"))
    chain = F.struct(F.lit(1).alias("part"), F.concat(F.lit("    via "), F.concat_ws(" -> ", "via")).alias("text"))
    lines = F.explode(F.when(F.size("via") > 0, F.array(own, chain)).otherwise(F.array(own))).alias("l")
    as_column = section if isinstance(section, Column) else F.lit(section)
    drawn = rows.select(as_column.alias("s"), "path", lines)
    return drawn.select(*_row(F.col("s"), F.col("l.text"), name=F.col("path"), part=F.col("l.part")))


def _contracts(contracts: DataFrame) -> DataFrame:
    section = F.element_at(F.create_map(*[F.lit(x) for h, k in LISTED.items() for x in (k, HEADINGS.index(h))]), F.col("contract_kind"))
    return contracts.distinct().withColumn("s", section).where("s IS NOT NULL").select(*_row(F.col("s"), F.concat(F.lit("  "), "contract_id"), name=F.col("contract_id")))


def _tests_line(counts: DataFrame) -> DataFrame:
    return counts.select(*_row(5, F.concat(F.lit("  "), F.col("tests").cast("string"), F.lit(" affected tests")), at=_GROUP))


def text_lines(dependents: DataFrame, contracts: DataFrame) -> DataFrame:
    """(section, file, at, name, part, text): the whole report, to be read in the order of ORDER."""
    heads = dependents.sparkSession.createDataFrame([(i, h) for i, h in enumerate(HEADINGS)], "s int, h string")
    out = heads.select(*_row(F.col("s"), F.col("h"), at=_HEAD))
    out = out.unionByName(_entries(dependents, F.when(F.col("bucket") == "direct", 0).otherwise(1)))
    out = out.unionByName(_contracts(contracts)).unionByName(_tests_line(report.counts(dependents, contracts)))
    return out.unionByName(_entries(report.affected_tests(dependents), 5))


def summary_lines(dependents: DataFrame, contracts: DataFrame, limit: int = report.GROUP_LIMIT) -> DataFrame:
    """Like text_lines: counts in the headings, indirect dependents by file with the first few of each."""
    groups = report.summary_by_file(dependents, limit)
    files = groups.agg(F.count(F.lit(1)).alias("files"))
    counts = report.counts(dependents, contracts).crossJoin(files)  # one row each
    number = {"DIRECT": "direct", "INDIRECT": "indirect", "API": "api", "EVENTS": "events", "DATABASE": "database"}
    across = F.concat(F.lit(" across "), F.col("files").cast("string"), F.when(F.col("files") == 1, " file").otherwise(" files"))
    heads = [F.struct(F.lit(i).alias("s"), F.concat(F.lit(f"{h} ("), F.col(number[h]).cast("string"), across if h == "INDIRECT" else F.lit(""), F.lit(")")).alias("h")) if h in number else F.struct(F.lit(i).alias("s"), F.lit(h).alias("h")) for i, h in enumerate(HEADINGS)]
    out = counts.select(F.explode(F.array(*heads)).alias("x")).select(*_row(F.col("x.s"), F.col("x.h"), at=_HEAD))
    out = out.unionByName(_entries(dependents.where("bucket = 'direct'"), 0))
    own = groups.select(*_row(1, F.concat(F.lit("  "), "file", F.lit(" ("), F.col("count").cast("string"), F.lit(")")), file=F.col("file"), at=_GROUP))
    shown = groups.select("file", F.explode("shown").alias("d"))
    shown = shown.select(*_row(1, F.concat(F.lit("    "), "d.path", F.lit("  (line "), F.col("d.line").cast("string"), F.lit(")"), _mark(F.col("d.confidence"))), file=F.col("file"), at=F.col("d.line"), name=F.col("d.path")))
    hidden = F.col("count") - F.size("shown")
    more = groups.where(hidden > 0).select(*_row(1, F.concat(F.lit("    ... "), hidden.cast("string"), F.lit(" more")), file=F.col("file"), at=_LAST))
    for part in (own, shown, more, _contracts(contracts), _tests_line(counts)):
        out = out.unionByName(part)
    return out


def cross_project_lines(matches: DataFrame) -> DataFrame:
    """(project, contract_kind, contract_id, text) of contracts in other projects, to be read in that order."""
    tier = F.initcap("link")
    text = F.concat(F.lit("  ["), tier, F.lit("] "), "project", F.lit(" ("), "contract_kind", F.lit(": "), "contract_id", F.lit(")"))
    return matches.select("project", "contract_kind", "contract_id", text.alias("text"))


def write_text(lines: DataFrame, out: IO[str]) -> None:
    for r in lines.orderBy(*[c for c in lines.columns if c != "text"]).select("text").toLocalIterator():
        out.write(r.text + "\n")


# ---- JSON ----


def dependent_json() -> Column:
    """A dependent's object; an empty chain is left out."""
    return F.to_json(_dependent(F.col))


def _dependent(c) -> Column:
    fields = (c("path").alias("path"), c("file").alias("file"), c("line").alias("line"), confidence_name(c("confidence")).alias("confidence"))
    return F.struct(*fields, F.when(F.size(c("via")) > 0, c("via")).alias("via"))


def json_fields(dependents: DataFrame, contracts: DataFrame) -> dict[str, DataFrame | int]:
    """A report's fields in order: lists as (json) rows in order, the number of tests."""
    tests = report.affected_tests(dependents)
    of = lambda rows: rows.orderBy("path").select(dependent_json().alias("json"))
    listed = {h.lower(): _ids(contracts, k) for h, k in LISTED.items()}
    return {"direct": of(dependents.where("bucket = 'direct'")), "indirect": of(dependents.where("bucket = 'indirect'")), **listed, "tests": tests.count(), "affected_tests": of(tests)}


def summary_fields(dependents: DataFrame, contracts: DataFrame, limit: int = report.GROUP_LIMIT) -> dict[str, DataFrame | dict]:
    full, groups = json_fields(dependents, contracts), report.summary_by_file(dependents, limit)
    order = ("direct", "indirect", "api", "events", "database", "tests")
    counts = report.counts(dependents, contracts).first().asDict()
    shown = F.transform("shown", lambda d: _dependent(lambda n: F.col("file") if n == "file" else d[n]))
    by_file = groups.orderBy("file").select(F.to_json(F.struct("file", "count", shown.alias("shown"))).alias("json"))
    return {"counts": {k: counts[k] for k in order}, "direct": full["direct"], "indirect_by_file": by_file, **{h.lower(): full[h.lower()] for h in LISTED}}


def cross_project_json(matches: DataFrame) -> DataFrame:
    rows = matches.orderBy("project", "contract_kind", "contract_id")
    return rows.select(F.to_json(F.struct(F.col("project").alias("project_id"), "contract_kind", "contract_id", F.col("link").alias("confidence"))).alias("json"))


def _ids(contracts: DataFrame, kind: str) -> DataFrame:
    ids = contracts.where(F.col("contract_kind") == kind).select("contract_id").distinct().orderBy("contract_id")
    return ids.select(F.col("contract_id").alias("id"))


def write_json(fields: dict, out: IO[str]) -> None:
    """An indented object; lists are written as they are drawn."""
    out.write("{")
    for i, (name, value) in enumerate(fields.items()):
        out.write(f"{',' if i else ''}\n  {json.dumps(name)}: ")
        if isinstance(value, DataFrame):
            empty = True
            out.write("[")
            for r in value.toLocalIterator():
                item = json.loads(r.json) if "json" in value.columns else r.id
                out.write(("\n" if empty else ",\n") + textwrap.indent(json.dumps(item, indent=2, ensure_ascii=False), "    "))
                empty = False
            out.write("]" if empty else "\n  ]")
        else:
            out.write(textwrap.indent(json.dumps(value, indent=2), "  ").lstrip())
    out.write("\n}\n")
