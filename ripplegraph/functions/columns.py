"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(project: Column, path: Column, kind: Column, separator: str = "\x00") -> Column:
    """Id of a node: project, path and kind, not the file."""
    return F.sha2(F.concat_ws(separator, project, path, kind), 256)


def segments(path: Column) -> Column:
    return F.split(path, "::")


def short_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def last_two(path: Column) -> Column:
    """The last two segments; null when there are fewer."""
    seg = segments(path)
    return F.when(F.size(seg) >= 2, F.array_join(F.slice(seg, -2, 2), "::"))


def parent_path(path: Column) -> Column:
    seg = segments(path)
    return F.array_join(F.slice(seg, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0))), "::")


def contains_run(haystack: Column, needle: Column) -> Column:
    """Whether the needle's segments are neighbours, in order, in the haystack."""
    return F.concat(F.lit("::"), haystack, F.lit("::")).contains(F.concat(F.lit("::"), needle, F.lit("::")))


def starts_with_run(path: Column, prefix: Column) -> Column:
    return F.concat(path, F.lit("::")).startswith(F.concat(prefix, F.lit("::")))


def is_under(file: Column, root: Column) -> Column:
    """Directory containment; the empty root holds all files."""
    return (root == "") | file.startswith(F.concat(root, F.lit("/")))


def weaker(a: Column, b: Column) -> Column:
    return F.least(a, b)


def confidence_name(c: Column) -> Column:
    return F.element_at(F.array(F.lit("Heuristic"), F.lit("Probable"), F.lit("Exact")), c.cast("int") + 1)


def language_of(file: Column) -> Column:
    """The first adapter whose extensions match; null for files of no adapter."""
    out = F.when(file.endswith(".rs"), "rust")
    for name, extensions in ADAPTER_EXTENSIONS[1:]:
        out = out.when(file.rlike("\\.(" + "|".join(extensions) + ")$"), name)
    return out


#: File extensions of each adapter, in order of registration.
ADAPTER_EXTENSIONS = (
    ("rust", ("rs",)),
    ("typescript", ("ts", "tsx", "jsx", "js", "mjs")),
    ("python", ("py",)),
    ("go", ("go",)),
    ("kotlin", ("kt",)),
    ("swift", ("swift",)),
    ("cpp", ("cpp", "cc", "cxx", "c", "h", "hpp", "hh", "hxx")),
)


def module_path(file: Column, language: Column) -> Column:
    """Module path of a file: no extension, segments joined by ::, languages' own rules on src/ and root files."""
    bare = F.regexp_replace(file, "\\.[^./]*$", "")
    bare = F.when(language.isin("rust", "typescript", "python", "kotlin"), F.regexp_replace(bare, "^src/", "")).otherwise(bare)
    joined = F.replace(bare, F.lit("/"), F.lit("::"))
    joined = F.when(language == "rust", F.regexp_replace(joined, "(^|::)(lib|main|mod)$", "")).otherwise(joined)
    return F.when(language == "python", F.regexp_replace(joined, "(^|::)__init__$", "")).otherwise(joined)


def normalised_type(text: Column) -> Column:
    """A type without white space and package qualifiers (letters and digits of any script)."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)\\s", ""), "(?U)\\w+\\.", "")


def period_bucket(ts: Column, period: str) -> Column:
    """UTC label of unix seconds: daily, weekly (Monday first, week 00 possible) or monthly."""
    when = F.timestamp_seconds(ts)
    if period == "daily":
        return F.date_format(when, "yyyy-MM-dd")
    if period == "monthly":
        return F.date_format(when, "yyyy-MM")
    if period != "weekly":
        raise ValueError(f"unknown period: {period}")
    week = F.floor((F.dayofyear(when) + 6 - F.weekday(when)) / 7)
    return F.concat(F.year(when).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def block_title(text: Column) -> Column:
    """A test block's title as one path segment."""
    return F.replace(text, F.lit("::"), F.lit(":"))


def starts_uppercase(text: Column) -> Column:
    return text.rlike("^\\p{Lu}")


def grouped(n: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n, 0)


def percent_bar(part: Column, whole: Column, width: int = 20) -> Column:
    filled = F.when(whole > 0, F.round(part / whole * width)).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled))


def fingerprint(kind: Column, language: Column, title: Column) -> Column:
    """16 hex digits that ignore case and white space runs of the title."""
    return F.substring(F.sha2(F.concat_ws("|", kind, language, F.trim(F.regexp_replace(F.lower(title), "\\s+", " "))), 256), 1, 16)
