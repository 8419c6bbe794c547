"""The change grammar: what a change description seeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class ChangeError(ValueError):
    """A description that is none of the five forms."""


@dataclass(frozen=True)
class Change:
    kind: str
    path: str
    part: str | None = None

    @property
    def target(self) -> str:
        """The path that seeds resolve: a variant with its enum's own name, a field widened to its type."""
        if self.kind == "remove_variant":
            return f"{self.path.rsplit('::', 1)[-1]}::{self.part}"
        return self.path


#: Fixed forms; the words of a description are separated by white space.
FORMS = (
    ("rename", r"^rename (\S+)(?: to \S+)?$"),
    ("remove_variant", r"^remove variant (\S*)::(\S*)$"),
    ("remove_field", r"^remove field (\S*)\.(\S*)$"),
    ("remove", r"^remove (\S+)$"),
    ("signature", r"^change signature of (\S+)$"),
)


def parse_change(text: str) -> Change:
    import re

    words = " ".join(text.split())
    for kind, form in FORMS:
        if m := re.match(form, words):
            return Change(kind, m[1], m[2] if m.lastindex == 2 else None)
    raise ChangeError(f"not a change description: {text!r}")


def change_target(text: Column) -> Column:
    """The target path of each description of a column; null where none of the forms fits."""
    words = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = None
    for kind, form in FORMS:
        first = F.regexp_extract(words, form, 1)
        value = first if kind != "remove_variant" else F.concat(F.element_at(F.split(first, "::"), -1), F.lit("::"), F.regexp_extract(words, form, 2))
        out = F.when(words.rlike(form), value) if out is None else out.when(words.rlike(form), value)
    return out
