"""Secret scans: fixed rules plus sliding-window Shannon entropy.

``scan`` gives the spans of each whole text, as code points, end exclusive,
ordered by start and then by kind in the order of ``KINDS``:

* assign, access, hex: the matches of fixed rules, leftmost and non-overlapping
  for each kind; matches that are too short are dropped after matching.
* entropy: in runs of secret-like characters, windows of ``WINDOW`` characters
  whose Shannon entropy reaches the threshold of the run's character class.
  A window moves by one character with two count updates.  Touching windows
  join to one span.  A window that overlaps an allow-listed string is
  suppressed, as is a run that has no digit or no letter; the rest of a run stays
  in force.  A span that lies inside a rule's span adds nothing and is left out.

Null and empty texts have no spans; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits for each character that a window of the class must reach.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8}
#: Strings that mark the windows they touch as no secret, in lower case.
ALLOWED = ("example", "abcdefghij", "0123456789abcdef", "1234567890", "qwertyuiop", "lorem", "http", "www", "-----")
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("alnum", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


_LISTED = re.compile("(?=(" + "|".join(map(re.escape, sorted(ALLOWED, key=len, reverse=True))) + "))", re.ASCII)


def windows(run: str, threshold: float, free_from: list[int] | None = None) -> list[tuple[int, int]]:
    """Joined windows of the run with at least that entropy; free_from tells for each end where a window may begin."""
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(run):
        if i >= WINDOW:
            old = run[i - WINDOW]
            total -= _CLOGC[counts[old]] - _CLOGC[counts[old] - 1]
            counts[old] -= 1
        n = counts.get(c, 0) + 1
        total += _CLOGC[n] - _CLOGC[n - 1]
        counts[c] = n
        if i >= WINDOW - 1 and math.log2(WINDOW) - total / WINDOW >= threshold - 1e-9:
            start = i - WINDOW + 1
            if free_from and start < free_from[i]:
                continue
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _free_from(run: str) -> list[int] | None:
    """For each place, the least begin of a window up to it that overlaps no allow-listed string."""
    ends = [(m.start(1), m.end(1)) for m in _LISTED.finditer(run.lower())]
    if not ends:
        return None
    out, free = [0] * len(run), 0
    begins = dict(ends)
    last = 0
    for i in range(len(run)):
        # A window that ends at i overlaps a string that begins at or before i.
        if i in begins:
            last = max(last, begins[i])
        free = max(free, last)
        out[i] = free
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if run.isalpha() or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        kind = next(k for k, p in _CLASSES if p.fullmatch(run))
        out += [(m.start() + a, m.start() + b) for a, b in windows(run, THRESHOLDS[kind], _free_from(run))]
    return out


def find(text: str, assign: bool = True, access: bool = True, hexes: bool = True, runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted; the flags tell which kinds the text may hold."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if access:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if runs:
        base = list(out)
        out += [(a, 3, b) for a, b in entropy_spans(text) if not any(x <= a and b <= y for x, _, y in base)]
    return sorted(out)


def _scan_batch(col: pa.Array) -> pa.Array:
    def flags(pattern: str, ignore_case: bool = False) -> list[bool]:
        return pc.fill_null(pc.match_substring_regex(col, pattern, ignore_case=ignore_case), False).to_pylist()

    may = list(zip(flags("passw|secret|token|api_?key", True), flags("AKIA"), flags("[0-9a-f]{24}"), flags("[A-Za-z0-9+/_=-]{20}"), strict=True))
    offsets, kinds, starts, ends = [0], [], [], []
    for text, which in zip(col, may, strict=True):
        if any(which):
            for a, k, b in find(text.as_py(), *which):
                kinds.append(KINDS[k])
                starts.append(a)
                ends.append(b)
        offsets.append(len(kinds))
    items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) for each row of df."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "spans": _scan_batch(b.column(1))})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, spans array<struct<kind: string, start: int, end: int>>")
