"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` gives the ids of each whole text, ``decode`` the raw bytes of ids and
``round_trip`` both in one pass.  The tiktoken library does the merges; a text is
only cut where no match of the split pattern can lie across the cut:

* in front of white space that follows a character that is not white space (no
  match has white space after other characters, and none looks back), and
* inside a very long run of white space, which is one match but for its last
  character if other text follows, and is handed to the merges as one piece.

So long texts need bounded memory and never overflow the matcher's stack, and
each match is still merged separately.  Ids are joined in the order of the text.
Null and empty texts have no ids and decode to no bytes.  Repeated rows give
repeated results.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters per call of the library; longer texts are cut at the next safe boundary.
PIECE = 1 << 15
#: The white space of Unicode, which the split pattern's \s means.
SPACE = "\t-\r \x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_RUN = re.compile(f"[{SPACE}]+")


class Codec:
    """The library's encoding of one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.inner = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text, and whether one is a single match."""
        pos, n = 0, len(text)
        while n - pos > PIECE:
            run = _RUN.match(text, pos)
            if run and run.end() - pos > PIECE:
                end = n if run.end() == n else run.end() - 1
                yield text[pos:end], True
            else:
                cut = _CUT.search(text, max(run.end() if run else 0, pos + PIECE))
                end = cut.start() if cut else n
                yield text[pos:end], False
            pos = end
        if pos < n:
            yield text[pos:], False

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= PIECE:
            return self.inner.encode_ordinary(text)
        ids: list[int] = []
        for part, single in self.pieces(text):
            ids += self.inner._encode_single_piece(part) if single else self.inner.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int] | None) -> bytes:
        return self.inner.decode_bytes(ids) if ids else b""


@functools.lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    """One per Python worker and rank file."""
    return Codec(rank_file, pattern)


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    flat = np.fromiter((i for x in rows for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of df."""
    return _run(df, rank_file, pattern, id_col, text_col, decoded=False)


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) for each row of df; decoded comes from the ids alone."""
    return _run(df, rank_file, pattern, id_col, text_col, decoded=True)


def _run(df: DataFrame, rank_file: str, pattern: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                out = {id_col: part.column(0), "ids": _lists(ids)}
                if decoded:
                    out["decoded"] = pa.array([c.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decoded
    return df.select(id_col, text_col).mapInArrow(work, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) from lists of ids; a null list decodes to no bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "decoded": pa.array([c.decode(x) for x in b.column(1).to_pylist()], pa.binary())})

    return df.select(id_col, ids_col).mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded binary")
