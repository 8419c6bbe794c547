"""Token counts through a digest cache.

``DigestCache`` is a table (content, tokenizer, n_tokens): the SHA-256 of a
normalised text, the digest of a tokenizer's file and library version, and the
count.  ``count_tokens`` joins the digests of a batch to the table, encodes one
row for each digest that is missing, appends the counts and joins them back.
Normalisation only turns null into empty text: byte-level vocabularies count
every other difference, so nothing more may be folded.

For a byte-level ``.json`` tokenizer without normalisation the count of a text
is the sum over chunks that begin at white space after other text, since its
split pattern never matches across such a place.  The library therefore encodes
each distinct chunk once and whole texts get sums; chunks are told apart by their
bytes, and at most MOST_KNOWN short ones are remembered between batches.  Other
tokenizers encode whole texts.

Two runs that append to one cache at once may store a digest twice; readers take
one row of each.

Results: one row for each input row, repeated rows and ties included.  Null and
empty texts have 0 bytes and what the library gives for empty text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, stored
from .textbuf import SpanHash, row_slices, same_spans, text_buffer

#: Chunks that a Python worker remembers, and the longest of them in bytes.
MOST_KNOWN, LONGEST_KNOWN = 1 << 19, 64
SCHEMA = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


class TokenCounter:
    """Counts as the library of the file gives them, without added special tokens."""

    def __init__(self, path: str):
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_chunk = False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        inner = Tokenizer.from_file(path)
        inner.no_truncation()
        inner.no_padding()
        self.lengths = lambda texts: [len(x.ids) for x in inner.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_chunk = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not any(set(x["content"]) & set(" \t\r\n") or x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", []))

    def count(self, col: pa.Array) -> np.ndarray:
        buf, offs = text_buffer(col)
        out = np.zeros(len(offs) - 1, np.int64)
        if not self.by_chunk:
            for i, j in row_slices(offs):
                out[i:j] = self.lengths([bytes(buf[offs[k] : offs[k + 1]]).decode() for k in range(i, j)])
            return out
        for i, j in row_slices(offs):
            out[i:j] = self._by_chunk(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        return out

    def _by_chunk(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n, rows = len(buf), len(offs) - 1
        if not n:
            return np.zeros(rows, np.int64)
        starts = chunk_starts(buf, offs)
        ends = np.append(starts[1:], n)
        keys = SpanHash(buf)(starts, ends)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        head = first[back]
        # Chunks that only share a hash with the first one count on their own.
        other = np.flatnonzero((ends - starts != (ends - starts)[head]) | ~same_spans(buf, starts, starts[head], ends - starts))
        chunks = [buf[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        counts = np.array([self.known.get(c, -1) for c in chunks], np.int64)
        missing = np.flatnonzero(counts < 0)
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            counts[part] = self.lengths([chunks[k].decode() for k in part.tolist()])
        if len(self.known) + len(missing) > MOST_KNOWN:
            self.known.clear()
        self.known.update((chunks[k], int(counts[k])) for k in missing.tolist() if len(chunks[k]) <= LONGEST_KNOWN)
        each = counts[back]
        if len(other):
            each[other] = self.lengths([buf[starts[k] : ends[k]].tobytes().decode() for k in other.tolist()])
        row = np.searchsorted(offs, starts, "right") - 1
        return np.bincount(row, each, rows).astype(np.int64)


def chunk_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts begin and where ASCII white space follows a character that surely is none."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    graphic = (buf > 32) & (buf < 127)
    # Two-byte characters from U+00C0 on hold no white space; longer ones are left alone.
    graphic[1:] |= (buf[1:] >= 128) & (buf[1:] < 192) & (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)
    begins = np.zeros(len(buf), bool)
    begins[1:] = space[1:] & graphic[:-1]
    begins[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(begins)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


class DigestCache:
    """Stored counts under a path in a shared folder; a new, empty one by default."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "token-counts")
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.path)

    def counts(self, version: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame, version: str) -> None:
        rows.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(self.path)


def count_tokens(df: DataFrame, tokenizer_file: str, cache: DigestCache, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of df; cache gets the counts that it lacked."""
    version = tokenizer_version(tokenizer_file)
    texts = df.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content_text")).withColumn("tag", F.xxhash64("content_text"))
    rows = stored(texts.select("row_id", "tag", F.unhex(F.sha2("content_text", 256)).alias("content"), F.octet_length("content_text").cast("long").alias("n_bytes")), "contents")
    misses = rows.groupBy("content").agg(F.min(F.struct("row_id", "tag")).alias("rep")).join(cache.counts(version), "content", "left_anti")
    # One row of each missing text goes on, by its id and a hash of the text: neither a text shared by many rows nor an id shared by many texts gathers them.
    reps = misses.select(F.col("rep.row_id").alias("rep_id"), F.col("rep.tag").alias("rep_tag")).distinct().hint("shuffle_hash")
    chosen = texts.join(reps, F.col("row_id").eqNullSafe(F.col("rep_id")) & (F.col("tag") == F.col("rep_tag")), "left_semi").select("content_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_file)
        for b in batches:
            digests = [hashlib.sha256(x.as_buffer() or b"").digest() for x in b.column(0)]
            yield pa.RecordBatch.from_pydict({"content": pa.array(digests, pa.binary()), "n_tokens": pa.array(c.count(b.column(0)))})

    encoded = stored(chosen.mapInArrow(encode, "content binary, n_tokens long"), "encoded").dropDuplicates(["content"])
    cache.append(encoded.join(misses.select("content"), "content", "left_semi"), version)
    return rows.join(cache.counts(version), "content").select(F.col("row_id").alias(id_col), "n_bytes", "n_tokens")
