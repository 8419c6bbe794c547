"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its trigrams of byte classes (lower case, upper case, digit,
blank, kinds of punctuation, ...), its word lengths and how much of it repeats;
they tell prose from junk in any language.  Term weights are square-root
frequencies times inverse document frequency.  A singular value decomposition of
labelled texts gives the latent space; ``fit`` keeps the labelled vectors there.
``score`` computes the exact cosine of every document with every labelled
vector, block by block, and lets the nearest vote, weighted by similarity.

``fit`` learns from at most ``MOST_LABELLED`` labelled rows, those with the
smallest hash of their id (a bounded random sample), so what is broadcast is at
most MOST_LABELLED x (RANK + 1) + TERMS x (RANK + 1) floats.  Everything else
covers all data: each whole text is scored.

Results: one row for each input row; null and empty texts are scored as empty
texts; repeated rows get equal scores; without labelled rows every score is 0.5.
Ties between equally similar neighbours fall to the smaller position in the
sample, so a score depends on the text alone, but for rounding of the products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, release, stored
from .textbuf import SpanHash, row_slices, text_buffer

MOST_LABELLED, RANK, NEIGHBOURS, SHARPNESS = 4096, 48, 15, 16
LENGTHS, REPEATS = 20, 6
N_CLASSES = 12
TERMS = N_CLASSES**3 + LENGTHS + REPEATS


def _class_table() -> np.ndarray:
    """Byte classes: lower, upper, digit, space, line, stop, cry, bar, symbol, other, high byte, control."""
    out = np.full(256, 9, np.int64)
    out[:32], out[127], out[128:] = 11, 11, 10
    for k, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".,", "!?", "|", "*&$%#@~^_=+<>/\\"]):
        out[[ord(c) for c in chars]] = k
    return out


CLASSES = _class_table()


def term_weights(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square-root relative frequencies of the terms, a row for each text."""
    rows, n = len(offs) - 1, len(buf)
    out = np.zeros((rows, TERMS), np.float32)
    if not n:
        return out
    sizes = np.diff(offs)
    row = np.repeat(np.arange(rows), sizes)
    cls = CLASSES[buf]
    if n >= 3:
        tri = cls[:-2] * N_CLASSES**2 + cls[1:-1] * N_CLASSES + cls[2:]
        inside = row[:-2] == row[2:]
        counts = np.bincount((row[:-2] * N_CLASSES**3 + tri)[inside], minlength=rows * N_CLASSES**3).reshape(rows, -1)
        out[:, : N_CLASSES**3] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    solid = (cls != 3) & (cls != 4)
    edge = np.ones(n, bool)
    edge[1:] = row[1:] != row[:-1]
    starts = np.flatnonzero(solid & (edge | np.concatenate([[True], ~solid[:-1]])))
    ends = np.flatnonzero(solid & np.concatenate([edge[1:] | ~solid[1:], [True]])) + 1
    if len(starts):
        of = row[starts]
        words = np.maximum(np.bincount(of, minlength=rows), 1)
        length = np.minimum(ends - starts, LENGTHS) - 1
        at = N_CLASSES**3
        out[:, at : at + LENGTHS] = np.sqrt(np.bincount(of * LENGTHS + length, minlength=rows * LENGTHS).reshape(rows, -1) / words[:, None])
        h = SpanHash(buf)(starts, ends)
        next_to = np.zeros(len(h), bool)
        next_to[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        pair = h.copy()
        pair[1:] += h[:-1] * np.uint64(0x9E3779B97F4A7C15)
        seen = np.ones(len(h), bool)
        seen[_first(of, pair)] = False
        once = np.ones(len(h), bool)
        once[_first(of, h)] = False
        for k, flag in enumerate((next_to, seen, once)):
            share = np.bincount(of, flag, rows) / words
            out[:, at + LENGTHS + 2 * k] = np.sqrt(share)
            out[:, at + LENGTHS + 2 * k + 1] = np.sqrt(1 - share)
    return out


def _first(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions where a (text, hash) pair comes first."""
    order = np.lexsort((h, of))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    return order[new]


def nearest(sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k greatest values, ties to the smaller position."""
    if k >= sim.shape[1]:
        return np.tile(np.arange(sim.shape[1]), (len(sim), 1))
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sim, near, 1).min(1, keepdims=True)
    for i in np.flatnonzero((sim >= least).sum(1) > k).tolist():
        at = np.flatnonzero(sim[i] >= least[i])
        near[i] = at[np.argsort(-sim[i, at], kind="stable")[:k]]
    return near


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class KnnModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def project(self, weights: np.ndarray) -> np.ndarray:
        return _unit((weights * self.idf) @ self.basis)

    def vote(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Scores of projected texts: exact products with all labelled vectors, in blocks of texts."""
        out = np.full(len(x), 0.5)
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(x) if k else 0, block):
            sim = x[at : at + block] @ self.vectors.T
            near = nearest(sim, k)
            w = np.maximum(np.take_along_axis(sim, near, 1).astype(np.float64), 1e-6) ** SHARPNESS
            out[at : at + block] = np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0, 1)
        return out


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, id_col: str, most: int) -> DataFrame:
    """At most so many rows (id, y), those with the smallest hash of the id; y is the mean label of an id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.avg(label).alias("y"))
    return known.orderBy(F.xxhash64(F.col(id_col).cast("long")), id_col).limit(most)


def labelled_texts(df: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """Stored (row_id, row_text, y): one row for each of at most so many labelled ids; of rows repeated with an id, the smallest text.

    Rows repeated with an id shrink before anything is collected or counted.
    """
    sample = labelled_sample(df, labels, label, id_col, most).withColumnRenamed(id_col, "sample_id")
    # At most `most` narrow rows: a proven bound for the broadcast.
    texts = df.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("row_text")).join(F.broadcast(sample), F.col("row_id") == F.col("sample_id"))
    return stored(texts.groupBy("row_id", "y").agg(F.min("row_text").alias("row_text")).select("row_id", "row_text", "y"), "labelled")


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, rank: int = RANK) -> KnnModel:
    """Learn from the rows of labels (id, label) that have a text in df; the caller leaves out the held-out ones."""
    texts = labelled_texts(df, labels, label, id_col, text_col, most)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column(1))
            for i, j in row_slices(offs):
                x = term_weights(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"row_id": b.column(0).slice(i, j - i).cast(pa.int64()), "y": b.column(2).slice(i, j - i), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = texts.mapInArrow(terms, "row_id long, y double, x binary").collect()
    discard(df.sparkSession, texts)
    release(df.sparkSession)
    return _learnt(rows, rank)


def _learnt(rows: list, rank: int) -> KnnModel:
    """The model of rows (row_id, y, x), which are used up: beside the terms' products the driver holds one matrix of them."""
    rows.sort(key=lambda r: (r.row_id, r.x, r.y))
    y = np.array([r.y for r in rows], np.float64)
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, r in enumerate(rows):
        x[k], rows[k] = np.frombuffer(r.x, np.float16), None
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    x *= idf
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank], dtype=np.float32)
    return KnnModel(idf, basis, _unit(x @ basis), y)


def score(df: DataFrame, model: KnnModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, offs = text_buffer(b.column(1))
            for i, j in row_slices(offs):
                s = m.vote(m.project(term_weights(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])))
                yield pa.RecordBatch.from_pydict({id_col: b.column(0).slice(i, j - i), "score": pa.array(s, pa.float64())})

    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")


def keep(df: DataFrame, model: KnnModel, at_least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose score reaches at_least; nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, offs = text_buffer(b.column(at))
            for i, j in row_slices(offs):
                s = m.vote(m.project(term_weights(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])))
                yield b.slice(i, j - i).filter(pa.array(s >= at_least))

    return df.mapInArrow(work, df.schema)
