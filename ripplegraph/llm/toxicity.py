"""Toxicity: noisy-channel deobfuscation, then a classifier on the restored text.

Channel: writers hide letters as look-alike signs (``LOOKALIKES``), by spacing
a word out, and by repeating letters.  Each token that shows such a trace opens
a character lattice; the Viterbi path under a character trigram model and the
channel's costs restores it.  Tokens without a trace have one path only, so they
stay as they are.  The trigram model counts every whole text of the corpus.

Classifier: logistic regression on the words of the restored text and their
beginnings.  It learns from at most ``MOST_LABELLED`` labelled rows (those with
the smallest hash of the id, one row for each id) and uses as its vocabulary the
``MOST_FEATURES`` features that lean furthest to one label, of those in at least
``LEAST_ROWS`` labelled texts, which bounds what is collected and broadcast.
Everything else covers all data.

Results: one row for each input row; null and empty texts are scored as empty
texts; repeated rows get equal scores; without labelled rows of both classes
every score is the share of label 1 (0.5 when there are none).
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_knn import _first, labelled_texts
from .shared import discard
from .textbuf import SpanHash, mix, row_slices, text_buffer

MOST_LABELLED, MOST_FEATURES, LEAST_ROWS = 12_000, 1_000, 4
#: Signs and the letters that they stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Costs in nats: of a look-alike, of leaving a sign as it is, of dropping a separator, of keeping one, of a repeated letter.
LOOK_COST, KEEP_COST, JOIN_COST, SPLIT_COST, REPEAT_COST = 1.0, 6.0, 0.5, 2.0, 0.7
#: Places of a token after which the best path so far is settled; tokens up to CACHED are remembered.
SETTLE, CACHED = 256, 64
LETTERS = 28
_SIGNS = re.escape("".join(LOOKALIKES))
SPACED = r"(?<![^\s])[^\s][ ._*\-](?:[^\s][ ._*\-])+[^\s](?![^\s])"
_L, _S = r"[^\W\d_]", f"[{_SIGNS}]"
#: A spaced-out word, or from the beginning of a word: signs between letters, signs in front, a letter three times or more; then signs other than punctuation may end it.
_TRACE = re.compile(rf"{SPACED}|(?<![^\W_])(?:{_L}++{_S}+(?={_L})|(?<!\S){_S}+(?={_L})|{_L}*?({_L})\1\1+)(?:{_L}|{_S}+(?={_L}))*+(?:[$@€0134578]+(?![$@€\w]))?")
_MAY = rf"(?:^|\s)\S[ ._*\-]\S[ ._*\-]\S|\pL[{_SIGNS}]+\pL|(?:^|\s)[{_SIGNS}]+\pL|" + "|".join(f"(?i:{c * 3})" for c in "abcdefghijklmnopqrstuvwxyz")


def _letter_table() -> np.ndarray:
    """0: a boundary, 1 to 26: a to z in either case, 27: bytes of other letters."""
    out = np.zeros(256, np.int64)
    for k in range(26):
        out[[65 + k, 97 + k]] = k + 1
    out[128:] = 27
    return out


LETTER = _letter_table()


def _code(c: str) -> int:
    return int(LETTER[ord(c)]) if ord(c) < 128 else 27


def letter_trigrams(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all whole texts: LETTERS**3 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for b in batches:
            buf, offs = text_buffer(b.column(0))
            for i, j in row_slices(offs):
                # Every text begins and ends at two boundaries.
                sizes = np.diff(offs[i : j + 1])
                x = np.zeros(int(sizes.sum()) + 2 * (j - i) + 2, np.int64)
                at = np.arange(offs[i], offs[j]) - offs[i] + np.repeat(2 * np.arange(1, j - i + 1), sizes)
                x[at] = LETTER[buf[offs[i] : offs[j]]]
                total += np.bincount((x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:], minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at), "n": pa.array(total[at])})

    rows = df.select(text_col).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LETTERS**3, np.int64)
    for r in rows:
        out[r.code] = r.n
    return out


class Channel:
    """Viterbi decoding of character lattices under a trigram model."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
        two = (c.sum(0) + 0.5) / (c.sum(0).sum(-1, keepdims=True) + 0.5 * LETTERS)
        self.cost = -np.log((c + 5 * two[None]) / (c.sum(-1, keepdims=True) + 5)).astype(np.float64)
        self.cost = self.cost.tolist()
        self.restored = functools.lru_cache(maxsize=1 << 16)(self._restored)

    def lattice(self, token: str) -> list[list[tuple[int, str, float]]]:
        """For each place of the token the edges (places to go on, letters, cost); none inside a run, which is one edge."""
        spaced = re.fullmatch(SPACED, token) is not None
        edges: list[list[tuple[int, str, float]]] = []
        i, n = 0, len(token)
        while i < n:
            c, run = token[i], 1
            if spaced and i % 2:
                edges.append([(1, "", JOIN_COST), (1, c, SPLIT_COST)])
                i += 1
                continue
            while not spaced and i + run < n and token[i + run] == c:
                run += 1
            if c.isalpha():
                if run < 3:
                    edges += [[(1, c, 0.0)]] * run
                else:
                    edges += [[(run, c, REPEAT_COST), (run, c + c, REPEAT_COST)]] + [[]] * (run - 1)
            else:
                out = [(run, x, LOOK_COST) for x in LOOKALIKES.get(c, "")]
                out += [(run, x + x, LOOK_COST) for x in LOOKALIKES.get(c, "") if run > 1]
                edges += [[*out, (run, c * run, KEEP_COST)]] + [[]] * (run - 1)
            i += run
        return edges

    def _restored(self, token: str) -> str:
        edges, n, cost = self.lattice(token), len(token), self.cost
        # Each place's states; a path is (cost, text of this stretch), settled stretches are in done.
        best: dict[int, dict[tuple[int, int], tuple[float, str]]] = {0: {(0, 0): (0.0, "")}}
        done: list[str] = []
        settle = SETTLE
        for i in range(n):
            states = best.pop(i, None)
            if not states:
                continue
            if i >= settle and len(best) == 0:
                (a, b), (_, text) = min(states.items(), key=lambda x: x[1])
                done.append(text)
                states, settle = {(a, b): (0.0, "")}, i + SETTLE
            for (a, b), (sofar, text) in states.items():
                for step, letters, price in edges[i]:
                    x, y, total = a, b, sofar + price
                    for c in letters:
                        z = _code(c)
                        total += cost[x][y][z]
                        x, y = y, z
                    there = best.setdefault(i + step, {})
                    old = there.get((x, y))
                    if old is None or (total, text + letters) < old:
                        there[(x, y)] = (total, text + letters)
        return "".join(done) + min((total + cost[a][b][0], text) for (a, b), (total, text) in best[n].items())[1]

    def restore(self, text: str) -> str:
        """The text with every traced token decoded, however long; only short ones are worth remembering."""
        return _TRACE.sub(lambda m: (self.restored if len(m[0]) <= CACHED else self._restored)(m[0].lower()), text)

    def restore_all(self, col: pa.Array) -> pa.Array:
        may = pc.fill_null(pc.match_substring_regex(col, _MAY), False)
        if not pc.any(may).as_py():
            return col
        return pa.array([self.restore(t.as_py()) if m else t.as_py() for t, m in zip(col, may.to_pylist(), strict=True)], pa.string())


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word in lower case and of its beginnings of 4, 5 and 6 bytes, with repeats."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    low[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)] += 32
    solid = (LETTER[low] > 0).astype(np.int8)
    flips = np.diff(solid, prepend=np.int8(0), append=np.int8(0))
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    inner = np.zeros(len(buf) + 1, bool)
    inner[1:-1] = edge[1:-1] & (solid[1:] == 1) & (solid[:-1] == 1)
    starts, ends = np.flatnonzero((flips == 1) | inner), np.flatnonzero((flips == -1) | inner)
    row = np.searchsorted(offs, starts, "right") - 1
    span = SpanHash(low)
    rows, hashes = [row], [span(starts, ends)]
    for k in (4, 5, 6):
        longer = ends - starts > k
        rows.append(row[longer])
        hashes.append(mix(span(starts[longer], starts[longer] + k) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class ToxicModel:
    channel: Channel | None
    trigrams: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def decoder(self) -> Channel:
        self.channel = self.channel or Channel(self.trigrams)
        return self.channel

    def hits(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (text, index of a feature)."""
        row, h = features(buf, offs)
        near = np.zeros(1 << 16, bool)
        near[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(near[(h & np.uint64(0xFFFF)).astype(np.int64)])
        row, h = row[at], h[at]
        k = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        hit = self.keys[k] == h if len(self.keys) else np.zeros(len(h), bool)
        pairs = np.unique(row[hit] * np.int64(MOST_FEATURES) + k[hit])
        return pairs // MOST_FEATURES, pairs % MOST_FEATURES

    def score(self, col: pa.Array) -> np.ndarray:
        buf, offs = text_buffer(self.decoder().restore_all(col))
        out = np.full(len(offs) - 1, self.bias)
        for i, j in row_slices(offs):
            row, k = self.hits(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            out[i:j] += np.bincount(row, self.weights[k], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the ridge-penalised log loss."""
    n, d = x.shape
    y = y.astype(np.float32)
    w, b = np.zeros(d, np.float32), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    v, c = w.copy(), b
    top = np.ones(d, np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        top = x.T @ (x @ (top / np.linalg.norm(top)))
    lip = 0.25 * (1.1 * float(np.linalg.norm(top)) / n + 1) + ridge / n
    for t in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        w2, b2 = v - (x.T @ g / n + ridge / n * v) / lip, c - g.mean() / lip
        k = t / (t + 3)
        v, c, w, b = w2 + k * (w2 - w), b2 + k * (b2 - b), w2, b2
    return w, b


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> ToxicModel:
    """Learn from the rows of labels (id, label) that have a text in df; the caller leaves out the held-out ones."""
    trigrams = letter_trigrams(df, text_col)
    texts = labelled_texts(df, labels, label, id_col, text_col, most)
    model = ToxicModel(None, trigrams, np.zeros(0, np.uint64), np.zeros(0), 0.0)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(shared.value.decoder().restore_all(b.column(1)))
            for i, j in row_slices(offs):
                row, h = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                first = _first(row, h)
                row, h = row[first] + i, h[first]
                yield pa.RecordBatch.from_pydict({"row_id": b.column(0).take(pa.array(row)).cast(pa.int64()), "y": b.column(2).take(pa.array(row)), "h": pa.array(h.view(np.int64))})

    sampled = texts.mapInArrow(distinct_features, "row_id long, y double, h long")
    totals = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = totals.n or 0, totals.pos or 0.0
    if not n or pos <= 0 or pos >= n:
        model.bias = 0.0 if not n else float(np.clip(math.log((pos + 1e-9) / (n - pos + 1e-9)), -20, 20))
        return model
    # How far a feature's rows lean to label 1 or 0, in standard deviations; the strongest stay.
    share = pos / n
    lean = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    stats = sampled.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).where(F.col("n") >= LEAST_ROWS)
    top = stats.withColumn("lean", F.abs(lean)).where(F.col("lean") > 4).orderBy(F.desc("lean"), "h").limit(MOST_FEATURES).collect()
    model.keys = np.sort(np.array([r.h for r in top], np.int64).view(np.uint64))
    chosen = df.sparkSession.sparkContext.broadcast(model)

    def hit_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = chosen.value
        for b in batches:
            buf, offs = text_buffer(m.decoder().restore_all(b.column(1)))
            for i, j in row_slices(offs):
                row, k = m.hits(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                bounds = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"row_id": b.column(0).slice(i, j - i).cast(pa.int64()), "y": b.column(2).slice(i, j - i), "k": pa.ListArray.from_arrays(pa.array(bounds), pa.array(k.astype(np.int32)))})

    rows = sorted((r.row_id, r.k, r.y) for r in texts.mapInArrow(hit_lists, "row_id long, y double, k array<int>").collect())
    discard(df.sparkSession, texts)
    x = np.zeros((len(rows), len(model.keys)), np.float32)
    for i, r in enumerate(rows):
        x[i, r[1]] = 1
    model.weights, model.bias = _logistic(x, np.array([r[2] for r in rows]))
    model.channel = None
    return model


def score(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "score": pa.array(shared.value.score(b.column(1)), pa.float64())})

    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")


def restore(df: DataFrame, trigrams: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored string): the texts after deobfuscation alone."""
    shared = df.sparkSession.sparkContext.broadcast(trigrams)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "restored": pc.fill_null(channel.restore_all(b.column(1)), "")})

    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, restored string")
