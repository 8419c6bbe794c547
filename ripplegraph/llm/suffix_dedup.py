"""Suffix-array dedup: remove every byte covered by a 100-byte string that also starts earlier.

Earlier means in a row with a smaller id, or in the same row further left;
strings are judged on the input and never cross rows.

1. The least hash among the 24-byte strings of a 100-byte window (leftmost among
   equals) anchors the window.  Equal windows have equal anchors, so all windows
   that could be equal meet under one anchor.  Neighbouring windows with one
   anchor are a segment (100 to 176 bytes).  Only narrow rows of segments are
   shuffled, packed: the anchor, a digest of the content, and the place.
2. Under an anchor, segments of one content are a class.  All but the earliest
   member repeat as a whole.  A class that is alone under its anchor needs no
   more work.  Of the others the earliest member goes on, with its bytes.
3. Such segments, dealt by anchor into shards, are sorted by induced sorting
   at every level of its recursion (``suffix_array``); permuted common prefixes tell which suffixes share 100
   bytes; in each such group all but the earliest window repeat.
4. Each row's repeated windows join to removed spans.

A passage in any number of rows thus costs narrow rows and one segment for each
distinct surrounding; of a class's members in one slice of the input, only the
earliest is dealt by anchor, the others are dealt evenly.  Contents are told apart by 64 bits of a
hash under one anchor; suffixes are compared by their bytes.

Results: one row for each input row.  Null and short texts have no spans.  A null
id counts as the largest id.  Rows repeated with an id are the same place: none
is earlier than the other, so they keep what no other place repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, stored
from .suffix_array import permuted_prefixes, suffix_array
from .textbuf import SpanHash, mix, row_slices, text_buffer

LENGTH, GRAM = 100, 24
LAST = (1 << 63) - 1
#: Bytes of one text that are looked at in one go; longer texts go in overlapping pieces.
PIECE = 1 << 22


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    m, k = v, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - k :]) if k < width else m


def segments(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, anchor, digest) of each segment; windows are places within the row."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    sizes = np.diff(offs)
    if n < LENGTH or sizes.max(initial=0) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    data = np.ascontiguousarray(buf)
    eight = np.ndarray((n - 7,), np.uint64, data.data, 0, (1,))
    grams = n - GRAM + 1
    h = eight[:grams] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + grams]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += eight[16 : 16 + grams]
    h = mix(h)
    places = np.uint64((1 << 24) - 1)
    least = _window_minima((h & ~places) | np.arange(grams, dtype=np.uint64), LENGTH - GRAM + 1)
    anchor = (least & places).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int64)
    long_rows = np.flatnonzero(sizes >= LENGTH)
    np.add.at(inside, offs[:-1][long_rows], 1)
    np.add.at(inside, offs[1:][long_rows] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    # Rows of exactly one window may follow each other without a gap.
    starts = offs[:-1][long_rows]
    begins[starts] = True
    first = np.flatnonzero(begins)
    closes = np.ones(len(valid), bool)
    closes[:-1] = begins[1:] | ~valid[1:]
    last = np.flatnonzero(closes & valid)
    row = np.searchsorted(offs, first, "right") - 1
    at = anchor[first]
    digest = mix(SpanHash(data)(first, last + LENGTH) + (at - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return row, first - offs[row], last - offs[row], h[at], digest


def _pieces(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of all rows, (row, first, last, anchor, digest), a slice at a time."""
    for i, j in row_slices(offs):
        if offs[j] - offs[i] <= PIECE:
            row, first, last, anchor, digest = segments(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield row + i, first, last, anchor, digest
            continue
        for at in range(int(offs[i]), int(offs[j]), PIECE):
            part = buf[at : min(at + PIECE + LENGTH - 1, offs[j])]
            row, first, last, anchor, digest = segments(part, np.array([0, len(part)]))
            yield row + i, first + at - offs[i], last + at - offs[i], anchor, digest


def _tagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("row_id"), F.hash(text).alias("tag"), text.alias("row_text"))


def _later(anchor: np.ndarray, digest: np.ndarray, row_id: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether an earlier place among these has the same anchor and content."""
    order = np.lexsort((first, row_id, digest, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    out = np.zeros(len(order), bool)
    out[order] = (row_id[order] != row_id[head]) | (first[order] != first[head])
    return out


_COLUMNS = (("low", np.uint32), ("high", np.uint8), ("d_low", np.uint32), ("d_high", np.uint32), ("row_id", np.int64), ("tag", np.int32), ("first", np.int32), ("more", np.uint8), ("sure", np.uint8))


def _repeats_and_rest(texts: DataFrame, buckets: int) -> DataFrame:
    """Stored (row_id, tag, first, last, shard): whole repeats have no shard; segments that need sorting have one."""
    spark = texts.sparkSession

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            buf, offs = text_buffer(b.column(2))
            for row, first, last, anchor, digest in _pieces(buf, offs):
                # Of a class that comes often here the earliest member alone meets other tasks' members;
                # the later ones repeat for certain and go where there is room.
                sure = _later(anchor, digest, ids[row], first)
                spread = mix(ids[row].view(np.uint64) + first.astype(np.uint64)) % np.uint64(buckets)
                bucket = np.where(sure, spread, (anchor >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((anchor, bucket))
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(bounds))
                row, first, last, anchor, digest, sure = (x[order] for x in (row, first, last, anchor, digest, sure))
                # Bits above those that chose the bucket are shared by many; 40 lower bits tell anchors apart.
                columns = {"low": anchor, "high": anchor >> np.uint64(32), "d_low": digest, "d_high": digest >> np.uint64(32), "row_id": ids[row], "tag": tags[row], "first": first, "more": last - first, "sure": sure}
                packed = {"bucket": pa.array(full.astype(np.int32))}
                for name, kind in _COLUMNS:
                    x = columns[name]
                    x = (x & np.uint64(np.iinfo(kind).max)).astype(kind) if x.dtype == np.uint64 else x.astype(kind)
                    packed[name] = pa.array([x[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary())
                yield pa.RecordBatch.from_pydict(packed)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(row[0], []).append(row[1:])
        for bucket in list(parts):
            low, high, d_low, d_high, row_id, tag, first, more, sure = (np.concatenate([np.frombuffer(r[k], kind) for r in parts[bucket]]) for k, (_, kind) in enumerate(_COLUMNS))
            del parts[bucket]
            if sure.any():
                k = np.flatnonzero(sure)
                yield pa.RecordBatch.from_pydict({"row_id": pa.array(row_id[k]), "tag": pa.array(tag[k]), "first": pa.array(first[k]), "last": pa.array(first[k] + more[k].astype(np.int32)), "shard": pa.nulls(len(k), pa.int32())})
                low, high, d_low, d_high, row_id, tag, first, more = (x[sure == 0] for x in (low, high, d_low, d_high, row_id, tag, first, more))
                if not len(low):
                    continue
            anchor = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
            digest = d_low.astype(np.uint64) | (d_high.astype(np.uint64) << np.uint64(32))
            order = np.lexsort((first, row_id, digest, anchor))
            anchor, digest, row_id, tag, first, more = (x[order] for x in (anchor, digest, row_id, tag, first, more))
            new_anchor = np.ones(len(anchor), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_class = new_anchor.copy()
            new_class[1:] |= digest[1:] != digest[:-1]
            head = np.flatnonzero(new_class)[np.cumsum(new_class) - 1]
            repeat = (row_id != row_id[head]) | (first != first[head])
            group = np.cumsum(new_anchor) - 1
            mixed = np.bincount(group[new_class]) > 1
            # Rows repeated with an id hold the same place: any of them stands for its class.
            rest = new_class & mixed[group]
            use = np.flatnonzero(repeat | rest)
            yield pa.RecordBatch.from_pydict({"row_id": pa.array(row_id[use]), "tag": pa.array(tag[use]), "first": pa.array(first[use]), "last": pa.array(first[use] + more[use].astype(np.int32)), "shard": pa.array(np.full(len(use), bucket, np.int32), mask=~rest[use])})

    fields = ", ".join(f"{name} binary" for name, _ in _COLUMNS)
    sent = texts.select("row_id", "tag", "row_text").mapInArrow(send, f"bucket int, {fields}")
    return stored(sent.repartition(partitions(spark), "bucket").mapInArrow(judge, "row_id long, tag int, first int, last int, shard int"), "segments")


def _with_spans(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """texts with the lists of their spans; the narrow side is the hashed one."""
    of = spans.withColumnsRenamed({"row_id": "span_id", "tag": "span_tag"})
    joined = texts.join(of.hint("shuffle_hash"), (F.col("row_id") == F.col("span_id")) & (F.col("tag") == F.col("span_tag")), how)
    return joined.drop("span_id", "span_tag")


def shard_repeats(row_id: np.ndarray, first: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of each window of a shard's segments that starts earlier elsewhere in the shard."""
    sizes = np.array([len(x) for x in data], np.int64)
    t = np.zeros(int(sizes.sum()) + len(data) + 1, np.uint8)
    offs = np.concatenate([[0], np.cumsum(sizes + 1)])
    # UTF-8 has no bytes over 0xF7, so two more values fit: 1 ends a segment, 0 the shard.
    flat = np.frombuffer(b"\xff".join(data) + b"\xff", np.uint8)
    t[:-1] = np.where(flat == 0xFF, 1, flat + 2)
    sa = suffix_array(t)
    prefix = permuted_prefixes(t, sa, offs[:-1], 2 * LENGTH)
    segment = np.searchsorted(offs, sa, "right") - 1
    segment = np.minimum(segment, len(data) - 1)
    whole = offs[segment] + sizes[segment] - sa >= LENGTH
    new = prefix[sa] < LENGTH
    new[0] = True
    group = np.cumsum(new) - 1
    sizes_of = np.bincount(group[whole], minlength=int(group[-1]) + 1)
    use = np.flatnonzero(whole & (sizes_of[group] > 1))
    place = sa[use] - offs[segment[use]]
    start = first[segment[use]] + place
    order = np.lexsort((start, row_id[segment[use]], group[use]))
    g, s, p = group[use][order], segment[use][order], place[order]
    begin = np.ones(len(g), bool)
    begin[1:] = g[1:] != g[:-1]
    head = np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(g) else np.zeros(0, np.int64)
    later = (row_id[s] != row_id[s[head]]) | (first[s] + p != first[s[head]] + p[head])
    return s[later], p[later]


def _sorted_repeats(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """(row_id, tag, first, last): repeated windows among the segments that need sorting."""
    listed = rest.groupBy("row_id", "tag").agg(F.collect_list(F.struct("first", "last", "shard")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row_id, tag, text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                buf = memoryview(text.as_buffer())
                first, last, shard = (parts.values.field(k).to_pylist() for k in range(3))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "row_id": pa.array([row_id] * len(first), pa.int64()), "tag": pa.array([tag] * len(first), pa.int32()), "first": pa.array(first, pa.int32()), "bytes": pa.array([bytes(buf[x : y + LENGTH]) for x, y in zip(first, last, strict=True)], pa.binary())})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            kinds = np.unique(b.column(0).to_numpy())
            for k in kinds.tolist():
                shards.setdefault(k, []).append(b.filter(pa.array(b.column(0).to_numpy() == k)) if len(kinds) > 1 else b)
        for k in list(shards):
            t = pa.Table.from_batches(shards.pop(k)).combine_chunks()
            row_id, tag, first = (t[c].to_numpy() for c in ("row_id", "tag", "first"))
            s, p = shard_repeats(row_id, first.astype(np.int64), t["bytes"].to_pylist())
            if not len(s):
                continue
            order = np.lexsort((p, s))
            s, p = s[order], p[order]
            begin = np.ones(len(s), bool)
            begin[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)
            at = np.flatnonzero(begin)
            end = np.append(at[1:], len(s)) - 1
            yield pa.RecordBatch.from_pydict({"row_id": pa.array(row_id[s[at]]), "tag": pa.array(tag[s[at]]), "first": pa.array((first[s[at]] + p[at]).astype(np.int32)), "last": pa.array((first[s[at]] + p[end]).astype(np.int32))})

    cuts = _with_spans(texts, listed, "inner").select("row_id", "tag", "row_text", "parts").mapInArrow(cut, "shard int, row_id long, tag int, first int, bytes binary")
    return cuts.repartition(partitions(texts.sparkSession), "shard").mapInArrow(sort, "row_id long, tag int, first int, last int")


def _kept(text: pa.Scalar, first: list[int], last: list[int]) -> tuple[int, list[int], list[int], bytes]:
    """Bytes of a text, its removed spans, and what is left, from its repeated windows."""
    buf = np.frombuffer(text.as_buffer(), np.uint8)
    if not first:
        return len(buf), [], [], buf.tobytes()
    order = np.argsort(first)
    x, y = np.asarray(first, np.int64)[order], np.asarray(last, np.int64)[order] + LENGTH
    reach = np.maximum.accumulate(y)
    begin = np.ones(len(x), bool)
    begin[1:] = x[1:] > reach[:-1]
    at = np.flatnonzero(begin)
    start, end = x[at], reach[np.append(at[1:], len(x)) - 1]
    gone = np.zeros(len(buf) + 1, np.int8)
    gone[start] += 1
    gone[end] -= 1
    return len(buf), start.tolist(), end.tolist(), buf[np.cumsum(gone[:-1]) == 0].tobytes()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start,end>>, kept binary) for each row of df; places are bytes, ends exclusive."""
    spark = df.sparkSession
    texts = _tagged(df, id_col, text_col)
    found = _repeats_and_rest(texts, 8 * partitions(spark))
    sorted_out = stored(_sorted_repeats(texts, found.where("shard IS NOT NULL")), "repeats")
    repeats = found.where("shard IS NULL").select("row_id", "tag", "first", "last").union(sorted_out)
    listed = stored(repeats.groupBy("row_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("parts")), "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, parts in zip(b.column(1), b.column(2), strict=True):
                first, last = (parts.values.field(k).to_pylist() for k in range(2)) if parts.is_valid else ([], [])
                out.append(_kept(text, first, last))
            size, start, end, kept = zip(*out, strict=True) if out else ([], [], [], [])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in start])]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array([v for x in w for v in x], pa.int64()) for w in (start, end)], ["start", "end"])
            yield pa.RecordBatch.from_pydict({"row_id": b.column(0), "n_bytes": pa.array(size, pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(offsets), spans), "kept": pa.array(kept, pa.binary())})

    stripped = _with_spans(texts, listed, "left").select("row_id", "row_text", "parts").mapInArrow(strip, "row_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return stripped.select(F.nullif("row_id", F.lit(LAST)).alias(id_col), "n_bytes", "spans", "kept")
