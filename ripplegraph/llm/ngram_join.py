"""N-gram Jaccard join: rare-first prefix filtering, exact, without all pairs of a group.

Words are runs of characters other than ASCII white space after A-Z become lower
case.  A text's set is its distinct five-word shingles; shorter texts have their
whole word sequence as one.  Two texts link when 100 * |intersection| >= 80 *
|union|; texts without words link with nothing.

1. Texts with one set are one class (any number of copies costs one class).
2. A count sketch over all shingles, of as many cells as the input's size asks for
   (4 M to 32 M, one byte each), orders them, rarest first (ties by hash).  A class's prefix are its first n - ceil(0.8 n) + 1 shingles; linked
   classes share one in their prefixes.
3. Prefix shingles meet in buckets, packed.  A shingle so frequent that its list
   could be large (by the sketch) is salted into lists of bounded size.
4. Links are found in rounds.  In each list, the smallest set is the pivot of
   those that the length filter allows, then the next one, and so on: pivot pairs
   are verified and their links joined to components.  While lists have many
   pairs across components, members outside a list's largest component probe a
   few members of it.  At last all members of different components form pairs.
   So every candidate pair is either verified or known to be connected, and the
   components are exact.
5. Length and positional filters drop pairs as they form.  Each class has a
   profile: how many of its shingles lie in each of about n / 3 hash ranges.  The
   suffix filter bounds a pair's intersection by the lesser counts of the two
   profiles, before any whole set moves; only sets of pairs that pass it are
   gathered (once), and such a pair is verified once, from its whole sets.
6. Links lie within components.  In a component of which not all pairs are known
   to link, all sets are compared, block by block: one product of two 0/1 matrices
   gives a block pair's intersections.  So n_links is exact; the work grows with
   the square of the component's number of distinct sets, what is moved with that
   square divided by the block.

Shingles and classes are told apart by 64-bit hashes, intersections by 48 bits of
them.

Results: one row for each input row; repeated rows and rows with a null id get
the component of their text.  Null, empty and blank texts have no shingles and
are their own component.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import labels
from .shared import discard, partitions, release, stored
from .textbuf import SpanHash, mix, row_slices, text_buffer

WORDS = 5
#: Least and most bits of a cell's number in the count sketch, input bytes for each cell, and cells of a block.
CELL_BITS, BYTES_A_CELL, CELL_BLOCK = (22, 25), 100, 1 << 15
#: Longest list that is not salted; bits of the filter of classes that need verification.
LIST_ROWS, FILTER_BITS = 1024, 1 << 25
#: Rounds of probing before all open pairs are made, and partners that a member probes in a list in the first
#: round; four times as many in each later one, when few members are left outside.
ROUNDS, PROBES = 3, 4
#: Sets of a block and shingles (columns) of one matrix product when a component's links are counted.
BLOCK, COLUMNS = 256, 4096
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles, sorted within a text, and where each text's begin."""
    rows = len(offs) - 1
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    of = np.searchsorted(offs, starts, "right") - 1
    words = SpanHash(low)(starts, ends)
    count = np.bincount(of, minlength=rows)
    found, owner = [], []
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        h = np.zeros(n, np.uint64)
        for j in range(WORDS):
            h = mix(h + words[j : j + n] * _SEEDS[j])
        inside = of[:n] == of[WORDS - 1 :]
        found.append(h[inside])
        owner.append(of[:n][inside])
    first = np.searchsorted(of, np.arange(rows))
    for m in range(1, WORDS):
        short = np.flatnonzero(count == m)
        if len(short):
            h = np.full(len(short), m, np.uint64)
            for j in range(m):
                h = mix(h + words[first[short] + j] * _SEEDS[j])
            found.append(h)
            owner.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h, own = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(rows + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set: the same for equal sets; 0 for an empty one."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ _SEEDS[4]), out=sums[1:])
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, mix(sums[at[1:]] - sums[at[:-1]] + n) | np.uint64(1), np.uint64(0))


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def may_link(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Length and positional filters: na <= nb are set sizes, pa_ and pb places of a common shingle."""
    return (5 * na >= 4 * nb) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= -(-4 * (na + nb) // 9))


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _cell_bits(texts: DataFrame) -> int:
    """Bits of a cell's number for the planner's estimate of the input's bytes."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max((size // BYTES_A_CELL).bit_length(), CELL_BITS[0]), CELL_BITS[1])


def profiles(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each sorted set, how many of its hashes lie in each of 2**r equal ranges (two to four a range); 255: so many or more."""
    n = np.diff(at)
    bits = np.maximum(np.frexp(np.maximum(n, 1))[1].astype(np.int64) - 2, 0)
    offs = np.concatenate([[0], np.cumsum(np.int64(1) << bits)])
    own = np.repeat(np.arange(len(n)), n)
    # Two shifts, as one by 64 has no defined result.
    counts = np.bincount(offs[own] + ((h >> np.uint64(1)) >> (np.uint64(63) - bits[own].astype(np.uint64))).astype(np.int64), minlength=int(offs[-1]))
    data = np.minimum(counts, 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """A bound, from their profiles, on the hashes that two sets can share."""
    x, y = (np.where(z == 255, 1 << 40, z.astype(np.int64)) for z in (x, y))
    if len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x.reshape(len(y), -1).sum(1)
    return int(np.minimum(x, y).sum())


def _each_slice(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = text_buffer(col)
    for i, j in row_slices(offs):
        yield i, j, *shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Stored (row_id, n, sig, profile) of all rows with other rows for the sketch, and the sketch as a byte for each cell: the count's rank on a log scale."""
    bits = _cell_bits(texts)
    n_cells = 1 << bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(n_cells, np.uint32)
        for b in batches:
            for i, j, h, at in _each_slice(b.column(1)):
                np.add.at(cells, _cell(h, bits), np.uint32(1))
                rows = j - i
                yield pa.RecordBatch.from_pydict({"row_id": b.column(0).slice(i, rows), "n": pa.array(np.diff(at)), "sig": _signed(signatures(h, at)), "profile": profiles(h, at), "block": pa.nulls(rows, pa.int32()), "cells": pa.nulls(rows, pa.binary())})
        blocks = [k for k in range(n_cells // CELL_BLOCK) if cells[k * CELL_BLOCK : (k + 1) * CELL_BLOCK].any()]
        for k in blocks:
            nothing = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_pydict({"row_id": nothing, "n": nothing, "sig": nothing, "profile": pa.nulls(1, pa.binary()), "block": pa.array([k], pa.int32()), "cells": pa.array([zlib.compress(cells[k * CELL_BLOCK : (k + 1) * CELL_BLOCK].tobytes(), 1)], pa.binary())})

    both = stored(texts.mapInArrow(work, "row_id long, n long, sig long, profile binary, block int, cells binary"), "signatures")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
        levels = [np.ceil(4 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "levels": pa.array(levels, pa.binary())})

    summed = both.where("block IS NOT NULL").select("block", "cells").repartition(partitions(texts.sparkSession), "block").mapInArrow(total, "block int, levels binary")
    sketch = np.zeros(n_cells, np.uint8)
    for r in summed.collect():  # 2**25 bytes at most, whatever the input
        sketch[r.block * CELL_BLOCK : (r.block + 1) * CELL_BLOCK] = np.frombuffer(r.levels, np.uint8)
    return both, sketch


def _lists(texts: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Stored lists of classes that share a prefix shingle: (list_id, hot, sigs, ns, places), members by (n, sig)."""
    spark = texts.sparkSession
    buckets = 8 * partitions(spark)
    levels = spark.sparkContext.broadcast(sketch)
    bits = len(sketch).bit_length() - 1
    # What a cell usually holds besides a shingle of its own makes no shingle frequent.
    usual = 1.5 * float(np.mean(2.0 ** (sketch / 4.0) - 1))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.uint64)  # classes that this task sent lately
        for b in batches:
            for _, _, h, at in _each_slice(b.column(0)):
                n, sig = np.diff(at), signatures(h, at)
                # Copies of a class are sent once for each batch and, mostly, task.
                fresh = np.zeros(len(n), bool)
                fresh[np.unique(sig, return_index=True)[1]] = True
                fresh &= (n > 0) & (seen[(sig & np.uint64(0xFFFF)).astype(np.int64)] != sig)
                seen[(sig[fresh] & np.uint64(0xFFFF)).astype(np.int64)] = sig[fresh]
                own = np.repeat(np.arange(len(n)), n)
                keep = fresh[own]
                h, own = h[keep], own[keep]
                level = levels.value[_cell(h, bits)]
                order = np.lexsort((h, level, own))
                h, own, level = h[order], own[order], level[order]
                place = np.arange(len(h)) - np.searchsorted(own, own)
                keep = place < prefix_sizes(n)[own]
                h, own, level, place = h[keep], own[keep], level[keep], place[keep]
                salts = np.maximum(1, np.ceil((2.0 ** (level / 4.0) - usual) / LIST_ROWS)).astype(np.uint64)
                bucket = (mix(h + (sig[own] >> np.uint64(20)) % salts * _SEEDS[1]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, own, place, bucket, hot = h[order], own[order], place[order], bucket[order], salts[order] > 1
                bounds = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(bounds))

                def packed(x: np.ndarray, bounds=bounds, full=full) -> pa.Array:
                    return pa.array([x[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary())

                # 40 bits of a shingle are enough to meet: more that meet by chance fail verification.
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full.astype(np.int32)), "low": packed((h >> np.uint64(24)).astype(np.uint32)), "high": packed((h >> np.uint64(56)).astype(np.uint8)), "sig": packed(sig[own]), "n": packed(n[own].astype(np.int32)), "place": packed(place.astype(np.int32)), "hot": packed(hot)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(row[0], []).append(row[1:])
        for bucket in list(parts):
            low, high, sig, n, place, hot = (np.concatenate([np.frombuffer(r[k], t) for r in parts[bucket]]) for k, t in enumerate((np.uint32, np.uint8, np.uint64, np.int32, np.int32, bool)))
            del parts[bucket]
            token = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
            order = np.lexsort((sig, n, token))
            token, sig, n, place, hot = token[order], sig[order], n[order], place[order], hot[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
            token, sig, n, place, hot = token[new], sig[new], n[new], place[new], hot[new]
            begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(np.append(begins, len(token)))
            two = np.flatnonzero(sizes == 2)
            a = begins[two]
            drop = two[~may_link(n[a], n[a + 1], place[a], place[a + 1])]
            use = sizes > 1
            use[drop] = False
            use |= hot[begins]
            # Equal lists of many shingles are one list; a member keeps its foremost place.
            lists: dict[tuple[bytes, int], list] = {}
            for i, m in zip(begins[use].tolist(), sizes[use].tolist(), strict=True):
                key = (sig[i : i + m].tobytes(), int(token[i]) if hot[i] else -1)
                old = lists.get(key)
                lists[key] = [n[i : i + m], place[i : i + m] if old is None else np.minimum(old[1], place[i : i + m])]
            if lists:
                yield pa.RecordBatch.from_pydict(
                    {
                        "hot": pa.array([k[1] for k in lists], pa.int64()),
                        "sigs": pa.array([np.frombuffer(k[0], np.int64) for k in lists], pa.list_(pa.int64())),
                        "ns": pa.array([v[0] for v in lists.values()], pa.list_(pa.int32())),
                        "places": pa.array([v[1] for v in lists.values()], pa.list_(pa.int32())),
                    }
                )

    sent = texts.select("row_text").mapInArrow(tokens, "bucket int, low binary, high binary, sig binary, n binary, place binary, hot binary")
    met = sent.repartition(partitions(spark), "bucket").mapInArrow(meet, "hot long, sigs array<long>, ns array<int>, places array<int>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple, list] = {}
        for b in batches:
            for key, hot, sigs, ns, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                old = lists.get((key, hot))
                lists[(key, hot)] = [sigs, ns, places if old is None else [min(x, y) for x, y in zip(old[2], places, strict=True)]]
        keys = list(lists)
        for at in range(0, len(keys), 1000):
            part = keys[at : at + 1000]
            yield pa.RecordBatch.from_pydict({"list_id": pa.array([k[0] for k in part], pa.int64()), "hot": pa.array([k[1] for k in part], pa.int64()), "sigs": pa.array([lists[k][0] for k in part], pa.list_(pa.int64())), "ns": pa.array([lists[k][1] for k in part], pa.list_(pa.int32())), "places": pa.array([lists[k][2] for k in part], pa.list_(pa.int32()))})

    # Written once before the merge, which lets the larger shuffle of the prefixes go.
    met = stored(met, "met")
    release(spark)
    keyed = met.select(F.xxhash64("hot", "sigs").alias("list_id"), "hot", "sigs", "ns", "places")
    lists = stored(keyed.repartition(partitions(spark), "list_id").mapInArrow(merge, "list_id long, hot long, sigs array<long>, ns array<int>, places array<int>"), "lists")
    discard(spark, met)
    return lists


def _pivots(n: np.ndarray) -> np.ndarray:
    """For each member, in the order of sizes, the place of its pivot: the first one that the length filter allows."""
    out = np.zeros(len(n), np.int64)
    pivot = 0
    for i in range(len(n)):
        if 5 * n[pivot] < 4 * n[i]:
            pivot = i
        out[i] = pivot
    return out


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _pivot_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with its pivot; pivots of a salted shingle's lists with the next one by size."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for sigs, ns, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s, n, p = np.array(sigs, np.int64), np.array(ns, np.int64), np.array(places, np.int64)
                to = _pivots(n)
                ok = np.flatnonzero((to != np.arange(len(n))) & may_link(n[to], n, p[to], p))
                found.append((s[to[ok]], s[ok]))
            yield _pair_batch(found)

    near = lists.where(F.size("sigs") > 1).select("sigs", "ns", "places").mapInArrow(stars, "a long, b long")
    first = lists.where("hot >= 0").select("hot", F.col("sigs")[0].alias("sig"), F.col("ns")[0].alias("n"))
    by = Window.partitionBy("hot").orderBy("n", "sig")
    chained = first.select("sig", F.lag("sig").over(by).alias("other")).where("other IS NOT NULL")
    return near.union(chained.select(F.least("sig", "other"), F.greatest("sig", "other"))).where("a <> b")


def _members(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Stored members of the lists, (list_id, hot, sig, n, place, component)."""
    each = lists.select("list_id", "hot", F.explode(F.arrays_zip("sigs", "ns", "places")).alias("m")).select("list_id", "hot", F.col("m.sigs").alias("sig"), F.col("m.ns").alias("n"), F.col("m.places").alias("place"))
    return stored(each.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig")), "members")


def _still_open(members: DataFrame) -> tuple[int, int]:
    """Pairs of a list (or of a salted shingle's lists) that lie in different components, and members."""
    key = F.when(F.col("hot") < 0, F.col("list_id")).otherwise(F.col("hot"))
    sizes = members.groupBy(key.alias("k"), (F.col("hot") < 0).alias("one"), "component").agg(F.count(F.lit(1)).cast("double").alias("c"))
    sums = sizes.groupBy("k", "one").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    found = sums.agg(F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2), F.sum("c")).first()
    return int(found[0] or 0), int(found[1] or 0)


def _mixed_lists(members: DataFrame) -> DataFrame:
    """One row (m) for each unsalted list whose members lie in different components."""
    mixed = members.where("hot < 0").groupBy("list_id").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("c")).where("x <> y AND c > 2").select("list_id")
    return members.join(mixed, "list_id").groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("n", "sig", "place", "component"))).alias("m")).select("m")


def _mixed_hot(members: DataFrame) -> DataFrame:
    """Stored members of the salted shingles whose members lie in different components, with the largest one as major."""
    hot = members.where("hot >= 0")
    sizes = hot.groupBy("hot", "component").agg(F.count(F.lit(1)).alias("c"))
    major = sizes.groupBy("hot").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.count(F.lit(1)).alias("k")).where("k > 1").select("hot", "major")
    return stored(hot.join(major, "hot").select("hot", "major", "sig", "n", "place", "component"), "hot")


def _filters(n: str, place: str, n2: str, place2: str):
    n, place, n2, place2 = map(F.col, (n, place, n2, place2))
    return (5 * F.least(n, n2) >= 4 * F.greatest(n, n2)) & (1 + F.least(n - place - 1, n2 - place2 - 1) >= F.ceil(4 * (n + n2) / 9))


def _probe_pairs(members: DataFrame, number: int) -> DataFrame:
    """Pairs of each member outside its list's largest component with some members of that one, by a hash of the round."""
    probes = PROBES * 4**number

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for row in b.column(0):
                n, s, p, c = (row.values.field(k).to_numpy().astype(np.int64) for k in range(4))
                kinds, back, counts = np.unique(c, return_inverse=True, return_counts=True)
                inside = np.flatnonzero(back == counts.argmax())
                outside = np.flatnonzero(back != counts.argmax())
                for k in range(probes):
                    h = mix(s[outside].view(np.uint64) ^ np.uint64((number * 1009 + k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                    to = inside[(h % np.uint64(len(inside))).astype(np.int64)]
                    x, y = np.minimum(to, outside), np.maximum(to, outside)
                    ok = may_link(n[x], n[y], p[x], p[y])
                    found.append((s[x[ok]], s[y[ok]]))
            yield _pair_batch(found)

    near = _mixed_lists(members).mapInArrow(probe, "a long, b long")
    hot = _mixed_hot(members)
    turn = Window.partitionBy("hot").orderBy(F.xxhash64("sig", F.lit(number)), "sig")
    inside = hot.where("component = major").select("hot", F.col("sig").alias("s2"), F.col("n").alias("n2"), F.col("place").alias("p2"), F.row_number().over(turn).alias("turn"))
    met = hot.where("component <> major").join(inside.where(F.col("turn") <= 2 * probes), "hot").where(_filters("n", "place", "n2", "p2"))
    return near.union(met.select(F.least("sig", "s2"), F.greatest("sig", "s2")))


def _open_pairs(members: DataFrame) -> DataFrame:
    """All pairs of a list's members that lie in different components."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.column(0):
                n, s, p, c = (row.values.field(k).to_numpy().astype(np.int64) for k in range(4))
                found = []
                for i in range(1, len(n)):
                    j = np.arange(int(np.searchsorted(5 * n[:i], 4 * n[i])), i)
                    ok = j[(c[j] != c[i]) & may_link(n[j], n[i], p[j], p[i])]
                    if len(ok):
                        found.append((s[ok], np.full(len(ok), s[i])))
                yield _pair_batch(found)

    near = _mixed_lists(members).mapInArrow(cross, "a long, b long")
    # Salted shingles: members outside the largest component meet all of another component.
    hot = _mixed_hot(members)
    minor = hot.where("component <> major").select("hot", F.col("sig").alias("s2"), F.col("n").alias("n2"), F.col("place").alias("p2"), F.col("component").alias("c2"))
    met = hot.join(minor, "hot").where(F.col("component") != F.col("c2")).where(_filters("n", "place", "n2", "p2"))
    return near.union(met.select(F.least("sig", "s2"), F.greatest("sig", "s2")))


class Verifier:
    """Whole sets by class, gathered as pairs ask for them, and the verification of pairs."""

    def __init__(self, texts: DataFrame, rows: DataFrame):
        """``rows`` are those of _scan."""
        self.spark, self.texts = texts.sparkSession, texts
        self.parts, run = partitions(self.spark), uuid.uuid4().hex
        self.classes_table, self.sets_table = f"shingle_classes_{run}", f"shingle_sets_{run}"
        classes = rows.where("n > 0").groupBy("sig").agg(F.min("row_id").alias("rep_id"), F.min("n").cast("int").alias("n"), F.min("profile").alias("profile"))
        self._bucketed(classes.repartition(self.parts, "sig"), self.classes_table)
        self._bucketed(self.spark.createDataFrame([], "sig long, shingles binary"), self.sets_table)

    def _bucketed(self, df: DataFrame, name: str) -> None:
        """Bucketed by class, so that no round of verification deals the table anew."""
        df.write.mode("append").bucketBy(self.parts, "sig").sortBy("sig").format("parquet").saveAsTable(name)

    @property
    def classes(self) -> DataFrame:
        """(sig, rep_id, n, profile)"""
        return self.spark.table(self.classes_table)

    @property
    def whole(self) -> DataFrame:
        """(sig, shingles): the packed sets gathered so far."""
        return self.spark.table(self.sets_table)

    def _may_link(self, pairs: DataFrame) -> DataFrame:
        """Stored pairs (a, b) that the suffix filter lets pass."""
        side = lambda c, n, p: self.classes.select(F.col("sig").alias(c), F.col("n").alias(n), F.col("profile").alias(p))
        both = pairs.join(side("a", "n", "p"), "a").join(side("b", "n2", "p2"), "b").where(5 * F.least("n", "n2") >= 4 * F.greatest("n", "n2"))

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                need = -(-4 * (b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()) // 9)
                x, y = (([np.frombuffer(v.as_buffer(), np.uint8) for v in b.column(k)]) for k in (4, 5))
                keep = pa.array([most_common(u, v) >= n for u, v, n in zip(x, y, need.tolist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_pydict({"a": b.column(0).filter(keep), "b": b.column(1).filter(keep)})

        return stored(both.select("a", "b", "n", "n2", "p", "p2").mapInArrow(bound, "a long, b long"), "candidates")

    def _gather(self, pairs: DataFrame) -> None:
        """Add the sets of the pairs' classes that the table lacks."""
        spark, n = self.spark, self.parts
        sigs = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(self.whole.select("sig"), "sig", "left_anti")
        wanted = stored(sigs.join(self.classes.select("sig", "rep_id"), "sig"), "wanted")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(FILTER_BITS, bool)
            for b in batches:
                bits[_bit(b.column(0).drop_null().to_numpy())] = True
            words = np.packbits(bits).reshape(64, -1)
            full = np.flatnonzero(words.any(1))
            yield pa.RecordBatch.from_pydict({"k": pa.array(full.astype(np.int32)), "bits": pa.array([words[k].tobytes() for k in full], pa.binary())})

        def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    x = np.frombuffer(x.as_buffer(), np.uint8)
                    sums[k] = sums[k] | x if k in sums else x
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()), "bits": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

        if wanted.isEmpty():
            discard(spark, wanted)
            return
        # A filter of fixed size keeps most texts that no pair needs out of the shuffle; the join below is exact.
        words = np.zeros((64, FILTER_BITS // 512), np.uint8)
        for r in wanted.select("rep_id").mapInArrow(place, "k int, bits binary").repartition(n, "k").mapInArrow(either, "k int, bits binary").collect():
            words[r.k] = np.frombuffer(r.bits, np.uint8)
        shared = spark.sparkContext.broadcast(words.reshape(-1))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(1 << 16, np.uint64)  # classes that this task sent lately
            for b in batches:
                ids = b.column(0)
                bit = _bit(ids.fill_null(0).to_numpy())
                hit = (shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
                keep = np.flatnonzero((hit == 1) | ~ids.is_valid().to_numpy(False))
                if not len(keep):
                    continue
                for _, _, h, at in _each_slice(b.column(1).take(pa.array(keep))):
                    short, sig = h >> np.uint64(16), signatures(h, at)
                    fresh = np.zeros(len(sig), bool)
                    fresh[np.unique(sig, return_index=True)[1]] = True
                    fresh &= (sig != 0) & (seen[(sig & np.uint64(0xFFFF)).astype(np.int64)] != sig)
                    use = np.flatnonzero(fresh)
                    seen[(sig[use] & np.uint64(0xFFFF)).astype(np.int64)] = sig[use]
                    yield pa.RecordBatch.from_pydict({"sig": _signed(sig[use]), "shingles": pa.array([packed(short[at[k] : at[k + 1]]) for k in use.tolist()], pa.binary())})

        found = self.texts.mapInArrow(sets, "sig long, shingles binary").repartition(n, "sig")
        found = found.join(wanted.select("sig").hint("shuffle_hash"), "sig", "left_semi").dropDuplicates(["sig"])
        self._bucketed(found, self.sets_table)
        discard(spark, wanted)
        release(spark)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Stored pairs (a, b) of classes whose whole sets link; ``pairs`` are distinct."""
        pairs = self._may_link(pairs)
        self._gather(pairs)
        left = pairs.join(self.whole.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a")
        both = left.join(self.whole.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                last, x = None, None
                ok = []
                for u, v in zip(b.column(2), b.column(3), strict=True):
                    y = unpacked(v.as_buffer())
                    if u != last:
                        last, x = u, unpacked(u.as_buffer())
                    ok.append(linked(x, y))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_pydict({"a": b.column(0).filter(keep), "b": b.column(1).filter(keep)})

        out = stored(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
        discard(self.spark, pairs)
        release(self.spark)
        return out


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + _SEEDS[2]) % np.uint64(FILTER_BITS)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """48-bit numbers: all low halves, then all high ones."""
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes()


def unpacked(data: pa.Buffer | bytes) -> np.ndarray:
    data = memoryview(data)
    n = len(data) // 6
    return np.frombuffer(data[: 4 * n], np.uint32).astype(np.uint64) | (np.frombuffer(data[4 * n :], np.uint16).astype(np.uint64) << np.uint64(32))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sorted sets link, by their exact intersection."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def linked_sets(x: list, y: list) -> np.ndarray:
    """Whether each set of x links with each set of y; sets are packed."""
    xs, ys = [unpacked(v) for v in x], [unpacked(v) for v in y]
    nx, ny = (np.array([len(v) for v in z], np.int64) for z in (xs, ys))
    fx, fy = np.concatenate(xs), np.concatenate(ys)
    common = np.intersect1d(fx, fy)
    both = np.zeros((len(xs), len(ys)), np.float32)

    def places(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, column) of the shingles that both sides have, by column."""
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = np.flatnonzero(common[at] == flat)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]

    if len(common):
        (ox, cx), (oy, cy) = places(fx, nx), places(fy, ny)
        for c in range(0, len(common), COLUMNS):
            width = min(COLUMNS, len(common) - c)
            sides = []
            for owner, column, rows in ((ox, cx, len(xs)), (oy, cy, len(ys))):
                i, j = np.searchsorted(column, (c, c + width))
                m = np.zeros((rows, width), np.float32)
                m[owner[i:j], column[i:j] - c] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
    both = both.astype(np.int64)
    return 100 * both >= 80 * (nx[:, None] + ny[None, :] - both)


def _degrees(links: DataFrame, comps: DataFrame, whole: DataFrame) -> DataFrame:
    """Stored (sig, n_links): how many other sets each set of ``comps`` (sig, component) links with; ``links`` may be some of the links only."""
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    known = links.join(comps.withColumnRenamed("sig", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("known"))
    sizes = stored(sizes.join(known, "component"), "sizes")
    full = F.col("known") * 2 == F.col("m") * (F.col("m") - 1)
    closed = comps.join(sizes.where(full), "component").select("sig", (F.col("m") - 1).alias("n_links"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = comps.join(sizes.where(~full).select("component", blocks.alias("blocks")), "component")
    members = members.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.join(whole, "sig").groupBy("component", "blocks", "block").agg(F.collect_list(F.struct("sig", "shingles")).alias("x"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                x, y = x.values, y.values if y.is_valid else None
                sides = [x] if y is None else [x, y]
                sets = [[v.as_buffer() for v in z.field("shingles")] for z in sides]
                ok = linked_sets(sets[0], sets[-1])
                n = [ok.sum(1) - 1] if y is None else [ok.sum(1), ok.sum(0)]
                yield pa.RecordBatch.from_pydict({"sig": pa.concat_arrays([z.field("sig") for z in sides]), "n": pa.array(np.concatenate(n).astype(np.int64))})

    nothing = F.lit(None).cast("array<struct<sig: bigint, shingles: binary>>")
    within = gathered(members.where("blocks = 1")).select("x", nothing.alias("y")).mapInArrow(count, "sig long, n long")
    many = stored(gathered(members.where("blocks > 1")), "blocks")
    # The narrow numbers of block pairs first, then the sets of either side.
    pairs = many.select("component", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.join(many.select("component", "block", "x"), ["component", "block"]).join(many.select("component", F.col("block").alias("other"), F.col("x").alias("y")), ["component", "other"])
    between = pairs.select("x", F.when(F.col("block") < F.col("other"), F.col("y")).alias("y")).mapInArrow(count, "sig long, n long")
    out = stored(closed.union(within.union(between).groupBy("sig").agg(F.sum("n").alias("n_links"))), "degrees")
    discard(comps.sparkSession, sizes, many)
    return out


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each row of df.

    n_links counts the classes (texts with another set) that link with the row's
    class.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("row_text"))
    rows, sketch = _scan(texts)
    rows_only = rows.where("block IS NULL")
    verifier = Verifier(texts, rows_only)
    lists = _lists(texts, sketch)
    done = [stored(_pivot_pairs(lists).distinct(), "pairs")]
    found = [verifier.links(done[0])]

    def settle(pairs: DataFrame) -> bool:
        """Verify what has not been verified before; whether that found links."""
        for old in done:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        done.append(stored(pairs, "pairs"))
        if done[-1].isEmpty():
            return False
        found.append(verifier.links(done[-1]))
        return not found[-1].isEmpty()

    def joined() -> DataFrame:
        return functools.reduce(DataFrame.union, found)

    comps, final = labels(joined(), most_rounds=3)
    members = _members(lists, comps)
    for number in range(ROUNDS):
        open_pairs, size = _still_open(members)
        if open_pairs <= size or not settle(_probe_pairs(members, number).distinct()):
            break
        old, (comps, final) = (members, comps), labels(joined(), most_rounds=3)
        members = _members(lists, comps)
        discard(spark, *old)
    if settle(_open_pairs(members).distinct()) or not final:
        discard(spark, comps)
        comps, _ = labels(joined())
    comps = comps.withColumnRenamed("node", "sig")
    discard(spark, members, lists, *done)
    links = joined()
    labelled = verifier.classes.select("sig", "rep_id").join(comps, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = labelled.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    degree = _degrees(links, comps, verifier.whole)
    per_class = stored(labelled.join(least, "component").join(degree, "sig", "left").select("sig", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "per-class")
    discard(spark, degree, *found, verifier.classes_table, verifier.sets_table)
    release(spark)
    # Rows without shingles have no class: they must not meet in one key.
    rows_only = rows_only.select("row_id", "n", "sig")
    some = rows_only.where("n > 0").join(per_class, "sig").select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")
    return some.union(rows_only.where("n = 0").select("row_id", "n", "row_id", F.lit(0).cast("long")))
