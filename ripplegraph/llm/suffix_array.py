"""Suffix arrays by induced sorting and permuted common prefixes, vectorised by character buckets.

``suffix_array`` follows the induced-sorting scheme: classify suffixes as
smaller (S) or larger (L) than the next one, sort the leftmost-S substrings by
one round of inducing, name them, sort the named string by the same scheme,
recursively, and induce the whole array from the sorted leftmost-S suffixes in two
scans.  Over bytes a scan visits the character buckets in order; all entries of a
bucket that are known at that point induce their predecessors in one array
operation, and runs of one character go in waves.  Over names, which are many, all
buckets go at once whose entries follow from suffixes that are placed already.
"""

from __future__ import annotations

import numpy as np

SIGMA = 256


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last character must be a unique smallest one."""
    n = len(t)
    new = np.ones(n, bool)
    new[1:] = t[1:] != t[:-1]
    starts = np.flatnonzero(new)
    up = np.ones(len(starts), bool)
    up[:-1] = t[starts[1:]] > t[starts[:-1]]
    return np.repeat(up, np.diff(np.append(starts, n)))


def _spread(sa: np.ndarray, at: np.ndarray, items: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Put items, in order, to the next free places of their characters' buckets."""
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order].astype(np.int64)
    counts = np.bincount(sorted_chars, minlength=SIGMA)
    begins = np.cumsum(counts) - counts
    sa[at[sorted_chars] + step * (np.arange(len(items)) - begins[sorted_chars])] = items[order]
    at += step * counts


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix order that follows from the leftmost-S positions in the given order."""
    n = len(t)
    counts = np.bincount(t, minlength=SIGMA)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = np.full(n, -1, np.int64)
    lms_counts = np.bincount(t[lms], minlength=SIGMA)
    lms_sorted = lms[np.argsort(t[lms], kind="stable")]
    lms_begins = np.cumsum(lms_counts) - lms_counts
    used = np.flatnonzero(counts)
    # Larger suffixes, from the smallest bucket on.
    at = heads.copy()
    for c in used.tolist():
        done = heads[c]
        while True:
            front = sa[done : at[c]] if at[c] > done else None
            if front is None:
                break
            done = at[c]
            before = front[front > 0] - 1
            before = before[~s_type[before]]
            if len(before):
                _spread(sa, at, before, t[before], 1)
        seeds = lms_sorted[lms_begins[c] : lms_begins[c] + lms_counts[c]]
        before = seeds[seeds > 0] - 1
        before = before[~s_type[before]]
        if len(before):
            _spread(sa, at, before, t[before], 1)
    larger = at.copy()
    # Smaller suffixes, from the largest bucket back.
    at = tails - 1
    for c in used[::-1].tolist():
        done = tails[c] - 1
        while at[c] < done:
            front = sa[at[c] + 1 : done + 1][::-1]
            done = int(at[c])
            before = front[front > 0] - 1
            before = before[s_type[before]]
            if len(before):
                _spread(sa, at, before, t[before], -1)
        front = sa[heads[c] : larger[c]][::-1]
        before = front[front > 0] - 1
        before = before[s_type[before]]
        if len(before):
            _spread(sa, at, before, t[before], -1)
    sa[0] = n - 1
    return sa


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(begins - (ends - counts), counts)


def _settle(t: np.ndarray, wanted: np.ndarray, place: np.ndarray, free: np.ndarray, turn: np.ndarray, after: np.ndarray) -> None:
    """Give the wanted suffixes, all of one type, their places from free[character] on.

    Within a bucket they go by the length of their run and the place of the suffix
    after the run.  A bucket is ready when the wanted ones among those are placed;
    all buckets that are ready go at once.
    """
    items = np.flatnonzero(wanted)
    items = items[np.argsort(t[items], kind="stable")]
    counts = np.bincount(t[items], minlength=len(free))
    begins = np.cumsum(counts) - counts
    last = items[t[items + 1] != t[items]]
    waits = np.bincount(t[last[wanted[last + 1]]], minlength=len(free))
    ready = np.flatnonzero((counts > 0) & (waits == 0))
    while len(ready):
        i = items[_ranges(begins[ready], counts[ready])]
        i = i[np.lexsort((place[after[i]], turn[i], t[i]))]
        place[i] = _ranges(free[ready], counts[ready])
        before = i[i > 0] - 1
        before = before[wanted[before] & (t[before] != t[before + 1])]
        chars, less = np.unique(t[before], return_counts=True)
        waits[chars] -= less
        ready = chars[waits[chars] == 0]


def induce_wide(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """``induce`` for strings of names: many small buckets, taken together as soon as what they follow from is placed."""
    n = len(t)
    counts = np.bincount(t)
    heads = np.cumsum(counts) - counts
    begins_s = heads + np.bincount(t[~s_type], minlength=len(counts))
    ends = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    end = ends[np.searchsorted(ends, np.arange(n))]
    after, turn = np.minimum(end + 1, n - 1), end - np.arange(n) + 1
    place = np.zeros(n, np.int64)
    seeds = lms[np.argsort(t[lms], kind="stable")]
    seed_counts = np.bincount(t[lms], minlength=len(counts))
    place[seeds] = _ranges(begins_s, seed_counts)
    _settle(t, ~s_type, place, heads, turn, after)
    smaller = s_type.copy()
    smaller[-1] = False
    place[-1] = 0
    _settle(t, smaller, place, begins_s, -turn, after)
    sa = np.empty(n, np.int64)
    sa[place] = np.arange(n)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of uint8 characters, or of names (int64, from 0 on); the last must be a unique smallest one."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    by_order = induce if t.dtype == np.uint8 else induce_wide
    s_type = classify(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) < 2:
        return by_order(t, s_type, lms)
    induced = by_order(t, s_type, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = induced[is_lms[induced]]
    # Equal substrings get one name: the same length and the same characters to the next leftmost-S position.
    nth = np.cumsum(is_lms) - 1
    ends = np.append(lms[1:] + 1, n)[nth[by_substring]]
    same = np.zeros(len(lms), bool)
    size = ends - by_substring
    same[1:] = size[1:] == size[:-1]
    live, d = np.flatnonzero(same), 0
    while len(live):
        inside = d < size[live]
        a, b = by_substring[live[inside]] + d, by_substring[live[inside] - 1] + d
        differs = t[a] != t[b]
        same[live[inside][differs]] = False
        live, d = live[inside][~differs], d + 1
    name_of = np.cumsum(~same) - 1
    names = np.empty(len(lms), np.int64)
    names[nth[by_substring]] = name_of
    ordered = by_substring if name_of[-1] == len(lms) - 1 else lms[suffix_array(names)]
    return by_order(t, s_type, ordered)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, anchors: np.ndarray, cap: int) -> np.ndarray:
    """In text order, the common prefix of each suffix with the one before it in the array, exact below a cap.

    A value only needs comparing where the characters in front differ (or at an
    anchor); elsewhere it is one less than its left neighbour's.  Values are
    right, or at least cap minus the distance to the last anchor.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = sa[0]
    compare = np.ones(n, bool)
    compare[1:] = (t[:-1] != t[phi[1:] - 1]) | (phi[1:] == 0)
    compare[anchors] = True
    compare[sa[0]] = True
    at = np.flatnonzero(compare)
    words = -(-cap // 8)
    padded = np.concatenate([t, np.zeros(8 * words + 8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), np.uint64, padded.data, 0, (1,))
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(phi[at] != at)
    for w in range(words):
        x = eight[at[live] + 8 * w] ^ eight[phi[at[live]] + 8 * w]
        equal = x == 0
        low = x[~equal] & (~x[~equal] + np.uint64(1))
        value[live[~equal]] = 8 * w + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[equal]
    value[live] = 8 * words
    last = np.cumsum(compare) - 1
    return np.maximum(value[last] - (np.arange(n) - at[last]), 0)
