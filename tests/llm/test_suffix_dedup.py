"""Suffix arrays and repeat removal against plain sorting and a table of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplegraph.llm import suffix_array, suffix_dedup
from ripplegraph.llm.queries import queries

from .conftest import DOCS, SMALL


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 6).flatmap(lambda k: st.lists(st.integers(1, k), max_size=80)))
def test_suffix_array_and_prefixes(chars):
    b = bytes(chars) + b"\0"
    t = np.frombuffer(b, np.uint8)
    sa = suffix_array.suffix_array(t)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    prefix = suffix_array.permuted_prefixes(t, sa, np.array([0]), 96)
    for k in range(1, len(b)):
        x, y = b[sa[k] :], b[sa[k - 1] :]
        common = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
        assert prefix[sa[k]] == common


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda k: st.lists(st.integers(1, k), max_size=120)))
def test_suffix_array_of_names(chars):
    """Wide alphabets, as the recursion meets them: dense names, runs, long descents."""
    kinds = {c: k for k, c in enumerate(sorted(set(chars)), 1)}
    names = [kinds[c] for c in chars] + [0]
    t = np.array(names, np.int64)
    assert suffix_array.suffix_array(t).tolist() == sorted(range(len(names)), key=lambda i: names[i:])
    down = np.arange(len(chars) + 1)[::-1].copy()
    assert suffix_array.suffix_array(down).tolist() == down.tolist()


def test_array_recurs_by_induced_sorting(monkeypatch):
    """Repeats that leftmost-S substrings don't tell apart are sorted by inducing the string of names, level by level."""
    levels = []
    inner = suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda t: (levels.append(len(t)), inner(t))[1])
    rng = random.Random(3)
    part = bytes(rng.choice(b"abc") for _ in range(600))
    b = (part + b"x") * 5 + b"\0"
    t = np.frombuffer(b, np.uint8)
    assert suffix_array.suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    assert len(levels) >= 3
    assert all(2 * x <= y for x, y in zip(levels[1:], levels, strict=False))


def brute(rows, length=100):
    """{id: (bytes, removed, spans, digest)}: every window in order of (id, place)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def result(df):
    rows = suffix_dedup.remove_repeats(df).collect()
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abc é") for _ in range(n))

    passages = [noise(rng.randrange(90, 400)) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = [rng.choice(passages)[rng.randrange(40) :] if rng.random() < 0.6 else noise(rng.randrange(150)) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    texts += ["x" * 99, "x" * 100, "y" * 101, "ab" * 400, "z" * 1000, "\x00\x01" * 120, passages[0], passages[0], passages[1] + passages[1], noise(9000) + passages[2], "", None, "x" * 100, "q" * 2000 + passages[3]]
    rng.shuffle(texts)
    df = spark.createDataFrame([(7 * i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(6)
    assert result(df) == brute([(7 * i, t) for i, t in enumerate(texts)])


def test_small_documents(spark, small_docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op3_suffix_dedup"](spark, SMALL).collect()}
    assert got == brute((r.doc_id, r.text) for r in small_docs.collect())


def test_odd_rows(odd_docs, no_docs):
    rows = suffix_dedup.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = brute({r.doc_id: r.text for r in odd_docs.where("doc_id IS NOT NULL").collect()}.items())
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id]
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
