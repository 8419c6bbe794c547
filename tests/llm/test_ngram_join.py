"""The Jaccard join against an inverted index over whole sets."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from ripplegraph.llm import components, ngram_join
from ripplegraph.llm.queries import queries

from .conftest import DOCS, SMALL


def brute(rows):
    """{id: (set size, smallest linked id)}; ids are distinct."""
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                shared[j] += 1
            index[s].append(i)
        for j, c in shared.items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect()}


def near_copies(rng, words=60, copies=40, edits=6):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(t[: len(t) - rng.randrange(4)]))
    return out


def thue_morse(n):
    """A word of n letters and its complement, which sums of powers modulo 2**64 can't tell apart from 1,024 letters on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [256, 1024, 2048, 4096])
def test_words_that_differ_have_different_shingles(n):
    import numpy as np

    texts = [f"one two {w} four five".encode() for w in thue_morse(n)]
    h, at = ngram_join.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), 2 * len(texts[0])]))
    assert list(at) == [0, 1, 2] and h[0] != h[1]


def test_profiles_bound_the_intersection():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = []
    for n in (0, 1, 3, 4, 9, 40, 41, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        sets += [x, np.unique(np.concatenate([x[: len(x) * 9 // 10], rng.integers(0, 1 << 63, len(x) // 10, np.uint64)]))]
    sets.append(np.arange(1000, dtype=np.uint64))  # all in one range
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    made = [np.frombuffer(v.as_buffer(), np.uint8) for v in ngram_join.profiles(np.concatenate(sets), at)]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert ngram_join.most_common(made[i], made[j]) >= len(np.intersect1d(x, y))
    assert ngram_join.most_common(made[10], made[12]) < 36  # unlike sets of 40 and 41 are told apart


@pytest.mark.parametrize("list_rows", [1024, 4])
def test_equals_brute_force_on_near_copies(spark, monkeypatch, list_rows):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", list_rows)
    rng = random.Random(list_rows)
    texts = [t for _ in range(6) for t in near_copies(rng)] + ["a b c", "A  b\tc", "a b", "", None, "one two three four five six"]
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(rng.randrange(12)))}" for _ in range(60)]
    texts += [f"one two {w} four five" for w in thue_morse(1024)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(5)
    assert result(df) == brute(enumerate(texts))


def test_small_documents(spark, small_docs):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op7_ngram_join"](spark, SMALL).collect()} == brute((r.doc_id, r.text) for r in small_docs.collect())


def test_odd_rows(odd_docs, no_docs):
    rows = ngram_join.link_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = brute({r.doc_id: r.text for r in odd_docs.where("doc_id IS NOT NULL").collect()}.items())
    for r in rows:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id) == (1, 5)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert ngram_join.link_components(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 60)] + [(3, 7), (3, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 3 for k in [3, 7, *range(20, 60)]}


def test_packed_sets_round_trip():
    import numpy as np

    x = np.array([0, 1, 2**32, 2**48 - 1], np.uint64)
    assert (ngram_join.unpacked(ngram_join.packed(x)) == x).all()


def brute_links(rows):
    """{id: number of other distinct sets that link with its set}."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    kinds = list(set(sets.values()) - {frozenset()})
    n = {s: sum(s is not o and 100 * len(s & o) >= 80 * len(s | o) for o in kinds) for s in kinds}
    return {i: n.get(s, 0) for i, s in sets.items()}


@pytest.mark.parametrize(("list_rows", "block", "columns"), [(1024, 256, 4096), (4, 7, 50)])
def test_links_of_near_copies_are_all_counted(spark, monkeypatch, list_rows, block, columns):
    for name, value in (("LIST_ROWS", list_rows), ("BLOCK", block), ("COLUMNS", columns)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(3)
    texts = [t for _ in range(3) for t in near_copies(rng)] + near_copies(rng, copies=2, edits=2) + ["a b c", "A b c", "", None]
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(5)
    want = brute_links(enumerate(texts))
    assert max(want.values()) > 5
    assert {r.doc_id: r.n_links for r in ngram_join.link_components(df).collect()} == want
