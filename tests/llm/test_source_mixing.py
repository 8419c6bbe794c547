"""Pfair mixing against its own promises: whole, dense and close to the shares."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplegraph.llm import source_mixing as M
from ripplegraph.llm.queries import queries

from .conftest import SMALL


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 40), min_size=1))
def test_frame_keeps_every_source_within_a_block(parts):
    frame, seen = sum(parts.values()), Counter()
    order = M.frame_schedule(parts)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] * frame - a * t) < frame for x, a in parts.items())
    assert seen == parts


def brute(counts, parts, block_rows):
    """Slot by slot with running counts; a source that ends restarts the frame of the others."""
    left = {s: -(-n // block_rows) for s, n in counts.items() if n}
    out, done = [], Counter()
    while left:
        phase, t = Counter(), 0
        total = sum(parts[s] for s in left)
        while True:
            ready = [(-(-(phase[s] + 1) * total // parts[s]), s) for s in left if phase[s] * total // parts[s] <= t]
            s = min(ready)[1]
            out.append((s, done[s]))
            phase[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
            if not left[s]:
                del left[s]
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mix_equals_slot_by_slot_schedule(spark, seed):
    rng = random.Random(seed)
    counts = {s: rng.choice([0, 1, 7, 33, 120, 400]) for s in "abcd"}
    weights = {s: rng.randint(1, 9) for s in "abcd"}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = M.mix(df, weights, block_rows=5, bucket_rows=50).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    slots = {r.slot: (r.source, r.block) for r in got}
    assert [slots[k] for k in sorted(slots)] == brute(counts, weights, 5)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.slot] += 1
    assert max(sizes.values(), default=0) <= 5
    order = sorted(got, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in got)


def test_many_sources_are_planned_by_their_blocks():
    """2,000 sources: the plan has rows for the blocks that there are, not for sources x frame."""
    counts = {f"host{i}": 1 + i % 3 for i in range(2000)}
    parts = M.root_parts(counts)
    phases, slots = M.plan_phases(counts, parts, 1)
    blocks = sum(counts.values())
    taken = [(s, first) for _, s, first, end, *_ in phases for first in range(first, end)]
    assert len(taken) == len(set(taken)) == blocks
    assert len(slots) <= 2 * blocks and len(phases) <= blocks


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_slot_by_slot_schedule(seed):
    rng = random.Random(seed)
    counts = {f"s{i}": rng.choice([0, 1, 3, 50, 700]) for i in range(30)}
    parts = {s: rng.randint(1, 40) for s in counts}
    phases, slots = M.plan_phases(counts, parts, 4)
    at = {(p, s, nth): t for p, s, nth, t in slots}
    places = {}
    for p, s, first, end, a, frame, base, _ in phases:
        for block in range(first, end):
            turn = block - first
            places[base + turn // a * frame + at[p, s, turn % a]] = (s, block)
    assert [places[k] for k in sorted(places)] == brute(counts, parts, 4)
    assert sorted(places) == list(range(len(places)))


def test_odd_rows(spark, odd_docs, no_docs):
    got = M.mix(odd_docs).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in odd_docs.select("doc_id", "source").collect())
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert M.mix(no_docs).count() == 0


def test_query_is_whole(spark, small_docs):
    got = queries()["op9_source_mixing"](spark, SMALL).collect()
    assert sorted(r.position for r in got) == list(range(small_docs.count()))
