"""Each stage on small documents against what it promises; the whole against its stages."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import pytest

from .conftest import SMALL
from .test_ngram_join import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # A repeated row, a blank and a null text go through all stages.
    extra = docs.limit(1).union(spark.createDataFrame([(10_000, " ", "en", "s", 1), (10_001, None, None, None, None)], docs.schema))
    out = [corpus_pipeline.stored(docs.union(extra), "start")]
    for name, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(f(spark, out[-1], SMALL), name))
    return [x.collect() for x in out], [x.columns for x in out]


def test_columns(stages):
    assert all(c == stages[1][0] for c in stages[1][:5])


def test_quality_keeps_good_and_rejects_poor(spark, stages):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in x} for x in stages[0][:2])
    assert after <= before
    judged = [(i in after) == bool(label[i]) for i in before if i in label]
    assert sum(judged) / len(judged) > 0.95


def test_exact_copies_go(stages):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")

    before, after = stages[0][1:3]
    least = {}
    for r in before:
        least[norm(r.text)] = min(r.doc_id, least.get(norm(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_near_copies_go(stages):
    before, after = stages[0][2:4]
    comps = brute((r.doc_id, r.text) for r in before)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in comps.values()})


def test_mix_keeps_all_rows(stages):
    before, after = stages[0][3:5]
    assert sorted(before) == sorted(after)


def test_ids_decode_to_the_texts(stages):
    texts = {r.doc_id: r.text or "" for r in stages[0][4]}
    assert {r.doc_id: r.decoded_sha256 for r in stages[0][5]} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert all(len(r.ids) == r.n_tokens for r in stages[0][5])


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, position long, copy_number long, wanted_id long, placed_id long, slot string, doc string, id string, key string, digest string, turn string"


def test_empty_tables_and_clashing_names(spark):
    tail = (7, 9, 1, 2, "s", "d", "i", "k", "g", "t")
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a  text", "en", "x", 1, *tail), (1, "another text", "en", "x", 1, *tail), (2, "a text", "en", "y", 1, *tail), (2, "a text", "en", "y", 1, *tail)]
    rows += [(None, words, "en", None, 1, *tail), (None, words + " end", "en", None, 1, *tail), (None, "none", "en", None, 1, *tail), (3, words + " more", "en", "x", 1, *tail)]
    docs = corpus_pipeline.stored(spark.createDataFrame(rows, CLASHES), "docs")
    exact = corpus_pipeline.stored(corpus_pipeline.drop_copies(spark, docs, SMALL), "exact")
    assert exact.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in exact.collect()) == sorted((i or 0, t) for i, t, *_ in (rows[0], rows[1], *rows[4:]))
    near = corpus_pipeline.stored(corpus_pipeline.drop_near_copies(spark, exact, SMALL), "near")
    assert sorted((r.doc_id or 0, r.text) for r in near.collect()) == sorted([(1, "a  text"), (1, "another text"), (0, "none"), (3, words + " more")])
    mixed = corpus_pipeline.stored(corpus_pipeline.interleave_sources(spark, near, SMALL), "mix")
    assert sorted(map(str, mixed.collect())) == sorted(map(str, near.collect()))
    assert {tuple(r[5:]) for r in mixed.collect()} == {tail}
    assert sorted(r.position for r in corpus_pipeline.encode(spark, mixed, SMALL).collect()) == [0, 1, 2, 3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, SMALL), "empty")
        assert empty.isEmpty()


def test_the_order_of_the_mix_survives_the_reread(spark):
    sources = ["a"] * 700 + ["b"] * 200 + [None] * 100
    rows = [(i, f"text {i}", "en", x, 1) for i, x in enumerate(sources)]
    rows += [(7, "again", "en", "a", 1), (7, "again", "en", "b", 1), (None, "none", "en", "a", 1), (None, "no", "en", "a", 1)]
    docs = corpus_pipeline.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "docs")
    mixed = corpus_pipeline.interleave_sources(spark, docs, SMALL)
    want = [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect()]
    # Another order of files and rows on the way.
    again = corpus_pipeline.stored(mixed.orderBy("text").repartition(5), "mix")
    got = sorted(corpus_pipeline.stored(corpus_pipeline.encode(spark, again, SMALL), "encode").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert [(r.doc_id, r.decoded_sha256) for r in got] == want
