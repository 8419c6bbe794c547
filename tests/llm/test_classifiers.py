"""Quality and toxicity: held-out accuracy, the lattice decoder against all paths, odd input."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from ripplegraph.llm import quality_knn, toxicity
from ripplegraph.llm.queries import queries

MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least"), [("op4_quality_knn", "quality", 3, 1, 0.95), ("op8_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, folds, fold, least):
    rows = {r.doc_id: r for r in queries()[name](spark, MID).collect()}
    assert len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == fold) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    known = [(rows[r.doc_id].predicted, r[label]) for r in spark.read.parquet(f"{MID}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(p == y for p, y in known) / len(known) >= least


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(6, 1, 0), (5, 0, 1), (9, 1, 0), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int")
    for m, label in ((quality_knn, "quality"), (toxicity, "toxic")):
        model = m.fit(odd_docs, labels, label)
        rows = m.score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count()
        by_id = {}
        for r in rows:
            assert 0 <= r.score <= 1 and abs(by_id.setdefault(r.doc_id, r.score) - r.score) < 1e-4
        assert abs(by_id[0] - by_id[1]) < 1e-4
        none = m.fit(odd_docs, labels.limit(0), label)
        assert {r.score for r in m.score(odd_docs, none).collect()} == {0.5}
        assert m.score(no_docs, model).count() == 0
    kept = quality_knn.keep(odd_docs, quality_knn.fit(odd_docs, labels))
    assert kept.schema == odd_docs.schema and kept.count() <= odd_docs.count()


def test_vote_equals_plain_sum():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = quality_knn.KnnModel(np.ones(1), np.ones((1, 1)), v, rng.integers(0, 2, 60).astype(float), 7)
    got = m.vote(v[:10], block=4)
    for x, s in zip(v[:10], got, strict=True):
        sim = v @ x
        near = np.argsort(-sim)[:7]
        w = np.maximum(sim[near], 1e-6).astype(float) ** quality_knn.SHARPNESS
        assert abs(s - (w * m.labels[near]).sum() / w.sum()) < 1e-6


def test_ties_fall_to_the_smaller_position():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sim = rng.integers(0, 4, (6, 30)).astype(np.float32)
        got = quality_knn.nearest(sim, 7)
        assert (np.sort(got, 1) == np.sort(np.argsort(-sim, axis=1, kind="stable")[:, :7], 1)).all()


def test_repeated_labelled_rows_count_once(spark):
    texts = [(i, f"you {'idiot moron' if i % 2 else 'friend neighbour'} number{i} of all", i % 2) for i in range(60)]
    labels = spark.createDataFrame([(i, y, y) for i, _, y in texts], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    for m, label in ((toxicity, "toxic"), (quality_knn, "quality")):
        want = {r.doc_id: r.score for r in m.score(plain, m.fit(plain, labels, label)).collect()}
        for times in (2, 3, 1000):
            again = plain.union(spark.createDataFrame([texts[1][:2], texts[3][:2]] * (times - 1), plain.schema))
            got = {r.doc_id: r.score for r in m.score(plain, m.fit(again, labels, label)).collect()}
            assert max(abs(got[i] - want[i]) for i in want) < 1e-3
        assert label != "toxic" or (want[1] > 0.5 > want[0])


@pytest.fixture(scope="module")
def channel(spark):
    return toxicity.Channel(toxicity.letter_trigrams(spark.createDataFrame([("the idiot and the moron hit a stupid idiot " * 50,)], "text string")))


def test_trigram_counts_cover_all_texts(spark):
    counts = toxicity.letter_trigrams(spark.createDataFrame([("ab",), (None,), ("ab c",)], "text string")).reshape((toxicity.LETTERS,) * 3)
    assert counts[0, 0, 1] == 2 and counts[0, 1, 2] == 2 and counts[1, 2, 0] == 2 and counts[2, 0, 3] == 1


@pytest.mark.parametrize("token", ["1d10t", "m0r0n", "stuuupid", "i.d.i.o.t", "@nd", "5tupid", "h1t"])
def test_viterbi_equals_all_paths(channel, token):
    edges = channel.lattice(token)

    def paths(i):
        if i == len(token):
            yield "", 0.0
            return
        for step, letters, price in edges[i]:
            for rest, cost in paths(i + step):
                yield letters + rest, price + cost

    def total(letters, price):
        codes = [0, 0, *map(toxicity._code, letters), 0]
        return price + sum(channel.cost[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    best = min(itertools.starmap(lambda s, p: (total(s, p), s), paths(0)))
    got = channel.restored(token)
    assert abs(total(got, min(p for s, p in paths(0) if s == got)) - best[0]) < 1e-9


def test_restores_traced_words_only(channel):
    assert channel.restore("an 1d10t and m.o.r.o.n hit") == "an idiot and moron hit"
    for clean in ("hello, world! 2024 a b", "x1 = y2; 100% ok", "", "the the"):
        assert channel.restore(clean) == clean


def test_restores_long_tokens_ends_and_several_words(channel):
    assert channel.restore("an assh0l3, 1di07 and stup1d 1d107!") == "an asshole, idiot and stupid idiot!"
    assert len(channel.restore("stu" + "u" * 70 + "pid")) < 10
    assert channel.restore("st" + "u" * 5000 + "pid idiot") == "stupid idiot"
    assert channel.restore("t h e i d i o t") == "the idiot"
    restored = channel.restore(" ".join("theidiotandthemoronhitastupididiot" * 40))
    assert restored.replace(" ", "") == "theidiotandthemoronhitastupididiot" * 40
    assert restored.split().count("idiot") > 40
