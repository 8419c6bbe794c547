"""What keeps the driver small: plans of bounded size, one matrix of the labelled rows, freed native memory handed back."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from pyspark.sql import Row

from ripplegraph.llm import components, quality_knn, shared


def test_a_step_of_components_reads_its_links_a_few_times(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    reads = []

    def watched(df, name):
        if name == "stars":
            reads.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return shared.stored(df, name)

    monkeypatch.setattr(components, "stored", watched)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {n: n for p in pairs for n in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert found == {n: c for n, c in least.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert max(reads) <= 4  # twelve, where both steps of a round are one plan


def test_a_release_hands_back_native_memory(spark, monkeypatch):
    said = []
    trim = shared.trim
    monkeypatch.setattr(shared, "trim", lambda session: said.append(trim(session)))
    shared.release(spark)
    assert said and "Trim native heap" in said[0]


def test_the_model_is_learnt_from_one_matrix():
    rng = np.random.default_rng(1)
    n = quality_knn.MOST_LABELLED
    rows = [Row(row_id=int(i), y=float(i % 2), x=rng.random(quality_knn.TERMS).astype(np.float16).tobytes()) for i in rng.permutation(n)]
    matrix, products = 4 * n * quality_knn.TERMS, 8 * quality_knn.TERMS**2
    tracemalloc.start()
    model = quality_knn._learnt(rows, quality_knn.RANK)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < matrix + 2.5 * products  # a second matrix is more than that
    assert model.vectors.shape == (n, quality_knn.RANK)
    assert list(model.labels) == [float(i % 2) for i in range(n)]
