"""Nearest vectors of a table with several lengths: every query is answered, by vectors of its own length."""

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import ann


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(6)
    table = [(i, rng.normal(size=2 + (i % 3 == 0) + 3 * (i % 7 == 0)).tolist()) for i in range(400)] + [(40, [1.0, 2.0, 3.0]), (1000, [5.0] * 9)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(table, "vec_id bigint, vec array<double>"), F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = {i for i, _ in table if i % 20 == 0}
    hits = whole = 0
    for q in asked:
        scores = {}
        for own in (v for i, v in table if i == q):
            for i, v in table:
                if i != q and len(v) == len(own):
                    scores[i] = max(scores.get(i, -np.inf), float(np.dot(own, v)))
        want = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        found = sorted(got.get(q, []))
        assert len(found) == len(want) and all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        hits, whole = hits + len({i for _, i, _ in found} & set(want)), whole + len(want)
    assert set(got) == asked - {1000} and hits >= 0.95 * whole


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 64 * 8 * 100)
    rng = np.random.default_rng(7)
    table = [(i, rng.normal(size=64).tolist()) for i in range(500)]
    sizes, build = [], ann.balanced_leaves
    monkeypatch.setattr(ann, "balanced_leaves", lambda points, leaf, seed=5: sizes.append(len(points)) or build(points, leaf, seed))
    assert ann.nearest(spark.createDataFrame(table, "vec_id bigint, vec array<double>"), F.col("vec_id") == 20, k=5).count() == 5
    assert 0 < sizes[0] <= 200
