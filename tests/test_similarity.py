"""Near copies over a corpus against all pairs, and the number of comparisons it takes; joins with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions.joins import salted_join
from foliospark.operators import similarity


def plain(rows, percent=85):
    sets = {}
    for i, (label, text) in enumerate(rows):
        words = frozenset(w for w in (text or "").lower().split() if len(w) > 2 and not w.isdigit())
        if words:
            sets.setdefault(label or "", []).append(words)
    out = {}
    for label, own in sets.items():
        near = sum(any(i != j and 100 * len(a & b) > percent * len(a | b) for j, b in enumerate(own)) for i, a in enumerate(own))
        out[label] = (len(own), sum(own.count(a) > 1 for a in own), near)
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    for label in ("a", "b", None):
        for _ in range(25):
            base = list(rng.choice(words, rng.integers(1, 40), replace=False))
            for _ in range(rng.integers(1, 4)):
                changed = [w if rng.random() > 0.07 else str(rng.choice(words)) for w in base]
                rows.append((label, " ".join(rng.permutation(changed))))
    return rows + [("a", None), ("a", ""), ("a", "12 ab"), ("b", "one"), ("b", "one"), ("c", "alone here")]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_as_all_pairs(spark, rounds):
    rows = corpus(rounds)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, label string, text string").withColumns({c: F.lit(1) for c in ("rep", "copies", "tokens", "head")})
    got = {r["label"]: (r["texts"], r["with_copy"], r["near_copies"]) for r in similarity.near_copies(df, rounds=rounds).collect()}
    assert got == plain(rows)
    assert similarity.near_copies(df.limit(0), rounds=rounds).count() == 0


def test_a_family_takes_few_comparisons(spark, monkeypatch):
    """600 near copies of one text, and 200 texts that share half of their tokens with it."""
    shared = [f"common{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    rows = [("x", " ".join([*shared, f"own{chr(97 + i // 26)}{chr(97 + i % 26)}"])) for i in range(600)]
    rng = np.random.default_rng(0)
    rows += [("x", " ".join([*shared[:50], *("noise" + "".join(rng.choice(list("abcdef"), 8)) for _ in range(50))])) for _ in range(200)]
    counts, written = [], similarity.materialize
    def watched(df, purpose):
        out = written(df, purpose)
        counts.append(out.count() if purpose == "similarity-pairs" else 0)
        return out
    monkeypatch.setattr(similarity, "materialize", watched)
    got = similarity.near_copies(spark.createDataFrame(rows, "label string, text string")).collect()
    assert [(r["texts"], r["with_copy"], r["near_copies"]) for r in got] == [(800, 0, 600)]
    assert sum(counts) < 30 * 800  # all pairs of the family alone are 180,000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_as_a_join(spark, how):
    rows = spark.range(4_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    rules = spark.range(0, 40).select(F.col("id").alias("k"), F.concat(F.lit("r"), "id").alias("v"))
    got = salted_join(rows, rules, ["k"], F.col("id"), how, share=10, least=100)
    plan = got._jdf.queryExecution().toString()
    assert "_salt" in plan and sorted(got.collect()) == sorted(rows.join(rules, ["k"], how).collect())
    assert "_salt" not in salted_join(rows, rules, ["k"], F.col("id"), how)._jdf.queryExecution().toString()
