"""The closing sweep's maps: long unrelated texts make no candidate rows, similar ones of any size always pass."""

import numpy as np
import pytest

from foliospark.llm import near_dup


def random_set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))


@pytest.mark.parametrize("n", [1, 100, 1_000, 3_500, 20_000])
def test_maps_rule_out_unrelated_sets_and_never_a_link(n):
    rng = np.random.default_rng(n)
    for other in (n, max(1, int(n * 0.85)), int(n * 1.2)):
        a = random_set(rng, n)
        kept = a[: min(len(a), other)]
        b = np.unique(np.concatenate([kept, random_set(rng, max(0, other - len(kept)))]))
        for x, y, alike in ((a, b, len(np.intersect1d(a, b)) * 100 >= 80 * len(np.union1d(a, b))), (a, random_set(rng, other), False)):
            m, o = (np.frombuffer(near_dup.bitmap(z), np.uint64) for z in (x, y))
            m, o = (near_dup.folded(m), o) if len(m) > len(o) else (m, near_dup.folded(o)) if len(o) > len(m) else (m, o)
            assert len(m) == len(o)
            most = min(len(x) - int(np.bitwise_count(m & ~o).sum()), len(y) - int(np.bitwise_count(o & ~m).sum()))
            passes = 100 * most >= 80 * (len(x) + len(y) - most)
            assert passes if alike else not passes or n == 1


def test_a_family_of_long_unrelated_texts_makes_no_pairs(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(3_000)])
    rows = [(i, " ".join(rng.choice(words, 5_000))) for i in range(160)] + [(500, " ".join(words)), (501, " ".join(words[:-20]))]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    nodes = texts.select("id")
    edges = spark.createDataFrame([(0, i) for i, _ in rows[1:]], "a bigint, b bigint")  # everything in one family
    parts = spark.createDataFrame([], "node bigint, root bigint")
    got = near_dup.sweep(edges, nodes, parts, texts, 2, 80).collect()
    assert {tuple(sorted(r)) for r in got} == {(500, 501)}
