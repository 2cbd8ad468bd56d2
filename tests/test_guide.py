"""Steps guessed from a few rows, and pairs of words counted by number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import solver
from foliospark.operators import training as R
from test_solver import ROWS


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(ROWS, "id int, label string, text string").repartition(3)


def test_guided_fits_end_at_the_same_optimum(samples, monkeypatch):
    grid = [R.Candidate(50, 2, 10.0), R.Candidate(6, 1, 1.0)]
    folded = R.FoldedSamples(samples, 2)
    _, terms, _, plain = folded.fit_all(grid, [0, 1], 1e-9)
    monkeypatch.setattr(solver, "GUIDE_SHARE", 0)
    for few in (4096, 12):  # all rows, and some of them
        monkeypatch.setattr(solver, "GUIDE_ROWS", few)
        _, again, fits, guided = folded.fit_all(grid, [0, 1], 1e-9)
        assert list(again) == list(terms)
        for a, b in zip(plain, guided):
            assert np.allclose(a.coef, b.coef, atol=1e-5)
            assert np.allclose(a.intercept - a.intercept.mean(), b.intercept - b.intercept.mean(), atol=1e-5)
        if few == 4096:
            assert sum(f.evaluations for f in guided) < sum(f.evaluations for f in plain) / 2


def test_curvature_of_a_few_rows(samples):
    rows, _ = R.FoldedSamples(samples, 2).rows([(0, 20, 2)])
    batch = rows.table.select("y", "fold", "idx", "tf", "norms").toArrow().combine_chunks().to_batches()[0]
    few = solver.FewRows(batch, rows.idf[0], 0, 0, rows.class_weights[0])
    rng = np.random.default_rng(0)
    point, step = rng.normal(size=(2, (few.terms + 1) * few.k))
    few.at(point)
    near = (few.loss(point + 1e-6 * step)[1] - few.loss(point - 1e-6 * step)[1]) / 2e-6
    assert np.allclose(few.curved(step), near, atol=1e-7)
    assert np.allclose(few.diagonal(), [few.curved(e) @ e for e in np.eye(len(point))], atol=1e-12)
    value, slope = solver.evaluated(rows, [solver.Fit(0, 0, 1e300)], [point])[0]
    assert np.isclose(value, few.loss(point)[0]) and np.allclose(slope, few.loss(point)[1])
    _, bias, second = solver.summed(rows, [solver.Fit(0, 0, 1.0)], [point], second=True)
    all_rows = np.append((second[:, 0] * rows.idf[0][:, None]**2).ravel(), bias[0]) / rows.totals[0]
    assert np.allclose(all_rows, few.diagonal())


def test_only_pairs_that_can_be_in_a_vocabulary_are_counted(samples, monkeypatch):
    key = lambda rows: sorted((r["term"], r["n"], r["df_0"], r["total_0"], r["df_1"], r["total_1"]) for r in rows)
    found = R.FoldedSamples(samples, 2).frequencies({(0, 2): 4, (1, 2): 4})
    pairs = key(found.filter("n = 2").collect())
    monkeypatch.setattr(R, "PAIR_WORDS", 0)
    by_text = R.FoldedSamples(samples, 2).frequencies({(0, 2): 4, (1, 2): 4})
    every = key(by_text.filter("n = 2").collect())
    assert set(pairs) < set(every)
    tops = [[tuple(r) for r in R.FoldedSamples._top(folded, frequencies, fold, 2, 4).orderBy(F.desc("total"), "term").collect()]
            for folded, frequencies in ((R.FoldedSamples(samples, 2), found), (R.FoldedSamples(samples, 2), by_text)) for fold in (0, 1)]
    assert tops[:2] == tops[2:] and all(len(t) == 4 for t in tops)
