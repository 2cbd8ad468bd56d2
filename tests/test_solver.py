"""The solver of many fits against a plain one, and its parts alone."""

import math

import numpy as np
import pytest

from foliospark.operators import evaluation as E
from foliospark.operators import training as R
from foliospark.operators.solver import lbfgs

WORDS = {"a": "alpha alpine able", "b": "beta blue bold", "c": "cat coin able bold"}
ROWS = [(i, label, " ".join(w for j, w in enumerate((WORDS[label] + " common").split() * 2) if (i * 7 + j * 3) % 5)) for i, label in enumerate("aabcbacbacabbcacbacab" * 3)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([*ROWS, (900, None, "no label here"), (901, "a", None)], "id int, label string, text string").repartition(3)


def minimise(function, start, **settings):
    run = lbfgs(start, **settings)
    point, calls = next(run), 0
    while True:
        calls += 1
        try:
            point = run.send(function(point))
        except StopIteration as end:
            return end.value, calls


def test_lbfgs_finds_the_minimum():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 12))
    h, b = a.T @ a + np.eye(12), rng.normal(size=12)
    found, calls = minimise(lambda x: (0.5 * x @ h @ x - b @ x, h @ x - b), np.zeros(12), tolerance=1e-10)
    assert np.allclose(found, np.linalg.solve(h, b), atol=1e-9) and calls < 80
    assert minimise(lambda x: (0.0, np.zeros(3)), np.ones(3))[1] == 1
    assert minimise(lambda x: (x @ x, 2 * x), np.ones(3), most=0)[1] == 1


def plain_fit(rows, max_features, c, classes):
    """Newton's method on dense vectors of the given training rows."""
    docs = [(label, (text or "").split()) for _, label, text in rows]
    seen = {t for _, words in docs for t in words}
    df = {t: sum(t in words for _, words in docs) for t in seen}
    total = {t: sum(words.count(t) for _, words in docs) for t in seen}
    vocab = sorted(sorted((t for t in seen if 2 <= df[t] <= 0.5 * len(docs)), key=lambda t: (-total[t], t))[:max_features])
    idf = {t: math.log((len(docs) + 1) / (df[t] + 1)) + 1 for t in vocab}
    def vector(words):
        v = np.array([(1 + math.log(words.count(t))) * idf[t] if t in words else 0.0 for t in vocab])
        return np.append(v / np.linalg.norm(v) if v.any() else v, 1.0)
    x, y = np.array([vector(w) for _, w in docs]), np.array([classes.index(label) for label, _ in docs])
    k, d = len(classes), x.shape[1]
    weight = (len(y) / (k * np.bincount(y, minlength=k)))[y]
    theta, keep = np.zeros(k * d), np.tile(np.append(np.ones(d - 1), 0.0), k) / (c * weight.sum())
    for _ in range(60):
        z = x @ theta.reshape(k, d).T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = ((p - np.eye(k)[y]) * weight[:, None] / weight.sum()).T @ x
        h = np.einsum("n,nk,kl,ni,nj->kilj", weight / weight.sum(), p, np.eye(k), x, x) - np.einsum("n,nk,nl,ni,nj->kilj", weight / weight.sum(), p, p, x, x)
        theta = theta - np.linalg.lstsq(h.reshape(k * d, k * d) + np.diag(keep), g.ravel() + keep * theta, rcond=None)[0]
    def proba(words):
        z = theta.reshape(k, d) @ vector(words)
        e = np.exp(z - z.max())
        return e / e.sum()
    return proba


def test_held_out_predictions_equal_plain_fits(samples):
    candidate, classes = R.Candidate(6, 1, 1.0), ["a", "b", "c"]
    folds = {r["id"]: r["fold"] for r in R.stratified_folds(samples.filter("label is not null"), 3).collect()}
    rows = [*ROWS, (901, "a", None)]
    got = {r["id"]: r for r in R.out_of_fold(samples, candidate, k=3, tolerance=1e-11).collect()}
    assert got.keys() == {i for i, _, _ in rows}
    for fold in range(3):
        proba = plain_fit([r for r in rows if folds[r[0]] != fold], 6, 1.0, classes)
        for i, label, text in rows:
            if folds[i] == fold:
                assert np.allclose(got[i]["proba"], proba((text or "").split()), atol=1e-7) and got[i]["y_true"] == label


def test_fits_in_step_equal_fits_alone(samples):
    grid = [R.Candidate(4, 1, 0.1), R.Candidate(50, 2, 10.0), R.Candidate(50, 1, 10.0)]
    together = R.FoldedSamples(samples, 2)
    rows, terms, fits, fitted = together.fit_all(grid, [0, 1], 1e-9)
    assert [f.fold for f in fits] == [0, 1] * 3 and len({f.evaluations for f in fitted}) > 1
    for i, candidate in enumerate(grid):
        alone, own_terms, own_fits, own = together.fit_all([candidate], [0, 1], 1e-9)
        for j in range(2):
            a = dict(zip(terms[rows.terms(fits[2 * i + j].vectors)], fitted[2 * i + j].coef.tolist()))
            b = dict(zip(own_terms[alone.terms(own_fits[j].vectors)], own[j].coef.tolist()))
            assert a.keys() == b.keys() and all(np.allclose(a[t], b[t], atol=1e-5) for t in a)


def test_scores_by_key_equal_scores_alone(spark):
    rows = [(f, "abc"[(i * (f + 1)) % 3], "abc"[(i * i) % 3]) for f in range(3) for i in range(20)]
    preds = spark.createDataFrame(rows, "fit int, y_true string, y_pred string")
    for metric in R.MetricEvaluator.scorers:
        scorer = R.MetricEvaluator(metric, ["a", "b", "c"])
        got = {r["fit"]: r["score"] for r in scorer.by(preds, "fit").collect()}
        assert all(abs(got[f] - scorer.evaluate(preds.filter(f"fit = {f}"))) < 1e-12 for f in range(3))
    assert E.macro_f1(preds, ["a", "b", "c"], ["fit"]).columns == ["fit", "macro_f1"]


def test_no_rows(samples):
    with pytest.raises(ValueError):
        R.out_of_fold(samples.limit(0), R.Candidate(5, 1, 1.0), k=2)
