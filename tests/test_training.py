"""Features, fit and scoring against brute force on a small fixture."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.operators import evaluation as E
from foliospark.operators import features as X
from foliospark.operators import scoring as S
from foliospark.operators import training as R

WORDS = {"contract": "party agreement shall term", "invoice": "invoice due amount net", "receipt": "cash change store total"}
ROWS = [(f"{label}{i}", label, " ".join([WORDS[label]] * (1 + i % 3)) + f" common words number{i % 4} and more text here")
        for label in WORDS for i in range(8)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(ROWS, "id string, label string, text string").cache()


@pytest.fixture(scope="module")
def model(samples):
    return R.fit_classifier(samples, R.Candidate(50, 2, 1.0))


def brute_weights(max_features):
    docs = {}
    for i, _, text in ROWS:
        t = re.findall(r"\w\w+", text.lower())
        docs[i] = Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
    df, total = Counter(), Counter()
    for c in docs.values():
        df.update(c.keys())
        total.update(c)
    kept = [t for t in df if 2 <= df[t] <= 0.5 * len(docs)]
    vocab = sorted(kept, key=lambda t: (-total[t], t))[:max_features]
    out = {}
    for i, c in docs.items():
        w = {t: (1 + math.log(c[t])) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocab if t in c}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return out


def test_tfidf_equals_brute_force(samples):
    counted = X.with_term_counts(samples)
    vocab = X.vocabulary(X.document_frequency(X.term_rows(counted), len(ROWS)), len(ROWS), 30)
    got = {(r["id"], r["term"]): r["weight"] for r in X.tfidf_weights(counted.drop("label"), vocab).collect()}
    want = brute_weights(30)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fit_separates_and_gates(spark, samples, model):
    truth = {i: label for i, label, _ in ROWS}
    rows = S.classify(samples, model, threshold=0.0).collect()
    assert all(truth[r["id"]] == r["doc_type"] for r in rows) and len(rows) == len(ROWS)
    odd = spark.createDataFrame([("short", "invoice due"), ("strange", "zq " * 12), ("none", None)], "id string, text string")
    assert {(r["doc_type"], r["confidence"]) for r in S.classify(odd, model).collect()} == {("unknown", 0.0)}
    assert all(r["doc_type"] == "unknown" for r in S.classify(samples, model, threshold=1.01).collect())


def test_scores_equal_softmax_by_hand(samples, model):
    coef = {r["term"]: (r["idf"], r["coef"]) for r in model.terms.collect()}
    got = {r["id"]: r["proba"] for r in S.predict_proba(S.vectorize(samples, model), model).collect()}
    for i, _, text in ROWS:
        t = re.findall(r"\w\w+", text.lower())
        c = Counter(x for x in t + [f"{a} {b}" for a, b in zip(t, t[1:])] if x in coef)
        w = {x: (1 + math.log(n)) * coef[x][0] for x, n in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        m = [b + sum(v / norm * coef[x][1][k] for x, v in w.items()) for k, b in enumerate(model.intercepts)]
        e = [math.exp(v - max(m)) for v in m]
        assert all(abs(a - b / sum(e)) < 1e-9 for a, b in zip(got[i], e))


def test_model_round_trip(spark, samples, model, tmp_path):
    S.save_model(model, str(tmp_path / "m"))
    again = S.load_model(spark, str(tmp_path / "m"))
    assert again.classes == model.classes
    key = lambda r: (r["id"], r["doc_type"], round(r["confidence"], 9))
    assert sorted(map(key, S.classify(samples, again).collect())) == sorted(map(key, S.classify(samples, model).collect()))


def test_folds_and_out_of_fold(samples):
    sizes = R.stratified_folds(samples, 4).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in sizes} == {2} and len(sizes) == 12
    preds = R.out_of_fold(samples, R.Candidate(50, 1, 10.0), k=2)
    assert preds.count() == len(ROWS)
    assert E.accuracy(preds).first()[0] > 0.9


def test_grid_search(samples):
    grid = [R.Candidate(50, 1, 0.1), R.Candidate(50, 1, 10.0)]
    scores, best = R.grid_search(samples, grid, k=2)
    rows = R.grid_results(scores).collect()
    assert len(rows) == 2 and best in grid
    assert max(r["cv_f1_mean"] for r in rows) == [r for r in rows if r["c"] == best.c][0]["cv_f1_mean"]
    assert len(R.full_grid()) == 12


def test_sample_fraction_is_exact(samples):
    assert R.sample_fraction(samples, 0.3).count() == int(len(ROWS) * 0.3)


def test_manifest(spark, samples):
    metrics = spark.createDataFrame([("accuracy", 0.5)], "metric string, value double")
    r = R.training_manifest(spark, samples, R.Candidate(), metrics).first()
    assert r["n_samples"] == len(ROWS) and r["metrics"] == {"accuracy": 0.5} and len(r["data_md5"]) == 32
    assert r["data_md5"] == R.dataset_fingerprint(samples.repartition(7), ["id", "label", "text"]).first()["fingerprint"]


def test_curves_do_not_depend_on_bucket_depth(spark):
    rows = [(i, "a" if i % 3 else "b", "a", [((i * 37) % 101) / 100.0, 1 - ((i * 37) % 101) / 100.0]) for i in range(500)]
    preds = spark.createDataFrame(rows, "id int, y_true string, y_pred string, proba array<double>")
    auc = {r["class"]: r["auc"] for r in E.roc_auc_ovr(preds, ["a", "b"]).collect()}
    pos = [r[3][0] for r in rows if r[1] == "a"]
    neg = [r[3][0] for r in rows if r[1] == "b"]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc["a"] - want) < 1e-12
    assert E.confusion_matrix(preds, ["a", "b"]).agg(F.sum("n")).first()[0] == 500


class _Asked(Exception):
    pass


@pytest.mark.parametrize("name,operator,folded", [
    ("grid_results", "grid_search", True), ("manifest", "grid_search", True), ("manifest", "out_of_fold", True), ("oof_predictions", "out_of_fold", True),
    ("fitted_classes", "fit_classifier", False), ("fit_optimality", "optimality", False)])
def test_registered_fits_are_the_whole_job(spark, monkeypatch, name, operator, folded):
    """Twelve candidates, five folds, bigrams; the manifest reports the candidate that the search found."""
    import inspect

    from conftest import SF
    from foliospark.plans import queries_training as Q
    real, best = inspect.signature(getattr(R, operator)), R.Candidate(10000, 2, 10.0)

    def asked(*args, **kwargs):
        call = real.bind(*args, **kwargs)
        call.apply_defaults()
        raise _Asked(call.arguments)

    if (name, operator) == ("manifest", "out_of_fold"):
        monkeypatch.setattr(R, "grid_search", lambda *a, **b: (None, best))
    monkeypatch.setattr(R, operator, asked)
    with pytest.raises(_Asked) as caught:
        getattr(Q, name)(spark, SF)
    arguments = caught.value.args[0]
    assert not folded or arguments["k"] == R.FOLDS == 5
    if operator == "grid_search":
        assert arguments["candidates"] == R.full_grid() and len(R.full_grid()) == 12
    else:
        assert arguments["candidate"] == (best if name == "manifest" else R.Candidate()) and arguments["candidate"].max_n == 2
