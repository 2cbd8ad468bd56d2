"""Terms of slices of rows: the same sums, matches and weights as of single rows."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.operators import features as X
from foliospark.operators import scoring as S
from foliospark.operators import terms as K

TEXTS = [(1, "a bb cc bb cc bb"), (2, None), (3, ""), (4, "Bb x cc"), (4, "dd bb cc"), (None, "ee"), (None, "bb bb"), (5, "ß9 _z ß9 _z ß9"), (6, "x y z")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, t, n % 3) for n, (i, t) in enumerate(TEXTS)], "id int, text string, fold int")


def terms_of(text, max_n=2):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(words) + (Counter(f"{a} {b}" for a, b in zip(words, words[1:])) if max_n == 2 else Counter())


def test_sums_over_slices_are_those_of_rows(texts):
    for max_n in (1, 2):
        want = Counter()
        for n, (_, text) in enumerate(TEXTS):
            for term, tf in terms_of(text, max_n).items():
                want[term, n % 3, "docs"] += 1
                want[term, n % 3, "tf"] += tf
        rows = X.term_sums(X.with_tokens(texts.select("fold", "text")), max_n, "fold").groupBy("term", "fold").agg(F.sum("docs").alias("docs"), F.sum("tf").alias("tf")).collect()
        assert {(r["term"], r["fold"], c): r[c] for r in rows for c in ("docs", "tf")} == want


def test_few_rows_leave_a_slice_of_like_documents(spark):
    same = spark.createDataFrame([(i, "one two three") for i in range(300)], "id int, text string").coalesce(1)
    assert X.term_sums(X.with_tokens(same)).count() == 5


def test_slices_end_between_rows():
    batch = pa.record_batch([pa.array([["a", "b"], None, ["c"] * 9, [], ["d"], ["e"]])], ["tokens"])
    for most in (1, 2, 3, 10, 100):
        parts = list(K.slices(iter([batch, batch.slice(2)]), 0, most))
        assert [t for p, _, tokens in parts for t in tokens.to_pylist()] == ["a", "b", *["c"] * 9, "d", "e", *["c"] * 9, "d", "e"]
        assert sum(p.num_rows for p, _, _ in parts) == 10 and all(len(row) == len(tokens) for _, row, tokens in parts)


def test_known_terms_of_repeated_and_null_ids(spark, texts):
    vocab = spark.createDataFrame([("bb", 3, 2.0), ("bb cc", 1, 1.5), ("cc", 0, 1.0), ("nothing here", 2, 1.0)], "term string, idx int, idf double")
    known = {"bb": 2.0, "bb cc": 1.5, "cc": 1.0}
    want = Counter()
    for i, text in TEXTS:
        want[i] += sum(term in known for term in terms_of(text))
    assert {r["id"]: r["known_terms"] for r in X.known_tokens(texts, vocab).collect()} == dict(want)
    counted = X.with_term_counts(texts.select("id", "text"))
    by_rows = {tuple(r) for r in X.tfidf_weights(counted, vocab).select("id", "term", "idx", F.round("weight", 9)).collect()}
    assert {tuple(r) for r in X.tfidf_weights(X.with_tokens(texts.select("id", "text")), vocab).select("id", "term", "idx", F.round("weight", 9)).collect()} == by_rows
    model = S.ClassifierModel(vocab.withColumn("coef", F.array(F.col("idf") * 1.0, F.col("idx") * 1.0)), [0.0, 0.0], ["a", "b"], {"max_n": "2"})
    got = S.vectorize(texts, model)
    assert {r["id"]: r["known_terms"] for r in got.collect()} == dict(want) and got.filter("known_terms = 0 and squares is not null").count() == 0


def test_no_row_of_a_document_and_term_is_built(spark, texts):
    vocab = spark.createDataFrame([("bb", 0, 2.0, [1.0])], "term string, idx int, idf double, coef array<double>")
    for df in (S.vectorize(texts, S.ClassifierModel(vocab, [0.0], ["a"])), X.known_tokens(texts, vocab)):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
