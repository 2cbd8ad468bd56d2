"""Queries on features, training and classification."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from foliospark.operators import evaluation as E
from foliospark.operators import features as X
from foliospark.operators import scoring as S
from foliospark.operators import training as R
from foliospark.operators.extraction import PROMPTS, TOO_SHORT, Ledger
from foliospark.operators.stages import DocumentClassifierModel
from foliospark.plans import tables as t
from foliospark.plans.catalogue import query
from foliospark.plans.process import process_documents
from foliospark.plans.sqlviews import clean, tokens, with_views, words
from foliospark.schemas import EXTRACTABLE_TYPES
from foliospark.session import materialize, shared_folder
from foliospark.sources import sinks
from foliospark.streaming import streams

# --- features ---------------------------------------------------------------------------------------------

_TERMS = f"""terms AS (
  SELECT id, label, term, n, count(*) AS tf FROM (
    SELECT id, label, unnest(t) AS term, 1 AS n FROM toks UNION ALL
    SELECT id, label, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term, 2 AS n FROM toks) GROUP BY id, label, term, n)"""
_FREQ = "freq AS (SELECT term, n, count(*) AS df, sum(tf)::BIGINT AS total FROM terms GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= (SELECT count(*) FROM samples) * 0.5)"
_VOCAB = """vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, ln((1 + (SELECT count(*) FROM samples))::DOUBLE / (1 + df)) + 1 AS idf
  FROM (SELECT * FROM freq ORDER BY total DESC, term LIMIT 5000))"""


def _sql(body: str, *parts: str) -> str:
    first = f"toks AS (SELECT id, label, {tokens('text')} AS t FROM samples)"
    return with_views("samples", body, ", ".join([first, *parts]))


def _frequencies(spark, sf, max_n=2):
    return X.document_frequency(X.term_sums(t.samples(spark, sf), max_n), t.table(spark, sf, "documents").count())


def _vocabulary(spark, sf):
    n = t.table(spark, sf, "documents").count()
    return X.vocabulary(_frequencies(spark, sf), n)


@query("tokens_df", _sql("SELECT term, n, df, total FROM freq", _TERMS, _FREQ))
def tokens_df(spark, sf):
    return _frequencies(spark, sf).select("term", "n", "df", "total")


@query("ngram_counts", _sql("SELECT id, n, count(*) AS terms, sum(tf)::BIGINT AS tokens FROM terms GROUP BY id, n", _TERMS))
def ngram_counts(spark, sf):
    rows = X.ngrams(t.samples(spark, sf).select("id", "text"))
    return rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.col("tf").cast("bigint")).alias("tokens"))


@query("ngram_top_terms", _sql("SELECT term, n, df, total FROM freq ORDER BY total DESC, term LIMIT 5000", _TERMS, _FREQ))
def ngram_top_terms(spark, sf):
    return X.top_terms(_frequencies(spark, sf)).select("term", "n", "df", "total")


@query("tfidf_weights", _sql("""
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM (SELECT id, term, (1 + ln(tf)) * idf AS w FROM terms JOIN vocab USING (term))""",
                             _TERMS, _FREQ, _VOCAB))
def tfidf_weights(spark, sf):
    cut = materialize(X.with_tokens(t.samples(spark, sf).drop("label")), "tokens")  # the corpus is cut into tokens once
    n = cut.count()
    vocab = X.vocabulary(X.document_frequency(X.term_sums(cut), n), n)
    rows = X.tfidf_weights(cut, vocab)
    return rows.select("id", "term", F.round("weight", 6).alias("weight"))


@query("known_token_gate", _sql("""
SELECT s.id, count(v.term) AS known_terms FROM samples s LEFT JOIN terms t ON s.id = t.id LEFT JOIN vocab v ON t.term = v.term GROUP BY s.id""", _TERMS, _FREQ, _VOCAB))
def known_token_gate(spark, sf):
    return X.known_tokens(t.samples(spark, sf), _vocabulary(spark, sf))


# --- samples ----------------------------------------------------------------------------------------------

@query("class_counts", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def class_counts(spark, sf):
    return R.class_counts(t.samples(spark, sf))


@query("balanced_weights", "SELECT lang AS label, count(*) AS n, sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)) AS weight FROM documents GROUP BY lang")
def balanced_weights(spark, sf):
    return R.balanced_weights(t.samples(spark, sf))


@query("index_labels", "SELECT doc_id AS id, (list_position(['de', 'en', 'es', 'fr'], lang) - 1)::DOUBLE AS y FROM documents")
def index_labels(spark, sf):
    return R.index_labels(t.samples(spark, sf).select("id", "label")).select("id", "y")


@query("stratified_folds", "SELECT doc_id AS id, lang AS label, ((row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) - 1) % 5)::INT AS fold FROM documents")
def stratified_folds(spark, sf):
    return R.stratified_folds(t.samples(spark, sf))


@query("stratified_fold_sizes", """
SELECT label, fold, count(*) AS n FROM (SELECT lang AS label, ((row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) - 1) % 5)::INT AS fold FROM documents) GROUP BY label, fold""")
def stratified_fold_sizes(spark, sf):
    return R.stratified_folds(t.samples(spark, sf)).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("sample_fraction", """
SELECT id FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.15::DOUBLE)""")
def sample_fraction(spark, sf):
    return R.sample_fraction(t.samples(spark, sf), 0.15).select("id")


@query("drop_short_samples", f"SELECT doc_id AS id FROM documents WHERE {words('text')} >= 10")
def drop_short_samples(spark, sf):
    return R.drop_short_samples(t.samples(spark, sf)).select("id")


@query("label_counts_report", f"SELECT lang AS label, count(*) FILTER ({words('text')} >= 10) AS kept, count(*) FILTER ({words('text')} < 10) AS failed FROM documents GROUP BY lang")
def label_counts_report(spark, sf):
    samples = t.samples(spark, sf)
    return R.label_counts_report(samples.select("id", "label"), R.drop_short_samples(samples))


_LANES = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(4))


@query("fingerprint", f"SELECT count(*) AS n, md5(concat_ws('|', count(*)::VARCHAR, {_LANES})) AS fingerprint FROM (SELECT md5(concat_ws('|', doc_id, lang, text)) AS h FROM documents)")
def fingerprint(spark, sf):
    row = F.md5(F.concat_ws("|", F.col("id").cast("string"), "label", "text"))
    return R.fingerprint_of(t.samples(spark, sf).select(row.alias("h")))


# --- fits (no SQL twin; tests compare them with brute force on small fixtures) ------------------------------

@query("grid_results")
def grid_results(spark, sf):
    """All twelve candidates over five folds."""
    scores, _ = R.grid_search(t.samples(spark, sf), R.full_grid())
    return R.grid_results(scores)


@query("oof_predictions", "SELECT doc_id AS id, lang AS y_true, 4 AS classes, true AS is_distribution, true AS is_largest FROM documents")
def oof_predictions(spark, sf):
    """Every sample is predicted once, by a distribution over the classes whose largest entry names the class."""
    rows = R.out_of_fold(t.samples(spark, sf))
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", "y_true", F.size("proba").alias("classes"), (F.abs(total - 1) < 1e-9).alias("is_distribution"),
                       (F.get("proba", (F.array_position(F.array(*[F.lit(c) for c in t.LANGS]), F.col("y_pred")) - 1).cast("int"))
                        == F.array_max("proba")).alias("is_largest"))


#: A candidate of few terms and a strong penalty, so that plain gradient descent in SQL reaches the optimum too.
SMALL = R.Candidate(5, 1, 0.01)
_STEPS = 300


def _descent_sql(left_out: str, scored: str) -> str:
    """Fits by gradient descent, one for each left-out fold (-1: none is): vocabulary, IDF and class weights of the training rows, steps on
    lists of 4 x 6 numbers. ``scored`` says which rows a fit gives probabilities for."""
    d = SMALL.max_features + 1
    dot = f"list_inner_product(b[{d} * c + 1:{d} * c + {d}], x)"
    sql = with_views("samples", f"""
SELECT id, y_true, list_transform(p, lambda v: round(v, 4)) AS proba FROM (
  SELECT id, label AS y_true, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (
    SELECT id, label, list_transform(range(4), lambda c: exp({dot})) AS e
    FROM points JOIN (SELECT f, b FROM descent WHERE step = {_STEPS}) USING (f) WHERE {scored}))""", f"""
toks AS (SELECT id, label, {tokens('text')} AS t FROM samples),
folded AS (SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) - 1) % 5)::INT AS fold FROM samples),
lefts AS (SELECT unnest({left_out})::INT AS f),
counted AS (SELECT id, fold, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) JOIN folded USING (id) GROUP BY ALL),
sizes AS (SELECT f, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY f) AS total, count(*) OVER (PARTITION BY f) AS k FROM folded JOIN lefts ON fold <> f GROUP BY f, label),
chosen AS (SELECT f, term, ln((1 + total)::DOUBLE / (1 + df)) + 1 AS idf, row_number() OVER (PARTITION BY f ORDER BY seen DESC, term) AS place FROM (
  SELECT f, term, count(*) AS df, sum(tf) AS seen FROM counted JOIN lefts ON fold <> f GROUP BY f, term) JOIN (SELECT DISTINCT f, total FROM sizes) USING (f) WHERE df >= 2 AND df <= 0.5 * total),
weighed AS (SELECT c.id, v.f, list((1 + ln(tf)) * idf ORDER BY place) AS w, list(place ORDER BY place) AS places FROM counted c JOIN chosen v ON c.term = v.term AND place <= {d - 1} GROUP BY c.id, v.f),
points AS MATERIALIZED (SELECT f, o.id, o.label, o.fold, list_position(['de', 'en', 'es', 'fr'], o.label) - 1 AS y, s.total::DOUBLE / (k * n) AS weight, total::DOUBLE AS total,
    list_append(list_transform(range(1, {d}), lambda j: coalesce(w[list_position(places, j)] / sqrt(list_inner_product(w, w)), 0)), 1.0) AS x
  FROM folded o CROSS JOIN lefts LEFT JOIN weighed USING (id, f) LEFT JOIN sizes s USING (f, label)),
descent AS (SELECT f, 0 AS step, list_transform(range({4 * d}), lambda j: 0.0::DOUBLE) AS b FROM lefts
  UNION ALL
  SELECT f, step + 1, list(new ORDER BY j) FROM (
    SELECT f, step, j, any_value(b[j + 1]) - sum(weight * (e[j // {d} + 1] / list_sum(e) - (y = j // {d})::INT) * x[j % {d} + 1]) / any_value(total)
           - CASE WHEN j % {d} < {d - 1} THEN any_value(b[j + 1]) / ({SMALL.c} * any_value(total)) ELSE 0 END AS new
    FROM (SELECT f, step, b, y, weight, total, x, list_transform(range(4), lambda c: exp({dot})) AS e FROM descent JOIN points USING (f) WHERE step < {_STEPS} AND fold <> f),
         (SELECT unnest(range({4 * d})) AS j) GROUP BY f, step, j) GROUP BY f, step)""")
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("oof_probabilities", _descent_sql("range(5)", "fold = f"))
def oof_probabilities(spark, sf):
    """Held-out probabilities of five fits, to four places; the twin fits the same models by another method."""
    rows = R.out_of_fold(t.samples(spark, sf), SMALL, tolerance=1e-12)
    return rows.select("id", "y_true", F.transform("proba", lambda v: F.round(v, 4)).alias("proba"))


@query("refit_best", _descent_sql("[-1]", "true"))
def refit_best(spark, sf):
    """The better of two candidates over five folds, fitted on all samples: their probabilities, to four places."""
    samples = t.samples(spark, sf)
    _, best = R.grid_search(samples, [SMALL, R.Candidate(1, 1, SMALL.c)])
    model = R.refit_best(samples, best, tolerance=1e-12)
    scored = S.predict_proba(S.vectorize(samples, model), model).select("id", F.transform("proba", lambda v: F.round(v, 4)).alias("proba"))
    return samples.select("id", F.col("label").alias("y_true")).join(scored, "id")


@query("fit_optimality", "SELECT unnest(['de', 'en', 'es', 'fr']) AS class, 0.0::DOUBLE AS intercept_residual, 0.0::DOUBLE AS coef_residual")
def fit_optimality(spark, sf):
    """The gradient of a fit over all samples, to five places: nothing is left to gain."""
    rows = R.optimality(t.samples(spark, sf))
    return rows.select("class", F.round("intercept_residual", 5).alias("intercept_residual"), F.round("coef_residual", 5).alias("coef_residual"))


@query("manifest")
def manifest(spark, sf):
    """The best candidate of the whole grid, with its metrics over held-out predictions."""
    samples = t.samples(spark, sf)
    _, best = R.grid_search(samples, R.full_grid())
    metrics = E.compute_metrics(R.out_of_fold(samples, best), t.LANGS)
    row = R.training_manifest(spark, samples, best, metrics, data_path="documents")
    return row.select("data_md5", "n_samples", F.to_json("class_counts").alias("class_counts"), "cv_folds", "confidence_threshold",
                      F.to_json("best_params").alias("best_params"), F.size("metrics").alias("n_metrics"))


# --- scoring with coefficients by formula, so that SQL can state the same model ---------------------------

def formula_model(spark, sf, classes: list[str]) -> S.ClassifierModel:
    """The vocabulary of the corpus; coefficients are a function of term index and class."""
    idx = F.col("idx")
    coef = F.array(*[((idx * (7 + 2 * k) + 3 * k) % 23 - 11).cast("double") for k in range(len(classes))])
    terms = materialize(_vocabulary(spark, sf).select("term", "idx", "idf", coef.alias("coef")), "formula-model")
    return S.ClassifierModel(terms, [0.25 * k for k in range(len(classes))], classes, {"max_n": "2"})


def _scored_sql(classes: list[str]) -> list[str]:
    names = "[" + ", ".join(f"'{c}'" for c in classes) + "]"
    dots = ", ".join(f"coalesce(sum(w * ((idx * {7 + 2 * k} + {3 * k}) % 23 - 11)) / sqrt(sum(w * w)), 0) + {0.25 * k}::DOUBLE" for k in range(len(classes)))
    return [
        f"weighed AS (SELECT t.id, v.idx, (1 + ln(tf)) * idf AS w FROM terms t JOIN vocab v USING (term) JOIN samples s ON s.id = t.id WHERE {words('s.text')} >= 10)",
        f"margins AS (SELECT id, [{dots}] AS m FROM weighed GROUP BY id)",
        "powers AS (SELECT id, list_transform(m, lambda x: exp(x - list_max(m))) AS e FROM margins)",
        f"best AS (SELECT id, {names}[list_position(e, list_max(e))] AS label, list_max(e) / list_sum(e) AS confidence FROM powers)",
        """scored AS (SELECT s.id, CASE WHEN confidence >= 0.75 THEN best.label ELSE 'unknown' END AS doc_type, coalesce(confidence, 0) AS confidence
           FROM samples s LEFT JOIN best USING (id))"""]


@query("classify_documents", _sql("SELECT id, doc_type, round(confidence, 6) AS confidence FROM scored", _TERMS, _FREQ, _VOCAB, *_scored_sql(t.LANGS)))
def classify_documents(spark, sf):
    scored = S.classify(t.samples(spark, sf), formula_model(spark, sf, t.LANGS))
    return scored.select("id", "doc_type", F.round("confidence", 6).alias("confidence"))


@query("model_round_trip", _sql("SELECT doc_type, true AS same, count(*) AS n FROM scored GROUP BY doc_type", _TERMS, _FREQ, _VOCAB, *_scored_sql(t.LANGS)))
def model_round_trip(spark, sf):
    """A model written and read back gives the same classes."""
    samples, model = t.samples(spark, sf), formula_model(spark, sf, t.LANGS)
    path = shared_folder(spark, "model")
    S.save_model(model, path)
    a, b = S.classify(samples, model), S.classify(samples, S.load_model(spark, path))
    both = a.join(b.toDF("id", "reloaded", "reloaded_confidence"), "id")
    return both.groupBy("doc_type", (F.col("doc_type") == F.col("reloaded")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("classifier_pipeline", _sql("SELECT id, doc_type, round(confidence, 6) AS confidence FROM scored", _TERMS, _FREQ, _VOCAB, *_scored_sql(t.LANGS)))
def classifier_pipeline(spark, sf):
    """The classifier as a stage behind one of Spark ML's own, in a pipeline that is written, read back and applied."""
    path = shared_folder(spark, "pipeline")
    columns = SQLTransformer(statement="SELECT doc_id AS id, text FROM __THIS__")
    PipelineModel([columns, DocumentClassifierModel(formula_model(spark, sf, t.LANGS))]).write().save(path)
    scored = PipelineModel.load(path).transform(t.table(spark, sf, "documents"))
    return scored.select("id", "doc_type", F.round("confidence", 6).alias("confidence"))


@query("fitted_classes")
def fitted_classes(spark, sf):
    """Classes given by a model that is fitted on the same samples."""
    samples = t.samples(spark, sf)
    return S.classify(samples, R.fit_classifier(samples))


# --- the whole way ----------------------------------------------------------------------------------------

KINDS = {"de": "invoice", "en": "receipt", "es": "contract", "fr": "other"}


def record_client():
    """Factory of a stand-in client that answers with a small record of the type asked for, sometimes incomplete."""
    def client(request: dict) -> tuple[str, int, int]:
        size = len(request["user_message"])
        item = {"description": "Text", "quantity": 1, "unit_price": size / 4, "amount": size / 4}
        if request["doc_type"] == "contract":
            record = {"parties": [] if size % 3 == 0 else ["A", "B"], "effective_date": "2024-01-01"}
        else:
            record = {"vendor_name": " " if size % 7 == 0 else "Vendor", "line_items": [item], "total_amount": size / 4}
        if size % 11 == 0:
            record = {"line_items": []}
        return json.dumps(record), size, 1
    return lambda: client


CLASSES = sorted(KINDS.values())
_SLOT = "{text}"


def _outcome_sql() -> str:
    """What becomes of each document: the stand-in client's answer depends only on the length of its message."""
    size = " ".join(f"WHEN '{c}' THEN {len(PROMPTS[c]) - len(_SLOT)}" for c in EXTRACTABLE_TYPES)
    failed = "'Extraction failed after 2 attempts: "
    return f"""
SELECT doc_type, CASE WHEN error_message IS NULL THEN 'completed' ELSE 'failed' END AS outcome, error_message, count(*) AS n FROM (
  SELECT doc_type, CASE WHEN doc_type IN ('other', 'unknown') THEN NULL WHEN length({clean('text')}) < 50 AND length(trim(text)) < 50 THEN '{TOO_SHORT}'
    WHEN size % 11 = 0 THEN CASE doc_type WHEN 'contract' THEN {failed}parties: missing' ELSE {failed}vendor_name: missing' END
    WHEN doc_type = 'contract' AND size % 3 = 0 THEN 'Validation errors: No parties listed'
    WHEN doc_type <> 'contract' AND size % 7 = 0 THEN 'Validation errors: Vendor name is empty' END AS error_message
  FROM (SELECT doc_type, text, length(text) + CASE doc_type {size} ELSE 0 END AS size FROM scored JOIN samples USING (id))) GROUP BY ALL"""


_OUTCOMES = _sql(_outcome_sql(), _TERMS, _FREQ, _VOCAB, *_scored_sql(CLASSES))


@query("process_outcomes", _OUTCOMES)
def process_outcomes(spark, sf):
    """Classify, extract, check and store all documents; outcomes counted by type."""
    texts = t.samples(spark, sf).select(F.col("id").cast("string").alias("document_id"), "text")
    done = process_documents(texts, texts, formula_model(spark, sf, CLASSES), record_client(), "extractor-1")
    return done.outcomes.groupBy("doc_type", "outcome", "error_message").agg(F.count(F.lit(1)).alias("n"))


@query("stream_process", _OUTCOMES)
def stream_process(spark, sf):
    """The same over a stream of the document file, with a ledger of calls, read back as published."""
    model = formula_model(spark, sf, CLASSES)
    schema = t.table(spark, sf, "documents").schema
    # One file or a folder of them: as a pattern, since a stream takes a plain path for a folder.
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    texts = arriving.select(F.col("doc_id").cast("string").alias("document_id"), "text")
    target = shared_folder(spark, "processed")
    streams.stream_process(texts, lambda batch, ledger: process_documents(batch, batch, model, record_client(), "extractor-1", ledger=ledger), target,
                           shared_folder(spark, "process-checkpoint"), shared_folder(spark, "ledger")).awaitTermination()
    outcomes = sinks.published(spark, target, "outcomes")
    return outcomes.groupBy("doc_type", "outcome", "error_message").agg(F.count(F.lit(1)).alias("n"))


@query("replayed_batch", f"SELECT sum(n)::BIGINT AS documents, true AS same_outcomes, 0::BIGINT AS calls_paid_twice FROM ({_OUTCOMES})")
def replayed_batch(spark, sf):
    """A batch that is stopped between two of its tables, then run again and once more: every document once, no call twice."""
    model, target, ledger = formula_model(spark, sf, CLASSES), shared_folder(spark, "replayed"), Ledger(shared_folder(spark, "ledger"), 7)
    texts = t.samples(spark, sf).select(F.col("id").cast("string").alias("document_id"), "text")

    def refuse():
        raise RuntimeError("a call was paid again")

    def outputs(factory):
        done = process_documents(texts, texts, model, factory, "extractor-1", ledger=ledger)
        return {**done.tables, "outcomes": done.outcomes}, done.attempts

    tables, attempts = outputs(record_client())
    stopped = dict(list(tables.items())[:2])
    for name, df in stopped.items():  # what a run leaves that ends before its manifest
        df.write.parquet(f"{target}/{name}/batch=7/run=stopped")
    paid = attempts.count()
    for _ in range(2):
        again, calls = outputs(refuse)
        sinks.publish(again, target, 7)
    kept = sinks.published(spark, target, "outcomes")
    first = tables["outcomes"].select("document_id", F.col("outcome").alias("first"))
    same = kept.join(first, "document_id").agg(F.count(F.lit(1)).alias("documents"), F.bool_and(F.col("outcome") == F.col("first")).alias("same_outcomes"))
    return same.withColumn("calls_paid_twice", F.lit(calls.count() - paid).cast("bigint"))
