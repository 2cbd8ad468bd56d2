"""Queries on a prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import evaluation as E
from foliospark.plans import tables as t
from foliospark.plans.catalogue import query
from foliospark.plans.sqlviews import with_views

PLACES = 6


def _p(spark, sf):
    return t.preds(spark, sf)


def _rounded(df):
    return E.round_metrics(df, PLACES)


@query("accuracy", with_views("preds", "SELECT round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM preds"))
def accuracy(spark, sf):
    return _rounded(E.accuracy(_p(spark, sf)))


@query("macro_f1", with_views("report", "SELECT round(avg(f1), 6) AS macro_f1 FROM report"))
def macro_f1(spark, sf):
    return _rounded(E.macro_f1(_p(spark, sf), t.LANGS))


@query("weighted_f1", with_views("report", "SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM report"))
def weighted_f1(spark, sf):
    return _rounded(E.weighted_f1(_p(spark, sf), t.LANGS))


_LOSS = """SELECT -avg(ln(least(greatest(proba[list_position(['de', 'en', 'es', 'fr'], y_true)], 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))) AS v FROM preds"""


@query("log_loss", with_views("preds", f"SELECT round(v, 6) AS log_loss FROM ({_LOSS})"))
def log_loss(spark, sf):
    return _rounded(E.log_loss(_p(spark, sf), t.LANGS))


@query("coverage", with_views("preds", "SELECT round(avg((list_max(proba) >= 0.75)::INT), 6) AS coverage FROM preds"))
def coverage(spark, sf):
    return _rounded(E.coverage_at_threshold(_p(spark, sf)))


@query("brier", with_views("onehot", "SELECT class, round(avg((y - p) * (y - p)), 6) AS brier FROM onehot GROUP BY class"))
def brier(spark, sf):
    return _rounded(E.brier_per_class(_p(spark, sf), t.LANGS))


@query("report", with_views("report", """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT * FROM report
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT sum(recall * support) / sum(support) AS a, sum(support)::BIGINT AS n FROM report)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM report
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM report)"""))
def report(spark, sf):
    return _rounded(E.classification_report(_p(spark, sf), t.LANGS))


@query("report_matrix", with_views("report", "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report"))
def report_matrix(spark, sf):
    return _rounded(E.report_matrix(_p(spark, sf), t.LANGS))


@query("confusion", with_views("preds", """
SELECT a AS y_true, b AS y_pred, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY a), 6) AS share
FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS a) CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS b)
LEFT JOIN (SELECT y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL) ON a = y_true AND b = y_pred"""))
def confusion(spark, sf):
    return _rounded(E.confusion_matrix(_p(spark, sf), t.LANGS))


@query("conf_hist", with_views("preds", """
SELECT scope, bin, correct, incorrect, round(sum(correct) OVER w::DOUBLE / sum(correct + incorrect) OVER w, 6) AS accuracy, (sum(correct + incorrect) OVER w)::BIGINT AS n FROM (
  SELECT scope, least(floor(list_max(proba) * 20), 19)::INT AS bin, count(*) FILTER (y_true = y_pred) AS correct, count(*) FILTER (y_true <> y_pred) AS incorrect
  FROM (SELECT *, unnest(['overall', y_true]) AS scope FROM preds) GROUP BY scope, bin) WINDOW w AS (PARTITION BY scope)"""))
def conf_hist(spark, sf):
    return _rounded(E.confidence_histogram(_p(spark, sf)))


@query("prob_hist", with_views("onehot", "SELECT class, least(floor(p * 20), 19)::INT AS bin, count(*) AS n FROM onehot GROUP BY class, bin"))
def prob_hist(spark, sf):
    return E.probability_histogram(_p(spark, sf), t.LANGS)


@query("calibration", with_views("onehot", """
SELECT class, len(list_filter([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE], lambda e: e < p))::INT AS bin, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive, count(*) AS n FROM onehot GROUP BY class, bin"""))
def calibration(spark, sf):
    return _rounded(E.calibration_curve(_p(spark, sf), t.LANGS))


@query("ece", with_views("onehot", """
SELECT class, round(sum(CASE WHEN bin < 10 THEN n * abs(acc - conf) ELSE 0 END) / sum(n), 6) AS ece FROM (
  SELECT class, floor(p * 10) AS bin, avg(p) AS conf, avg(y) AS acc, count(*) AS n FROM onehot GROUP BY class, bin) GROUP BY class"""))
def ece(spark, sf):
    return _rounded(E.expected_calibration_error(_p(spark, sf), t.LANGS))


@query("binarized", with_views("onehot", "SELECT id, class, y::BIGINT AS y, round(p, 6) AS p FROM onehot"))
def binarized(spark, sf):
    return _rounded(E.binarize_labels(_p(spark, sf), t.LANGS))


@query("roc", with_views("curve", "SELECT class, round(score, 9) AS threshold, round(fp::DOUBLE / neg_all, 6) AS fpr, round(tp::DOUBLE / pos_all, 6) AS tpr FROM curve UNION ALL SELECT DISTINCT class, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM onehot"))
def roc(spark, sf):
    return _rounded(E.roc_curve(_p(spark, sf), t.LANGS).withColumn("threshold", F.round("threshold", 9).cast("string"))).withColumn(
        "threshold", F.col("threshold").cast("double"))


@query("pr", with_views("curve", "SELECT class, round(score, 9) AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / pos_all, 6) AS recall FROM curve UNION ALL SELECT DISTINCT class, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM onehot"))
def pr(spark, sf):
    return _rounded(E.pr_curve(_p(spark, sf), t.LANGS).withColumn("threshold", F.round("threshold", 9).cast("string"))).withColumn(
        "threshold", F.col("threshold").cast("double"))


_AUC = """SELECT class, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc
  FROM (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2.0::DOUBLE AS r FROM onehot) GROUP BY class"""


@query("auc", with_views("onehot", f"SELECT class, round(auc, 6) AS auc FROM ({_AUC} UNION ALL SELECT 'macro', avg(auc) FROM ({_AUC}))"))
def auc(spark, sf):
    """Counts below each score here, average ranks in the SQL: two ways to the same area."""
    return _rounded(E.roc_auc_ovr(_p(spark, sf), t.LANGS))


_AP = "SELECT class, sum((recall - before) * precision) AS ap FROM (SELECT class, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / pos_all AS recall, coalesce(lag(tp::DOUBLE / pos_all) OVER (PARTITION BY class ORDER BY score DESC), 0) AS before FROM curve) GROUP BY class"


@query("average_precision", with_views("curve", f"SELECT class, round(ap, 6) AS average_precision FROM ({_AP})"))
def average_precision(spark, sf):
    return _rounded(E.average_precision(_p(spark, sf), t.LANGS))


@query("all_metrics", with_views("onehot report", f"""
SELECT metric, round(value, 4) AS value FROM (
  SELECT 'accuracy' AS metric, avg((y_true = y_pred)::INT) AS value FROM preds UNION ALL SELECT 'macro_f1', avg(f1) FROM report
  UNION ALL SELECT 'weighted_f1', sum(f1 * support) / sum(support) FROM report UNION ALL SELECT 'log_loss', v FROM ({_LOSS})
  UNION ALL SELECT 'roc_auc_ovr', avg(auc) FROM ({_AUC}) UNION ALL SELECT 'coverage_at_threshold', avg((list_max(proba) >= 0.75)::INT) FROM preds
  UNION ALL SELECT class || '_precision', precision FROM report UNION ALL SELECT class || '_recall', recall FROM report
  UNION ALL SELECT class || '_f1', f1 FROM report UNION ALL SELECT class || '_brier', avg((y - p) * (y - p)) FROM onehot GROUP BY class)"""))
def all_metrics(spark, sf):
    return E.compute_metrics(_p(spark, sf), t.LANGS)
