"""Metrics of a prediction table ``(id, y_true, y_pred, proba array<double>)``; every metric stays a table.

``classes`` is the class list in alphabetical order, the order of ``proba``. Only counts per class, per bin or per
distinct score are ever sorted, never the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.ordering import running_sums, with_value_bucket
from foliospark.functions.rows import explode_rows
from foliospark.schemas import CONFIDENCE_THRESHOLD, DOCUMENT_CLASSES
from foliospark.session import materialize

# Probability floor, bins and places of the reports.
EPSILON = 2.220446049250313e-16
CONFIDENCE_BINS = 20
CALIBRATION_BINS = 10
PLACES = 4


def _literal(classes: list[str] | None) -> Column:
    return F.array(*[F.lit(c) for c in classes or DOCUMENT_CLASSES])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _top(proba: str = "proba") -> Column:
    return F.array_max(proba)


def predicted_label(proba: Column, classes: Column) -> Column:
    """Class of the highest probability; the first one wins a tie."""
    return F.element_at(classes, F.array_position(proba, F.array_max(proba)).cast("int"))


def binarize_labels(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """One row per (id, class): label 0/1 and the class's probability."""
    return (explode_rows(preds, F.col("proba"), "p", "id", "y_true", position="k")
            .select("id", F.get(_literal(classes), F.col("k")).alias("class"), "p", "y_true")
            .select("id", "class", (F.col("y_true") == F.col("class")).cast("bigint").alias("y"), "p"))


# --- counts per class -------------------------------------------------------------------------------------

def _class_grid(preds: DataFrame, classes: list[str] | None, *names: str, by: Sequence[str] = ()) -> DataFrame:
    grid = preds.select(*by).distinct() if by else preds.sparkSession.range(1).select()
    for name in names:
        grid = grid.select("*", F.explode(_literal(classes)).alias(name))
    return grid


def _pair_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_report(preds: DataFrame, classes: list[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where the denominator is 0. With ``by``, for each value of those columns."""
    counts = (_pair_counts(preds, by)
              .select(*by, "n", (F.col("y_true") == F.col("y_pred")).alias("hit"),
                      F.explode(F.array(F.struct(F.col("y_true").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                                        F.struct(F.col("y_pred").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
                      .alias("s"))
              .groupBy(*by, "s.class")
              .agg(F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.t")).otherwise(0)).alias("tp"),
                   F.sum(F.col("n") * F.col("s.t")).alias("support"),
                   F.sum(F.col("n") * F.col("s.p")).alias("predicted")))
    tp, support, predicted = (F.coalesce(c, F.lit(0)).cast("double") for c in ("tp", "support", "predicted"))
    return (_class_grid(preds, classes, "class", by=by).join(counts, [*by, "class"], "left")
            .select(*by, "class", _ratio(tp, predicted).alias("precision"), _ratio(tp, support).alias("recall"),
                    _ratio(2 * tp, support + predicted).alias("f1"), support.cast("bigint").alias("support")))


def classification_report(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """The class report followed by accuracy, macro average and weighted average."""
    per_class = class_report(preds, classes)
    n = F.sum("support")
    summary = per_class.agg(
        n.alias("n"), F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("accuracy"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), n).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    rows = summary.select(F.inline(F.array(
        _report_row("accuracy", *[F.col("accuracy")] * 3),
        _report_row("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
        _report_row("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")))))
    return per_class.unionByName(rows)


def _report_row(name: str, precision: Column, recall: Column, f1: Column) -> Column:
    return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                    F.col("n").alias("support"))


def report_matrix(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    return class_report(preds, classes).select("class", "precision", "recall", "f1")


def _accuracy() -> Column:
    return F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))


def accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by).agg(_accuracy().alias("accuracy"))


def macro_f1(preds: DataFrame, classes: list[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    return class_report(preds, classes, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def weighted_f1(preds: DataFrame, classes: list[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    return class_report(preds, classes, by).groupBy(*by).agg(
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def confusion_matrix(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Counts and row shares (recall) for every pair of classes, zeros kept."""
    totals = _pair_counts(preds).groupBy("y_true").agg(F.sum("n").alias("row_total"))
    return (_class_grid(preds, classes, "y_true", "y_pred")
            .join(_pair_counts(preds), ["y_true", "y_pred"], "left").join(totals, "y_true", "left")
            .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"),
                    F.try_divide(F.coalesce("n", F.lit(0)), F.col("row_total")).alias("share")))


# --- scores of probabilities ------------------------------------------------------------------------------

def _log_loss(classes: list[str] | None) -> Column:
    p = F.get("proba", F.array_position(_literal(classes), F.col("y_true")).cast("int") - 1)
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -F.avg(F.ln(clipped / total))


def log_loss(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Mean of -ln p(true class), probabilities scaled to sum 1 and kept off 0 and 1."""
    return preds.agg(_log_loss(classes).alias("log_loss"))


def _coverage(threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return F.avg((_top() >= threshold).cast("double"))


def coverage_at_threshold(preds: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    return preds.agg(_coverage(threshold).alias("coverage"))


def brier_per_class(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    return binarize_labels(preds, classes).groupBy("class").agg(
        F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("brier"))


# --- histograms and calibration ---------------------------------------------------------------------------

def _bin(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def confidence_histogram(preds: DataFrame) -> DataFrame:
    """20 bins of the highest probability, correct and incorrect, overall and per true class.

    Every row carries its scope's accuracy and size.
    """
    bins = (preds.select("y_true", (F.col("y_true") == F.col("y_pred")).alias("ok"),
                         _bin(_top(), CONFIDENCE_BINS).alias("bin"))
            .groupBy("y_true", "bin").agg(F.count_if("ok").alias("correct"), F.count_if(~F.col("ok")).alias("incorrect")))
    scoped = (bins.select(F.explode(F.array(F.lit("overall"), F.col("y_true"))).alias("scope"), "bin", "correct", "incorrect")
              .groupBy("scope", "bin").agg(F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect")))
    sizes = scoped.groupBy("scope").agg(F.sum(F.col("correct") + F.col("incorrect")).alias("n"),
                                        F.sum("correct").alias("hits"))
    return (scoped.join(sizes, "scope")
            .select("scope", "bin", "correct", "incorrect", (F.col("hits") / F.col("n")).alias("accuracy"), "n"))


def probability_histogram(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """20 equal bins of 0..1 per class."""
    return (binarize_labels(preds, classes).groupBy("class", _bin(F.col("p"), CONFIDENCE_BINS).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def calibration_curve(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Per class and bin: mean probability, share of positives and size; empty bins are absent.

    A bin is closed above here: 0.1 is in the first one, and so is 0.
    """
    edges = F.array(*[F.lit(i / CALIBRATION_BINS) for i in range(1, CALIBRATION_BINS)])
    return (binarize_labels(preds, classes).groupBy("class", F.size(F.filter(edges, lambda e: e < F.col("p"))).alias("bin"))
            .agg(F.avg("p").alias("mean_predicted"), F.avg("y").alias("fraction_positive"),
                 F.count(F.lit(1)).alias("n")))


def expected_calibration_error(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Weighted gap between positives and mean probability over bins closed below and open above: a probability
    of exactly 1 counts in the size but lies in no bin."""
    bins = (binarize_labels(preds, classes)
            .groupBy("class", F.floor(F.col("p") * CALIBRATION_BINS).alias("bin"))
            .agg(F.avg("p").alias("conf"), F.avg("y").alias("acc"), F.count(F.lit(1)).alias("n")))
    gap = F.when(F.col("bin") < CALIBRATION_BINS, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return bins.groupBy("class").agg((F.sum(gap) / F.sum("n")).alias("ece"))


# --- curves -----------------------------------------------------------------------------------------------

def _score_counts(preds: DataFrame, classes: list[str] | None, places: int | None) -> DataFrame:
    """Positives and negatives per (class, distinct score), with running totals from the highest score down.

    ``places`` rounds the scores first, for a shorter curve over scores that are nearly all different.
    """
    p = F.col("p") if places is None else F.round("p", places)
    counts = (binarize_labels(preds, classes).groupBy("class", p.alias("score"))
              .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    counts = materialize(counts, "score-counts")  # splits, bucket totals and class totals read it, not the predictions
    cut = with_value_bucket(counts, ["class"], "score")
    running = running_sums(cut, ["class"], "_bucket", [F.col("score").desc()], {"pos": "tp", "neg": "fp"}, descending=True)
    totals = counts.groupBy("class").agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
    return running.join(F.broadcast(totals), "class").drop("_bucket")


def _class_rows(preds: DataFrame, classes: list[str] | None) -> DataFrame:
    """One row for each class."""
    if classes is None:
        return binarize_labels(preds, classes).select("class").distinct()
    return preds.sparkSession.createDataFrame([(c,) for c in classes], "class string")


def roc_curve(preds: DataFrame, classes: list[str] | None = None, places: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct threshold of every class, and (0, 0) at an infinite one."""
    points = _score_counts(preds, classes, places).select(
        "class", F.col("score").alias("threshold"),
        F.try_divide("fp", "neg_all").alias("fpr"), F.try_divide("tp", "pos_all").alias("tpr"))
    return points.unionByName(_class_rows(preds, classes).select(
        "class", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def pr_curve(preds: DataFrame, classes: list[str] | None = None, places: int | None = None) -> DataFrame:
    """Precision and recall at every distinct threshold of every class, and (1, 0) without a threshold."""
    points = _score_counts(preds, classes, places).select(
        "class", F.col("score").alias("threshold"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "pos_all").alias("recall"))
    return points.unionByName(_class_rows(preds, classes).select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def roc_auc_ovr(preds: DataFrame, classes: list[str] | None = None, places: int | None = None) -> DataFrame:
    """One-vs-rest AUC per class and their mean (class ``macro``).

    The area is the share of (positive, negative) pairs in the right order, ties counted half: every positive at a
    score beats the negatives below it.
    """
    below = F.col("neg_all") - F.col("fp")
    wins = F.col("pos") * (below + F.col("neg") * 0.5)
    auc = (_score_counts(preds, classes, places).groupBy("class")
           .agg(F.try_divide(F.sum(wins), F.first("pos_all").cast("double") * F.first("neg_all")).alias("auc")))
    scopes = auc.select(F.explode(F.array(F.col("class"), F.lit("macro"))).alias("class"), "auc")
    return scopes.groupBy("class").agg(F.avg("auc").alias("auc"))


def average_precision(preds: DataFrame, classes: list[str] | None = None, places: int | None = None) -> DataFrame:
    """Sum of recall steps times precision: the step at a score is its own positives over all positives."""
    step = F.try_divide("pos", "pos_all") * F.try_divide("tp", F.col("tp") + F.col("fp"))
    return _score_counts(preds, classes, places).groupBy("class").agg(F.sum(step).alias("average_precision"))


# --- all together -----------------------------------------------------------------------------------------

def round_metrics(df: DataFrame, places: int = PLACES) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def compute_metrics(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Every logged metric as rows ``(metric, value)``, rounded to four places.

    The predictions are read three times: for the counts of label pairs, for all plain averages, and for the curve.
    """
    names = classes or DOCUMENT_CLASSES
    report = materialize(class_report(preds, classes), "report")  # one row for each class
    weighted = F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
    from_report = report.agg(F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"))
    brier = {f"{c}_brier": F.avg(F.pow((F.col("y_true") == c).cast("double") - F.get("proba", F.lit(k)), F.lit(2.0))) for k, c in enumerate(names)}
    averages = preds.agg(_accuracy().alias("accuracy"), _log_loss(classes).alias("log_loss"), _coverage().alias("coverage_at_threshold"),
                         *[value.alias(name) for name, value in brier.items()])

    def as_rows(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in df.columns])))

    per_class = report.select(F.inline(F.array(*[
        F.struct(F.concat_ws("_", "class", F.lit(m)).alias("metric"), F.col(m).alias("value"))
        for m in ("precision", "recall", "f1")])))
    area = roc_auc_ovr(preds, classes).filter("class = 'macro'").select(F.lit("roc_auc_ovr").alias("metric"), F.col("auc").alias("value"))
    out = as_rows(from_report).unionByName(as_rows(averages)).unionByName(per_class).unionByName(area)
    return round_metrics(out)
