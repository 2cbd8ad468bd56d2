"""Training of the document classifier: weights, folds, grid search, out-of-fold predictions, manifest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from foliospark.functions.ordering import hash_rank, seeded_order
from foliospark.functions.text import is_short
from foliospark.operators import evaluation as E
from foliospark.operators import scoring as S
from foliospark.operators.features import MAX_DF, MIN_DF, pair_sums, term_sums, top_terms, weight_arrays, with_tokens
from foliospark.operators.scoring import ClassifierModel
from foliospark.operators.solver import TOLERANCE, Fit, Fitted, SparseRows, held_out, train_logreg
from foliospark.operators.terms import Vocabulary, cut_of, listed
from foliospark.schemas import CONFIDENCE_THRESHOLD, MIN_WORDS
from foliospark.session import materialize, ship

# Folds, seed and the search grid.
FOLDS = 5
SEED = 42
#: Terms of all rows together that one task of a fit's job works on, unless there are fewer cores.
TASK_TERMS = 50_000
#: Words that pairs are counted of by number, at most: a broadcast of some 20 MB.
PAIR_WORDS = 1 << 18
MANIFEST = (
    "created_at timestamp, spark_version string, data_path string, data_md5 string, n_samples bigint, "
    "class_counts map<string,bigint>, cv_folds int, confidence_threshold double, random_state int, "
    "best_params map<string,string>, metrics map<string,double>")
GRID = {"max_features": [5000, 10000], "max_n": [1, 2], "c": [0.1, 1.0, 10.0]}


@dataclass(frozen=True)
class Candidate:
    max_features: int = 5000
    max_n: int = 2
    c: float = 1.0

    def params(self) -> dict[str, str]:
        return {"max_features": str(self.max_features), "max_n": str(self.max_n), "c": str(self.c)}


def full_grid() -> list[Candidate]:
    return [Candidate(*v) for v in product(GRID["max_features"], GRID["max_n"], GRID["c"])]


# --- samples ----------------------------------------------------------------------------------------------

def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def balanced_weights(df: DataFrame) -> DataFrame:
    """Weight per class, N / (classes x size): one row per class."""
    listed = class_counts(df).agg(F.collect_list(F.struct("label", "n")).alias("c"), F.sum("n").alias("all"),
                                  F.count(F.lit(1)).alias("k"))
    return listed.select("all", "k", F.inline("c")).select(
        "label", "n", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


def index_labels(df: DataFrame) -> DataFrame:
    """Class index in alphabetical order."""
    return StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(df).transform(df)


def stratified_folds(df: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold``: a seeded shuffle inside every class, dealt out evenly. Only keys are ranked."""
    keys = df.select("id", "label").withColumn("_order", seeded_order(F.col("id"), seed))
    return hash_rank(keys, ["label"], "_order", ["id"], "_rank").select(
        "id", "label", ((F.col("_rank") - 1) % k).cast("int").alias("fold"))


def sample_fraction(df: DataFrame, ratio: float, seed: int = SEED) -> DataFrame:
    """Exactly int(n x ratio) rows without replacement.

    The rows lowest in a seeded order are taken: whole hash buckets up to the cut, and a rank inside the one bucket
    that the cut goes through.
    """
    keys = df.select("id").withColumn("_all", F.lit(1)).withColumn("_order", seeded_order(F.col("id"), seed))
    chosen = hash_rank(keys, ["_all"], "_order", ["id"], "_rank", at_most=F.floor(F.col("_n") * ratio))
    return df.join(chosen.select("id"), "id", "left_semi")


def drop_short_samples(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return df.filter(~is_short(F.col("text"), min_words))


def label_counts_report(requested: DataFrame, produced: DataFrame) -> DataFrame:
    """Per class: samples kept and samples that failed (asked for but not produced)."""
    failed = requested.join(produced.select("id"), "id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("failed"))
    kept = class_counts(produced).withColumnRenamed("n", "kept")
    return (kept.join(failed, "label", "full")
            .select("label", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("failed", F.lit(0)).alias("failed")))


def dataset_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of the rows that does not depend on their order or partitioning.

    Every row's md5 is cut into four numbers; their sums over the table, with the row count, are hashed again.
    """
    row = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return fingerprint_of(df.select(row.alias("h")))


def fingerprint_of(digests: DataFrame) -> DataFrame:
    """Fold of a column ``h`` of md5 texts."""
    lanes = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = digests.agg(F.count(F.lit(1)).alias("n"), *[F.sum(lane).alias(f"s{i}") for i, lane in enumerate(lanes)])
    text = F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)])
    return sums.select("n", F.md5(text).alias("fingerprint"))


# --- fitting ----------------------------------------------------------------------------------------------

class FoldedSamples:
    """Samples ``(id, label, text)`` with unique ids, counted into terms once and shared by every fit; rows without label take no part.

    Document frequencies are kept per fold: the training counts of a fold are all counts minus its own, so no fold
    sees a held-out text and no fold counts the corpus again. ``k`` of 0 means that all rows are training rows.
    """

    def __init__(self, df: DataFrame, k: int = FOLDS, seed: int = SEED, max_n: int = 2):
        self.k, self.spark = k, df.sparkSession
        labelled = df.select("id", "label", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("label").isNotNull())
        self.max_n = max_n
        folds = stratified_folds(labelled, k, seed).select("id", "fold") if k else None
        self.counted = materialize(labelled.join(folds, "id") if k else labelled.withColumn("fold", F.lit(0)), "folded-texts")
        self.sizes = {(r["fold"], r["label"]): r["n"] for r in self.counted.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.classes = sorted({label for _, label in self.sizes})
        if not self.classes:
            raise ValueError("no labelled sample to fit on")
        self.words = self._by_fold(term_sums(self.counted, 1, "fold"), "term", "n")
        self.pairs: tuple[int, DataFrame] | None = None

    def _by_fold(self, sums: DataFrame, *keys: str) -> DataFrame:
        """Documents and total of each term by fold, written; rarer terms are in no vocabulary."""
        kept = range(max(self.k, 1))
        per_fold = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("docs"))), F.lit(0)).alias(f"df_{f}") for f in kept]
        per_fold += [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("tf"))), F.lit(0)).alias(f"total_{f}") for f in kept]
        return materialize(sums.groupBy(*keys).agg(*per_fold).filter(sum(F.col(f"df_{f}") for f in kept) >= MIN_DF), "folded-frequencies")

    def _all(self, what: str) -> Column:
        return sum(F.col(f"{what}_{f}") for f in range(max(self.k, 1)))

    def frequencies(self, widest: dict[tuple[int, int], int]) -> DataFrame:
        """Words, and the pairs of words that can be among the ``widest`` highest totals of a fold.

        Where a fold has so many words, the last one's total is the least that a pair there must have, and a pair is never more frequent than
        its words: only pairs of words of that total are counted, as numbers. The words of a lower total are nearly all of a large corpus.
        """
        paired = {fold: most for (fold, max_n), most in widest.items() if max_n > 1}
        if not paired:
            return self.words
        tops = [self._top(self.words, fold, 1, most).agg(F.lit(most).alias("most"), F.count(F.lit(1)).alias("n"), F.min("total").alias("least")) for fold, most in sorted(paired.items())]
        least = min(r["least"] if r["n"] == r["most"] else MIN_DF for r in reduce(DataFrame.unionByName, tops).collect())
        if self.pairs is None or least < self.pairs[0]:
            self.pairs = least, self._pairs(least)
        return self.words.unionByName(self.pairs[1])

    def _pairs(self, least: int) -> DataFrame:
        frequent = self.words.filter(self._all("total") >= least).select("term")
        words = sorted(r["term"] for r in frequent.limit(PAIR_WORDS + 1).collect())
        if len(words) > PAIR_WORDS:  # so many of one low total that they are no short list
            return self._by_fold(term_sums(self.counted, 2, "fold").filter("n = 2"), "term", "n")
        found = self._by_fold(pair_sums(self.counted, words, "fold"), "pair").filter(self._all("total") >= least)
        listed = self.spark.createDataFrame(list(enumerate(words)), "number bigint, word string")
        left, right = (F.broadcast(listed.toDF(f"{side}_number", f"{side}_word")) for side in ("left", "right"))
        size = F.lit(max(len(words), 1))
        numbered = found.withColumns({"left_number": F.floor(F.col("pair") / size), "right_number": F.col("pair") % size})
        return numbered.join(left, "left_number").join(right, "right_number").select(
            F.concat_ws(" ", "left_word", "right_word").alias("term"), F.lit(2).alias("n"), *self.words.columns[2:])

    def train_counts(self, fold: int) -> np.ndarray:
        """Training rows of each class when ``fold`` is left out (-1: none is)."""
        return np.array([sum(n for (f, own), n in self.sizes.items() if own == label and f != fold) for label in self.classes], float)

    def _top(self, frequencies: DataFrame, fold: int, max_n: int, max_features: int) -> DataFrame:
        rest = [f for f in range(max(self.k, 1)) if f != fold]
        n = int(self.train_counts(fold).sum())
        train = (frequencies.filter(F.col("n") <= max_n)
                 .select("term", sum(F.col(f"df_{f}") for f in rest).alias("df"), sum(F.col(f"total_{f}") for f in rest).alias("total")))
        return top_terms(train.filter((F.col("df") >= MIN_DF) & (F.col("df") <= MAX_DF * n)), max_features).select("term", "df", "total")

    def rows(self, vector_sets: list[tuple[int, int, int]]) -> tuple[SparseRows, np.ndarray]:
        """The written rows for vector sets ``(left-out fold, max_features, max_n)``, and the terms that their ``idx`` number.

        A smaller vocabulary is the head of a larger one of the same fold and n, so one job finds all; the driver holds ``max_features`` terms
        for each fold and n.
        """
        widest: dict[tuple[int, int], int] = {}
        for fold, max_features, max_n in vector_sets:
            widest[fold, max_n] = max(max_features, widest.get((fold, max_n), 0))
        frequencies = self.frequencies(widest)
        tops = [self._top(frequencies, fold, max_n, most).select(F.lit(fold).alias("fold"), F.lit(max_n).alias("max_n"), "term", "df", "total")
                for (fold, max_n), most in sorted(widest.items())]
        found: dict[tuple[int, int], list] = {key: [] for key in widest}
        for r in reduce(DataFrame.unionByName, tops).collect():
            found[r["fold"], r["max_n"]].append((-r["total"], r["term"], r["df"]))
        terms = np.array(sorted({term for rows in found.values() for _, term, _ in rows}), object)
        place = {term: i for i, term in enumerate(terms)}
        idf = np.zeros((len(vector_sets), len(terms)))
        for s, (fold, max_features, max_n) in enumerate(vector_sets):
            n = self.train_counts(fold).sum()
            for _, term, df in sorted(found[fold, max_n])[:max_features]:
                idf[s, place[term]] = np.log((n + 1) / (df + 1)) + 1
        return self._written(terms, idf), terms

    def _written(self, terms: np.ndarray, idf: np.ndarray) -> SparseRows:
        counts = np.stack([self.train_counts(f) for f in [*range(self.k), -1]])
        totals = counts.sum(axis=1)
        present = (counts > 0).sum(axis=1)  # classes that a fit has rows of
        weights = np.divide(totals[:, None], present[:, None] * counts, out=np.zeros_like(counts), where=counts > 0)
        names = F.array(*[F.lit(c) for c in self.classes])
        source, cut_slices = cut_of(self.counted)
        labelled = self.counted.select("id", "label", (F.array_position(names, F.col("label")) - 1).cast("int").alias("y"),
                                       F.col("fold").cast("int").alias("fold"), source.alias("_cut"))
        shared, max_n = self.spark.sparkContext.broadcast((Vocabulary(terms.tolist()), idf)), self.max_n
        ship(self.spark)
        numbers = ArrayType(DoubleType())
        schema = labelled.select("id", "label", "y", "fold").schema.add("idx", ArrayType(IntegerType())).add("tf", numbers).add("norms", numbers)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, idf = shared.value
            for part, row, tokens in cut_slices(batches, 4):
                owner, place, times = known.found(row, tokens, max_n)
                tf = 1 + np.log(times)
                norms = np.zeros((part.num_rows, len(idf)))
                for s, weight in enumerate(idf):
                    norms[:, s] = np.sqrt(np.bincount(owner, (tf * weight[place])**2, part.num_rows))
                sets = pa.array(np.arange(0, norms.size + 1, len(idf)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(4)), listed(owner, pa.array(place, pa.int32()), part.num_rows),
                     listed(owner, pa.array(tf), part.num_rows), pa.ListArray.from_arrays(sets, pa.array(norms.ravel()))], schema.names)

        size = self.words.agg(F.sum(self._all("total"))).first()[0] or 0
        tasks = max(1, min(-(-size // TASK_TERMS), self.spark.sparkContext.defaultParallelism))
        # Neighbours of one class have more terms in common, so the solver's blocks are denser.
        table = materialize(labelled.mapInArrow(vectors, schema).repartition(tasks).sortWithinPartitions("y"), "sparse-rows")
        return SparseRows(table, self.classes, idf, weights, totals)

    def fit_all(self, candidates: list[Candidate], folds: list[int], tolerance: float = TOLERANCE) -> tuple[SparseRows, np.ndarray, list[Fit], list[Fitted]]:
        """Every candidate on every left-out fold, candidates first; all in step."""
        sets = sorted({(fold, c.max_features, c.max_n) for c in candidates for fold in folds})
        rows, terms = self.rows(sets)
        fits = [Fit(sets.index((fold, c.max_features, c.max_n)), fold, c.c) for c in candidates for fold in folds]
        return rows, terms, fits, train_logreg(rows, fits, tolerance)

    def predictions(self, rows: SparseRows, fits: list[Fit], fitted: list[Fitted]) -> DataFrame:
        """``(fit, id, y_true, y_pred, proba)`` of held-out rows."""
        names = F.array(*[F.lit(c) for c in self.classes])
        return held_out(rows, fits, fitted).select(
            "fit", "id", F.col("label").alias("y_true"), E.predicted_label(F.col("proba"), names).alias("y_pred"), "proba")


def fit_classifier(df: DataFrame, candidate: Candidate = Candidate(), tolerance: float = TOLERANCE) -> ClassifierModel:
    """Fit one candidate on all samples ``(id, label, text)``."""
    samples = FoldedSamples(df, 0, max_n=candidate.max_n)
    rows, terms, _, (fitted,) = samples.fit_all([candidate], [-1], tolerance)
    listed = [(str(term), i, float(rows.idf[0, i]), fitted.coef[i].tolist()) for i, term in enumerate(terms)]
    table = samples.spark.createDataFrame(listed, "term string, idx int, idf double, coef array<double>")
    return ClassifierModel(materialize(table, "model"), fitted.intercept.tolist(), samples.classes, candidate.params())


def optimality(df: DataFrame, candidate: Candidate = Candidate()) -> DataFrame:
    """How far a fit on ``df`` is from its optimum: ``(class, intercept_residual, coef_residual)``, the largest absolute gradient.

    At the optimum the weighted errors of a class add up to 0, and a coefficient is -C times the weighted errors times its feature.
    The probabilities are those of ``scoring``, so the check shares no code with the solver.
    """
    model = fit_classifier(df, candidate)
    k = len(model.classes)
    weights = balanced_weights(df).agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("w"), F.sum(F.col("n") * F.col("weight")).alias("total"))
    by_label, total = weights.first()
    cut = with_tokens(df.select("id", "label", "text"))
    proba = S.predict_proba(S.vectorize(df, model), model).select("id", "proba")
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in by_label.items() for x in pair]), F.col("label"))
    errors = [((F.get("proba", F.lit(j)) - (F.col("label") == F.lit(c)).cast("double")) * weight / total).alias(f"e{j}") for j, c in enumerate(model.classes)]
    scored = materialize(weight_arrays(cut, model.terms, candidate.max_n).join(proba, "id").select("features", *errors), "errors")
    names = F.array(*[F.lit(c) for c in model.classes])
    free = scored.select(F.posexplode(F.array(*[f"e{j}" for j in range(k)])).alias("k", "e")).groupBy("k").agg(
        F.abs(F.sum("e")).alias("intercept_residual"))
    slope = (scored.select(F.explode("features").alias("x"), *[f"e{j}" for j in range(k)])
             .groupBy(F.col("x.idx").alias("idx")).agg(F.array(*[F.sum(F.col(f"e{j}") * F.col("x.w")) for j in range(k)]).alias("g")))
    bound = (model.terms.select("idx", "coef").join(slope, "idx", "left").select(F.posexplode(F.zip_with(
        "coef", F.coalesce("g", F.array_repeat(F.lit(0.0), k)), lambda c, g: F.abs(c / (candidate.c * total) + g))).alias("k", "r"))
        .groupBy("k").agg(F.max("r").alias("coef_residual")))
    return free.join(bound, "k").select(F.get(names, "k").alias("class"), "intercept_residual", "coef_residual")


class MetricEvaluator(Evaluator):
    """Score a prediction table by the name of its metric."""

    scorers = {"f1_macro": E.macro_f1, "f1_weighted": E.weighted_f1, "accuracy": lambda preds, classes, by=(): E.accuracy(preds, by)}

    def __init__(self, metric: str = "f1_macro", classes: list[str] | None = None):
        super().__init__()
        self.metric, self.classes = metric, classes

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.scorers[self.metric](dataset, self.classes).first()[0])

    def by(self, dataset: DataFrame, *keys: str) -> DataFrame:
        """One row ``(*keys, score)`` for each value of ``keys``, all in one pass."""
        return self.scorers[self.metric](dataset, self.classes, keys).toDF(*keys, "score")


def out_of_fold(df: DataFrame, candidate: Candidate = Candidate(), k: int = FOLDS, seed: int = SEED, tolerance: float = TOLERANCE) -> DataFrame:
    """Every sample predicted by a model that never saw it: ``(id, y_true, y_pred, proba)``. The folds are fitted in step."""
    samples = FoldedSamples(df, k, seed, candidate.max_n)
    rows, _, fits, fitted = samples.fit_all([candidate], list(range(k)), tolerance)
    return materialize(samples.predictions(rows, fits, fitted).drop("fit"), "held-out")


def grid_search(df: DataFrame, candidates: list[Candidate] | None = None, k: int = FOLDS, seed: int = SEED,
                scoring: str = "f1_macro") -> tuple[DataFrame, Candidate]:
    """Score every candidate on every fold: ``(candidate, max_features, max_n, c, fold, score)`` and the best one.

    All fits are in step: one job for each round of the solver, whatever the number of candidates and folds, and one job for all scores.
    """
    candidates = candidates or full_grid()
    samples = FoldedSamples(df, k, seed, max(c.max_n for c in candidates))
    rows, _, fits, fitted = samples.fit_all(candidates, list(range(k)))
    scored = MetricEvaluator(scoring, samples.classes).by(materialize(samples.predictions(rows, fits, fitted), "grid-predictions"), "fit")
    by_fit = {r["fit"]: float(r["score"]) for r in scored.collect()}
    scores = [(j // k, candidates[j // k].max_features, candidates[j // k].max_n, candidates[j // k].c, fit.fold, by_fit.get(j, 0.0)) for j, fit in enumerate(fits)]
    mean = {i: sum(s[5] for s in scores if s[0] == i) / k for i in range(len(candidates))}
    best = candidates[max(mean, key=lambda i: (mean[i], -i))]
    table = df.sparkSession.createDataFrame(
        scores, "candidate int, max_features int, max_n int, c double, fold int, score double")
    return table, best


def grid_results(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores per candidate, rounded to four places."""
    return scores.groupBy("candidate", "max_features", "max_n", "c").agg(
        F.round(F.avg("score"), 4).alias("cv_f1_mean"), F.round(F.stddev_pop("score"), 4).alias("cv_f1_std"))


def refit_best(df: DataFrame, best: Candidate, tolerance: float = TOLERANCE) -> ClassifierModel:
    """The candidate that a search found, fitted on all samples."""
    return fit_classifier(df, best, tolerance)


def training_manifest(spark: SparkSession, df: DataFrame, best: Candidate, metrics: DataFrame, data_path: str = "",
                      k: int = FOLDS, seed: int = SEED, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """One row that says which data and settings gave which scores."""
    counts = {r["label"]: r["n"] for r in class_counts(df).collect()}
    scores = {r["metric"]: r["value"] for r in metrics.collect()}
    digest = dataset_fingerprint(df, ["id", "label", "text"]).first()["fingerprint"]
    row = (datetime.now(timezone.utc), spark.version, data_path, digest, sum(counts.values()), counts, k, threshold, seed,
           best.params(), scores)
    return spark.createDataFrame([row], MANIFEST)
