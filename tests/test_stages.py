"""The classifier inside Spark ML: pipelines, their files, and tuning over given folds."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from foliospark.operators import scoring as S
from foliospark.operators import training as R
from foliospark.operators.stages import DocumentClassifier
from test_training import ROWS


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(ROWS, "id string, label string, text string").cache()


def rows(df):
    return sorted((r["id"], r["doc_type"], round(r["confidence"], 6)) for r in df.collect())


def test_a_pipeline_fits_saves_and_loads(spark, samples, tmp_path):
    raw = samples.withColumnsRenamed({"id": "key", "text": "body"}).withColumn("extra", F.lit(1))
    stage = DocumentClassifier(idCol="key", textCol="body", maxFeatures=50, threshold=0.4, outputCol="doc_type")
    pipeline = Pipeline(stages=[SQLTransformer(statement="SELECT * FROM __THIS__ WHERE label IS NOT NULL"), stage])
    pipeline.write().save(str(tmp_path / "unfitted"))
    model = Pipeline.load(str(tmp_path / "unfitted")).fit(raw)
    model.write().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    want = rows(S.classify(samples, R.fit_classifier(samples, R.Candidate(50, 2, 1.0)), 0.4))
    assert rows(again.transform(raw).withColumnRenamed("key", "id")) == rows(model.transform(raw).withColumnRenamed("key", "id")) == want
    assert {"extra", "body", "y_pred", "label"} <= set(again.transform(raw).columns)
    assert again.stages[1].uid == stage.uid == model.stages[1].uid and again.stages[1].getOrDefault("threshold") == 0.4


def test_odd_rows_and_clashing_columns(spark, samples):
    model = DocumentClassifier(maxFeatures=50).fit(samples.unionByName(spark.createDataFrame([("n", None, "no label")], samples.schema)))
    odd = spark.createDataFrame([("short", "invoice due"), ("strange", "zq " * 12), ("none", None), ("empty", "")], "id string, text string")
    assert {(r["doc_type"], r["confidence"]) for r in model.transform(odd).collect()} == {("unknown", 0.0)}
    assert model.transform(odd).filter("y_pred IS NULL").count() == 0 and model.transform(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="confidence"):
        model.transform(odd.withColumn("confidence", F.lit(1)))


def test_cross_validator_scores_as_the_grid_search(samples):
    """Folds given as a column: its scores are those of the search that fits all candidates in step."""
    grid = [R.Candidate(50, 1, 0.01), R.Candidate(5, 1, 10.0)]
    scores, best = R.grid_search(samples, grid, k=2, scoring="accuracy")
    folded = R.stratified_folds(samples, 2).join(samples.select("id", "text"), "id").withColumnRenamed("label", "y_true")
    stage = DocumentClassifier(labelCol="y_true", maxN=1)
    maps = [{stage.maxFeatures: c.max_features, stage.c: c.c} for c in grid]
    assert len(ParamGridBuilder().addGrid(stage.c, [0.1, 1.0]).build()) == 2
    found = CrossValidator(estimator=stage, estimatorParamMaps=maps, numFolds=2, foldCol="fold", evaluator=R.MetricEvaluator("accuracy", sorted({r[1] for r in ROWS}))).fit(folded)
    want = {r["candidate"]: r["m"] for r in scores.groupBy("candidate").agg(F.avg("score").alias("m")).collect()}
    assert [round(x, 9) for x in found.avgMetrics] == [round(want[i], 9) for i in range(2)]
    assert found.bestModel.classifier.params == best.params()
