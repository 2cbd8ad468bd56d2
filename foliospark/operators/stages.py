"""The classifier as stages of an ML pipeline: fitted, tuned, saved and loaded with the stages of Spark ML."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import scoring as S
from foliospark.operators.training import Candidate, fit_classifier
from foliospark.schemas import CONFIDENCE_THRESHOLD


class _Columns(Params):
    idCol = Param(Params._dummy(), "idCol", "unique id of a document", TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "text of a document", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "class of largest probability", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "class, or unknown below the threshold", TypeConverters.toString)
    confidenceCol = Param(Params._dummy(), "confidenceCol", "probability of the class, 0 without a known term", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "smallest confidence of a class that is given out", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol="id", textCol="text", predictionCol="y_pred", outputCol="doc_type", confidenceCol="confidence", threshold=CONFIDENCE_THRESHOLD)


class DocumentClassifier(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """TF-IDF and logistic regression over ``(idCol, labelCol, textCol)``; rows without label take no part in the fit."""

    labelCol = Param(Params._dummy(), "labelCol", "class of a sample", TypeConverters.toString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "largest number of terms", TypeConverters.toInt)
    maxN = Param(Params._dummy(), "maxN", "1 for words, 2 for words and pairs of words", TypeConverters.toInt)
    c = Param(Params._dummy(), "c", "inverse of the penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, idCol="id", labelCol="label", textCol="text", predictionCol="y_pred", outputCol="doc_type", confidenceCol="confidence",
                 threshold=CONFIDENCE_THRESHOLD, maxFeatures=5000, maxN=2, c=1.0):
        super().__init__()
        self._setDefault(labelCol="label", maxFeatures=5000, maxN=2, c=1.0)
        self._set(**self._input_kwargs)

    def candidate(self) -> Candidate:
        return Candidate(self.getOrDefault("maxFeatures"), self.getOrDefault("maxN"), self.getOrDefault("c"))

    def _fit(self, dataset: DataFrame) -> DocumentClassifierModel:
        samples = dataset.select(*[F.col(self.getOrDefault(p)).alias(name) for p, name in (("idCol", "id"), ("labelCol", "label"), ("textCol", "text"))])
        model = DocumentClassifierModel(fit_classifier(samples, self.candidate()))
        model._resetUid(self.uid)
        return self._copyValues(model)


class _ModelWriter(MLWriter):
    def __init__(self, instance: DocumentClassifierModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        S.save_model(self.instance.classifier, f"{path}/data")


class _ModelReader(MLReader):
    def load(self, path: str) -> DocumentClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DocumentClassifierModel(S.load_model(self.sparkSession, f"{path}/data"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class DocumentClassifierModel(Model, _Columns, MLReadable, MLWritable):
    """Adds ``predictionCol``, ``outputCol`` and ``confidenceCol`` to the rows given, joined by their unique id.

    ``outputCol`` is what ``scoring.classify`` gives; ``predictionCol`` is the largest class whatever its confidence, as metrics need it.
    """

    def __init__(self, classifier: S.ClassifierModel | None = None):
        super().__init__()
        self.classifier = classifier

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = [self.getOrDefault(p) for p in ("predictionCol", "outputCol", "confidenceCol")]
        clash = sorted(set(names) & set(dataset.columns))
        if clash:
            raise ValueError(f"columns {clash} exist already")
        key = self.getOrDefault("idCol")
        texts = dataset.select(F.col(key).alias("id"), F.col(self.getOrDefault("textCol")).alias("text"))
        label, confidence = S.gated_label(self.getOrDefault("threshold"))
        scored = S.score(texts, self.classifier).select(F.col("id").alias(key), F.col("label").alias(names[0]), label.alias(names[1]), confidence.alias(names[2]))
        return dataset.join(scored, key, "left")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()
