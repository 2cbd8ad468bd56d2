"""Training samples and vocabulary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.schemas import DOCUMENT_CLASSES, SAMPLE

VOCABULARY = "map<string,array<string>>"


def check_samples(samples: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Fail when there are no samples or their labels are not exactly the expected classes.

    One aggregate runs; it returns the count and at most one label more than expected.
    """
    wanted = sorted(classes or DOCUMENT_CLASSES)
    found = samples.groupBy("label").count().limit(len(wanted) + 1).collect()
    if not found:
        raise ValueError("empty training data")
    labels = sorted(str(row["label"]) for row in found)
    if labels != wanted:
        raise ValueError(f"unexpected labels: {labels}")
    return samples


def load_samples(spark: SparkSession, path: str, classes: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Samples ``(id, label, text)`` from one JSON array or, with ``multi_line=False``, from JSON lines.

    A JSON array can only be read by one task per file; large sets belong in JSON lines or parquet.
    """
    return check_samples(spark.read.schema(SAMPLE).json(path, multiLine=multi_line), classes)


def save_samples(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.select("id", "label", "text").write.mode("overwrite").format(fmt).save(path)


def explode_vocab(df: DataFrame, column: str = "vocab", exclude: list[str] | None = None) -> DataFrame:
    """A map column category -> items to rows ``(category, item)``."""
    rows = df.select(F.explode(column).alias("category", "items")).select("category", F.explode("items").alias("item"))
    return rows.filter(~F.col("category").isin(exclude)) if exclude else rows


def load_vocab(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """A JSON object category -> item list, without the excluded categories."""
    text = spark.read.text(path, wholetext=True)
    return explode_vocab(text.select(F.from_json("value", VOCABULARY).alias("vocab")), "vocab", exclude)


def merge_vocab(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of both vocabularies, each once per category."""
    return a.select("category", "item").unionByName(b.select("category", "item")).dropDuplicates(["category", "item"])
