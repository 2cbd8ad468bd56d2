"""Cleaning and packing of a document collection, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all of ``docs``; all but the last return the columns of ``documents``
(doc_id, text, lang, source, n_chars), with n_chars counted anew where the text has changed.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import language, line_dedup, near_dup, packing, pii
from foliospark.session import materialize, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of one packed sequence.
CAPACITY = 8192


def _documents(df: DataFrame, text: Column | None = None, lang: Column | None = None) -> DataFrame:
    """The columns of ``documents``, in their types; n_chars belongs to the text that is handed on."""
    if text is not None:
        df = df.withColumns({"text": text, "n_chars": F.length(text).cast(df.schema["n_chars"].dataType)})
    if lang is not None:
        df = df.withColumn("lang", lang)
    return df.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without text or letters go. A missing ``lang`` is filled in."""
    judged = language.identify(docs).filter(F.col("lang_pred") != "und")
    return _documents(judged, lang=F.coalesce("lang", "lang_pred"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more that five documents share stay in the largest doc_id only. No document goes."""
    kept = line_dedup.drop_lines(docs)
    return _documents(kept, text=F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 and more."""
    groups = near_dup.near_duplicates(docs, words=5)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced in the text. No document goes."""
    clean = pii.sanitise(docs)
    return _documents(clean, text=F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in byte sequences of fixed size: ``(bin_id, doc_id, piece, start, size, bin_offset)``."""
    return packing.pack(docs, F.octet_length("text"), CAPACITY, cluster=packing.copies(F.col("text")))


def _shipped(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in (
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("best_fit_packing", pack_sequences),
)]
#: Language profiles, near copies and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
