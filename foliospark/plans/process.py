"""The whole way of a batch of documents: classify, extract, check, store, log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import extraction, registry, scoring, storage, validation
from foliospark.operators.scoring import ClassifierModel
from foliospark.schemas import MAX_RETRIES
from foliospark.session import materialize


@dataclass
class Processed:
    outcomes: DataFrame
    events: DataFrame
    attempts: DataFrame
    tables: dict[str, DataFrame]


def process_documents(texts: DataFrame, known: DataFrame, model: ClassifierModel,
                      factory: Callable[[], extraction.Client], extractor_model: str, max_retries: int = MAX_RETRIES,
                      concurrency: int | None = None, ledger: extraction.Ledger | None = None) -> Processed:
    """Run ``texts(document_id, text)`` against the registry ``known(document_id)``.

    Failures are rows; a record that its tables cannot hold fails as a whole, with the reason. Documents of no interest are filtered before the calls; the calls are written before their
    results fan out to the tables and the status log, and a ``ledger`` keeps them for a replay. Long texts are read in parts and
    become one record.
    """
    registered = texts.join(known.select("document_id"), "document_id", "left_semi")
    labels = materialize(
        scoring.classify(registered.withColumnRenamed("document_id", "id"), model).withColumnRenamed("id", "document_id"),
        "labels")
    wanted, _ = scoring.route(labels)
    # Written once: requests, retries and the test for short texts then read rows and move no text.
    to_read = materialize(registered.join(wanted.select("document_id", "doc_type"), "document_id"), "to-read")
    requests = extraction.build_requests(to_read, extractor_model)
    attempts = extraction.extract(requests, factory, max_retries, concurrency, ledger)

    records = materialize(extraction.merged_records(attempts, max_retries), "records")
    checked = materialize(storage.with_reject_reason(validation.validate(records.filter(F.col("parse_error").isNull()).drop("parse_error"))), "validated")
    incomplete = records.filter(F.col("parse_error").isNotNull()).select(
        "document_id", F.concat(F.lit(f"Extraction failed after {1 + max_retries} attempts: "), "parse_error").alias("error"))
    too_short = (to_read.select("document_id", extraction.extractable_error(F.col("text")).alias("exception"))
                 .filter(F.col("exception").isNotNull()))
    failed = extraction.extraction_failures(attempts, max_retries).unionByName(incomplete).withColumnRenamed("error", "exception")
    rejected = checked.filter(F.col("reject_reason").isNotNull()).select(
        "document_id", F.col("reject_reason").alias("exception"), F.lit("validating").alias("stage"))
    stopped = too_short.unionByName(failed).withColumn("stage", F.lit("extracting")).unionByName(rejected)

    results = (labels.join(checked.select("document_id", F.col("validation.errors").alias("errors")), "document_id", "left")
               .join(stopped, "document_id", "left"))
    outcomes = registry.final_outcome(results, known)
    trail = registry.status_trail(outcomes)
    confidence = trail.join(labels.select("document_id", "confidence"), "document_id")
    events = registry.status_event(
        confidence, F.col("status"), doc_type=F.col("doc_type"),
        confidence=F.when(F.col("status") == "extracting", F.col("confidence")),
        error=F.col("error_message"), seq=F.col("seq"))
    return Processed(outcomes, events, attempts, storage.route_store(checked))


