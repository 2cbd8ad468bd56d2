"""Document status: an append-only event table and the state folded from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.numbers import number_text
from foliospark.functions.rows import explode_rows
from foliospark.schemas import ERROR_TEXT_LIMIT, EXTRACTABLE_TYPES, SKIPPED_TYPES, STATUS_EVENT


def _event(df: DataFrame, **values: Column) -> DataFrame:
    columns = {f.name: values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STATUS_EVENT.fields}
    return df.select(*columns.values())


def register(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """First event of every document ``(document_id, filename, s3_key)``: status ``uploaded``."""
    return _event(docs, document_id=F.col("document_id"), filename=F.col("filename"), s3_key=F.col("s3_key"),
                  status=F.lit("uploaded"), event_time=F.current_timestamp() if now is None else now, seq=F.lit(0))


def status_event(df: DataFrame, status: Column | str, doc_type: Column | None = None,
                 confidence: Column | None = None, error: Column | None = None,
                 now: Column | None = None, seq: Column | None = None) -> DataFrame:
    """One update per row of ``df(document_id)``. What is left out, or NULL, does not overwrite anything."""
    null = F.lit(None)
    return _event(df, document_id=F.col("document_id"), status=F.lit(status) if isinstance(status, str) else status,
                  doc_type=null if doc_type is None else doc_type,
                  classification_confidence=null if confidence is None else number_text(confidence),
                  error_message=null if error is None else error,
                  event_time=F.current_timestamp() if now is None else now,
                  seq=F.lit(0) if seq is None else seq)


def fold_columns(order: Column) -> list[Column]:
    """Aggregates that fold events to a state: latest status, last non-NULL optional values, first time seen.

    They do not depend on arrival order and combine before the shuffle, in batch as in a stream.
    """
    optional = ["filename", "s3_key", "doc_type", "classification_confidence", "error_message"]
    last_set = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in optional]
    return [F.max_by("status", order).alias("status"), *last_set,
            F.min("event_time").alias("created_at"), F.max("event_time").alias("updated_at")]


def current_status(log: DataFrame) -> DataFrame:
    """One row per document from the event table."""
    return log.groupBy("document_id").agg(*fold_columns(F.struct("event_time", "seq")))


def get_document(state: DataFrame, document_id: str) -> DataFrame:
    return state.filter(F.col("document_id") == document_id)


def query_by_status(state: DataFrame, status: str, limit: int = 20) -> DataFrame:
    """Newest documents of a status: each partition keeps its own top rows, no full sort."""
    return state.filter(F.col("status") == status).orderBy(F.col("created_at").desc(), "document_id").limit(limit)


def list_documents(state: DataFrame, limit: int = 20, offset: int = 0, after: tuple | None = None) -> DataFrame:
    """One page, newest first. The offset is applied.

    ``after`` is the ``(created_at, document_id)`` of the last row seen: the page behind it costs the same at any depth,
    while an offset makes the driver hold all rows before the page.
    """
    if after is not None:
        created, key = F.lit(after[0]), F.lit(after[1])
        state = state.filter((F.col("created_at") < created) | ((F.col("created_at") == created) & (F.col("document_id") > key)))
    return state.orderBy(F.col("created_at").desc(), "document_id").offset(offset).limit(limit)


def delete_documents(state: DataFrame, ids: DataFrame) -> DataFrame:
    """The registry without the given ids; extraction tables are not touched."""
    return state.join(ids.select("document_id"), "document_id", "left_anti")


def document_detail(state: DataFrame, error_chars: int = ERROR_TEXT_LIMIT) -> DataFrame:
    """The public view of a document: defaults filled in, the stored confidence text as a number, ``error_chars`` of its error."""
    confidence = F.col("classification_confidence")
    return state.select(
        "document_id",
        F.coalesce("filename", F.lit("")).alias("filename"),
        F.coalesce("s3_key", F.lit("")).alias("s3_key"),
        "doc_type",
        F.coalesce("status", F.lit("uploaded")).alias("status"),
        F.when(confidence != "", confidence.try_cast("double")).alias("classification_confidence"),
        F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("created_at"),
        F.coalesce(F.col("updated_at").cast("string"), F.lit("")).alias("updated_at"),
        F.left("error_message", F.lit(error_chars)).alias("error_message"),
    )


# --- outcome of processing --------------------------------------------------------------------------------

def failure_message(errors: Column, exception: Column) -> Column:
    """Why a document failed: the whole exception text, else its validation errors."""
    return (F.when(exception.isNotNull(), exception)
            .when(F.size(errors) > 0, F.concat(F.lit("Validation errors: "), F.array_join(errors, "; "))))


def final_outcome(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Outcome per processed document: ``results(document_id, doc_type, errors, exception)``.

    ``errors`` is an array, empty for a record that passed. An extractable document with neither errors nor exception was
    never checked, and fails. Documents that the registry does not know are left out. ``other`` and ``unknown`` are completed unread.
    """
    skipped = F.col("doc_type").isin(SKIPPED_TYPES) & F.col("exception").isNull()
    unchecked = F.col("doc_type").isin(EXTRACTABLE_TYPES) & F.col("errors").isNull() & F.col("exception").isNull()
    message = F.when(~skipped, failure_message(F.col("errors"), F.when(unchecked, F.lit("No validation result")).otherwise(F.col("exception"))))
    known = results.join(registry.select("document_id"), "document_id", "left_semi")
    return (known.withColumn("error_message", message)
            .withColumn("outcome", F.when(F.col("error_message").isNull(), "completed").otherwise("failed"))
            .withColumn("stored", F.col("doc_type").isin(EXTRACTABLE_TYPES) & (F.col("outcome") == "completed")))


def status_trail(outcomes: DataFrame) -> DataFrame:
    """The events a document went through, numbered from 1.

    ``stage`` names the step that raised the exception, if one did: classifying, extracting or validating.
    """
    def step(name: str, when: Column) -> Column:
        return F.when(when, F.lit(name))

    stage, failed = F.col("stage"), F.col("outcome") == "failed"
    read = ~F.col("doc_type").isin(SKIPPED_TYPES)
    classified = F.coalesce(stage != "classifying", F.lit(True))
    extracted = classified & F.coalesce(stage != "extracting", F.lit(True)) & read
    steps = F.array(
        F.lit("classifying"), step("extracting", classified), step("validating", extracted),
        F.when(failed, F.lit("failed")).otherwise(F.lit("completed")))
    trail = F.filter(steps, lambda s: s.isNotNull())
    return (explode_rows(outcomes, trail, "status", "document_id", "doc_type", "error_message", position="pos")
            .select("document_id", (F.col("pos") + 1).alias("seq"), "status",
                    F.when(F.col("status") == "extracting", F.col("doc_type")).alias("doc_type"),
                    F.when(F.col("status") == "failed", F.col("error_message")).alias("error_message")))


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATUS_EVENT)
