"""The same operators on arriving files and status events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.extraction import Ledger
from foliospark.operators.registry import current_status
from foliospark.plans.process import Processed
from foliospark.session import materialize
from foliospark.sources.documents import BINARY_FILE, PDF_GLOB, split_document_key
from foliospark.sources.sinks import publish


def stream_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New PDF objects below ``path`` with their document id and file name."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", PDF_GLOB)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path))
    return split_document_key(files)


def stream_status(events: DataFrame) -> DataFrame:
    """Current state per document over a stream of status events (update mode).

    The fold takes the times from the rows, so events may arrive in any order. One small state row per document is
    kept for as long as the document is registered, hence no watermark.
    """
    return current_status(events)


def write_changes(state: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what every micro-batch changed to its own folder: a replayed batch replaces its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())


def latest_state(spark: SparkSession, target: str) -> DataFrame:
    """The newest row per document among the written changes."""
    changes = spark.read.parquet(target)
    columns = [c for c in changes.columns if c not in ("document_id", "batch")]
    row = F.max_by(F.struct(*columns), "batch").alias("r")
    return changes.groupBy("document_id").agg(row).select("document_id", "r.*")


def stream_process(documents: DataFrame, process: Callable[..., Processed], target: str,
                   checkpoint: str, ledger: str | None = None) -> StreamingQuery:
    """Run every micro-batch of ``documents`` through ``process(batch)`` and publish its tables, events and outcomes together.

    A batch is read from its source once. With a ``ledger`` folder ``process`` is called as ``process(batch, Ledger)``, so that a replayed
    batch finds the calls it has paid for; ``sinks.published`` reads each batch once, however often it ran.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        held = materialize(batch, "micro-batch")
        result = process(held, Ledger(ledger, batch_id)) if ledger else process(held)
        publish({**result.tables, "status_events": result.events, "outcomes": result.outcomes}, target, batch_id)

    return (documents.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(run).trigger(availableNow=True).start())
