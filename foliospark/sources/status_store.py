"""A status store in files: a folded base, the changes since, both in buckets by document.

A row of the store keeps every value with the time of the event that set it, so rows fold in any order and any number of times: base and
changes, late events and batches that are written again give the same state. A deletion is such a value too, and stays: events that
arrive later, of whatever time, do not bring a document back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONAL = ["filename", "s3_key", "doc_type", "classification_confidence", "error_message"]
AT = "struct<event_time:timestamp,seq:int>"
ROW = ", ".join(["document_id string", "status string", f"status_at {AT}", *(f"{c} string, {c}_at {AT}" for c in OPTIONAL),
                 "created_at timestamp", "updated_at timestamp", "deleted boolean", "bucket int"])
HEAD = "version bigint, folder string, through_batch bigint, buckets int"


def rows_of(events: DataFrame) -> DataFrame:
    """Status events as rows of the store, not folded yet."""
    at = F.struct("event_time", F.col("seq").cast("int").alias("seq"))
    values = [x for c in OPTIONAL for x in (F.col(c).cast("string").alias(c), F.when(F.col(c).isNotNull(), at).alias(f"{c}_at"))]
    return events.select(F.col("document_id").cast("string").alias("document_id"), "status", at.alias("status_at"), *values,
                         F.col("event_time").alias("created_at"), F.col("event_time").alias("updated_at"), F.lit(False).alias("deleted"))


def fold(rows: DataFrame) -> DataFrame:
    """One row per document: of each value the one set last, the first and last time, and whether it is deleted."""
    last = [x for c in ["status", *OPTIONAL] for x in (F.max_by(c, f"{c}_at").alias(c), F.max(f"{c}_at").alias(f"{c}_at"))]
    return rows.groupBy("document_id").agg(*last, F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.bool_or("deleted").alias("deleted"))


@dataclass(frozen=True)
class StatusStore:
    """Status events below ``path``: ``write`` changes batch by batch, ``compact`` now and then, read ``state`` or ``lookup``."""

    spark: SparkSession
    path: str
    buckets: int = 256

    def _bucket(self, document_id: Column) -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, batch_id: int) -> None:
        kept = fold(rows).withColumn("bucket", self._bucket(F.col("document_id")))
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/changes/batch={batch_id}")

    def write(self, events: DataFrame, batch_id: int) -> None:
        """The changes of a batch; ids rise. A batch that is written again replaces what it wrote."""
        self._put(rows_of(events), batch_id)

    def delete(self, ids: DataFrame, batch_id: int) -> None:
        """Documents that are gone for good, as a batch of their own."""
        given = {"document_id": F.col("document_id").cast("string"), "deleted": F.lit(True)}
        fields = self.spark.createDataFrame([], ROW).drop("bucket").schema.fields
        self._put(ids.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]), batch_id)

    def _read(self, folder: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def head(self):
        """The newest base: its folder and the last batch in it; None before the first compaction."""
        heads = self._read("heads", HEAD)
        newest = heads.orderBy(F.col("version").desc()).first() if heads is not None else None
        if newest and newest["buckets"] != self.buckets:
            raise ValueError(f"the store has {newest['buckets']} buckets")
        return newest

    def rows(self) -> DataFrame:
        """Rows of the base and of the batches after it, to be folded. Folders of older batches are not read."""
        head, changes = self.head(), self._read("changes", f"{ROW}, batch bigint")
        parts = [self._read(head["folder"], ROW)] if head else []
        if changes is not None:
            parts.append((changes.filter(F.col("batch") > head["through_batch"]) if head else changes).drop("batch"))
        if not parts:
            return self.spark.createDataFrame([], ROW)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def state(self, rows: DataFrame | None = None) -> DataFrame:
        """One row per document that is not deleted: status, its last set values, first and last time."""
        known = fold(self.rows() if rows is None else rows).filter(~F.col("deleted") & F.col("status").isNotNull())
        return known.select("document_id", "status", *OPTIONAL, "created_at", "updated_at")

    def lookup(self, document_id: str) -> DataFrame:
        """One document: only its bucket of the base and of each later batch is read."""
        key = F.lit(str(document_id))
        return self.state(self.rows().filter((F.col("bucket") == self._bucket(key)) & (F.col("document_id") == key)))

    def compact(self, through_batch: int) -> None:
        """Fold the base and the batches up to ``through_batch`` into a new base, which counts once its head is written."""
        head, changes = self.head(), self._read("changes", f"{ROW}, batch bigint")
        since = F.col("batch") > (head["through_batch"] if head else -(1 << 62))
        parts = [self._read(head["folder"], ROW)] if head else []
        if changes is not None:
            parts.append(changes.filter(since & (F.col("batch") <= through_batch)).drop("batch"))
        if not parts:
            return
        version, folder = (head["version"] + 1 if head else 1), f"base/run={uuid.uuid4().hex}"
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        folded = fold(rows).withColumn("bucket", self._bucket(F.col("document_id")))
        folded.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        last = max(through_batch, head["through_batch"]) if head else through_batch
        self.spark.createDataFrame([(version, folder, last, self.buckets)], HEAD).coalesce(1).write.mode("append").parquet(f"{self.path}/heads")
