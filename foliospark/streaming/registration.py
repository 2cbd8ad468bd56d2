"""Status of documents over a stream of events and deletions, as custom state with a timer for what is deleted."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from foliospark.session import ship
from foliospark.sources.status_store import OPTIONAL
from foliospark.streaming.streams import latest_state, write_changes

VALUES = ["status", *OPTIONAL]
#: One value of the state: what was set, and time and number of the event that set it.
STATE = ", ".join(["deleted boolean", "first bigint", "last bigint", *(f"{c} string, {c}_t bigint, {c}_s bigint" for c in VALUES)])
CHANGE = ", ".join(["document_id string", *(f"{c} string" for c in VALUES), "first bigint", "last bigint", "deleted boolean"])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Registration(StatefulProcessor):
    """Folds a document's events, whatever their order; a deletion clears its values and leaves a mark that expires."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("registration", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        deleted, first, last, *rest = self.state.get() if self.state.exists() else (False, None, None, *([None] * 3 * len(VALUES)))
        known = deleted
        values = {c: tuple(rest[3 * i:3 * i + 3]) for i, c in enumerate(VALUES)}
        for row in rows:
            deleted = deleted or row["deleted"]
            first, last = min(row["t"], row["t"] if first is None else first), max(row["t"], row["t"] if last is None else last)
            for c in VALUES:
                value, t, s = values[c]
                if row[c] is not None and (t is None or (row["t"], row["seq"]) > (t, s)):
                    values[c] = (row[c], row["t"], row["seq"])
        if deleted:
            values = dict.fromkeys(VALUES, (None, None, None))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.retention_ms)
        self.state.update((deleted, first, last, *(x for c in VALUES for x in values[c])))
        if not known:  # events after a deletion change nothing that a reader sees
            yield Row(document_id=key[0], **{c: values[c][0] for c in VALUES}, first=first, last=last, deleted=deleted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def deletions(ids: DataFrame, event_time) -> DataFrame:
    """Rows ``(document_id)`` as deletion events of the given time, to be joined to a stream of events by ``unionByName``."""
    given = {"document_id": F.col("document_id").cast("string"), "event_time": event_time, "seq": F.lit(0), "deleted": F.lit(True)}
    types = {"event_time": "timestamp", "seq": "bigint", "deleted": "boolean"}
    return ids.select(*[given.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in ("document_id", *VALUES, "event_time", "seq", "deleted")])


def stream_registrations(events: DataFrame, lateness: timedelta, retention: timedelta) -> DataFrame:
    """What every micro-batch changes: ``(document_id, status, ..., created_at, updated_at, deleted)``.

    ``events`` are status events, in any order, with a column ``deleted`` that marks deletions. A deletion removes its document whatever the
    times of its events are: ids are not used twice. Its mark is kept until the watermark (``lateness`` behind the newest event) is
    ``retention`` past the document's last event, deletion included, and then goes with all its state. Events behind the watermark are
    dropped, so what comes later does not revive a document, unless it is newer than that: choose ``retention`` longer than a document's
    events go on after its deletion. A document that is not deleted stays. Rows without id or time take no part; of two events of one
    time and number the one read first counts.
    """
    columns = [F.col(c).cast("string").alias(c) for c in ("document_id", *VALUES)]
    time = F.col("event_time").cast("timestamp")
    known = events.filter(F.col("document_id").isNotNull() & time.isNotNull()).select(
        *columns, time.alias("event_time"), F.unix_micros(time).alias("t"), F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("seq"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"))
    processor = Registration(int(retention.total_seconds() * 1000))
    changes = (known.withWatermark("event_time", f"{int(lateness.total_seconds())} seconds").groupBy("document_id")
               .transformWithState(statefulProcessor=processor, outputStructType=CHANGE, outputMode="Update", timeMode="EventTime"))
    return changes.select("document_id", *VALUES, F.timestamp_micros("first").alias("created_at"), F.timestamp_micros("last").alias("updated_at"), "deleted")


def write_registrations(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Start ``streams.write_changes`` with the state store that custom state needs; the session's own setting stays as it is."""
    spark = changes.sparkSession
    ship(spark)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return write_changes(changes, target, checkpoint)
    finally:
        spark.conf.set(PROVIDER, before)


def registrations(spark: SparkSession, target: str) -> DataFrame:
    """The documents that are registered, by the changes written so far."""
    return latest_state(spark, target).filter(~F.col("deleted")).drop("deleted")
