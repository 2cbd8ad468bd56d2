"""Streamed registrations against the batch fold: any order, deletions, and what happens once a deletion has expired."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from foliospark.operators import registry as R
from foliospark.session import shared_folder
from foliospark.streaming.registration import registrations, stream_registrations, write_registrations

SCHEMA = "document_id string, filename string, s3_key string, status string, doc_type string, classification_confidence string, error_message string, t long, seq int, deleted boolean"
COLUMNS = ["document_id", "status", "filename", "s3_key", "doc_type", "classification_confidence", "error_message", "created_at", "updated_at"]


def event(document, t, status="uploaded", filename=None, deleted=False, seq=0):
    return (document, filename, None, None if deleted else status, None, None, None, t, seq, deleted)


def feed(spark, parts, lateness, retention):
    """Each part is one run of the stream; the states after every run."""
    arrived, target, checkpoint = (shared_folder(spark, n) for n in ("arrivals", "registrations", "checkpoint"))
    states = []
    for part in parts:
        frame = spark.createDataFrame(part, SCHEMA).withColumn("event_time", F.timestamp_seconds("t")).drop("t")
        frame.coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(frame.schema).parquet(arrived)
        write_registrations(stream_registrations(stream, lateness, retention), target, checkpoint).awaitTermination()
        states.append(rows(registrations(spark, target)))
    return states


def rows(df):
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in df.collect())


def test_same_as_the_batch_fold_in_any_order(spark):
    rng, events = random.Random(5), []
    for d in range(20):
        for s in range(rng.randint(1, 6)):
            events.append(event(f"d{d}", 1000 + rng.randint(1, 9) * 100 + len(events), rng.choice(["uploaded", "completed", "failed"]), rng.choice(["f", "g", None]), seq=s))
    gone = [event(f"d{d}", rng.randint(1000, 2000), deleted=True) for d in (1, 4, 9)] + [event("never seen", 1500, deleted=True)]
    without = [event(None, 1200), event("d2", None)]
    shuffled = events + gone + without
    rng.shuffle(shuffled)
    parts = [shuffled[i::3] for i in range(3)]
    day = timedelta(days=1)
    log = spark.createDataFrame(events, SCHEMA).withColumn("event_time", F.timestamp_seconds("t"))
    want = rows(R.delete_documents(R.current_status(log), spark.createDataFrame(gone, SCHEMA)))
    assert feed(spark, parts, day, day)[-1] == want and len(want) == 17


def test_expired_deletions_are_not_undone_by_late_events(spark):
    """Past watermark and retention the mark is gone; late events are dropped, and only a newer one registers the id anew."""
    lateness, retention = timedelta(seconds=10), timedelta(seconds=100)
    parts = [
        [event("a", 1000, filename="f"), event("b", 1000)],
        [event("a", 1010, deleted=True)],
        [event("a", 1012, "completed"), event("b", 1500, "completed")],  # watermark 1490: the mark expires at 1112
        [event("a", 1300, "late"), event("b", 1501, "failed")],
        [event("a", 1600, "anew")],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    first, second, third, fourth, fifth = [{r[0]: r[1] for r in state} for state in feed(spark, parts, lateness, retention)]
    assert first == {"a": "uploaded", "b": "uploaded"} and second == {"b": "uploaded"}
    assert third == {"b": "completed"} and fourth == {"b": "failed"} and fifth == {"a": "anew", "b": "failed"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
