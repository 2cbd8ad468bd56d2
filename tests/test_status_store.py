"""The status store against the fold of all events, in any order of writes, and what a lookup reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.operators import registry as R
from foliospark.sources.status_store import StatusStore

COLUMNS = ["document_id", "status", "filename", "s3_key", "doc_type", "classification_confidence", "error_message", "created_at", "updated_at"]


@pytest.fixture(scope="module")
def events(spark):
    rng, rows = random.Random(3), []
    for d in range(12):
        for s in range(rng.randint(1, 6)):
            rows.append((f"d{d}", rng.choice(["f", None]), rng.choice(["k", None]), rng.choice(["uploaded", "completed", "failed"]), rng.choice(["invoice", None]),
                         rng.choice(["0.5", None]), rng.choice(["boom", None]), rng.randint(1, 9) * 100 + len(rows), s))
    schema = "document_id string, filename string, s3_key string, status string, doc_type string, classification_confidence string, error_message string, t long, seq int"
    return spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds("t")).drop("t")


def rows(df):
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_any_order_and_any_compaction(spark, events, tmp_path, seed):
    rng = random.Random(seed)
    store, gone = StatusStore(spark, str(tmp_path), 4), spark.createDataFrame([("d1",), ("d2",), ("never seen",)], "document_id string")
    assert store.state().count() == 0 and store.lookup("d1").count() == 0
    parts = [0, 1, 2, "gone"]
    rng.shuffle(parts)
    for batch, part in enumerate(parts):
        if part == "gone":
            store.delete(gone, batch)
        else:
            chosen = events.filter(F.pmod(F.hash("event_time", "document_id"), F.lit(3)) == part)
            store.write(chosen.limit(0), batch)
            store.write(chosen, batch)  # the batch again
        if rng.random() < 0.6:
            store.compact(batch)
    want = rows(R.delete_documents(R.current_status(events), gone))
    assert rows(store.state()) == want
    store.compact(3)
    store.compact(3)
    assert rows(store.state()) == want and rows(store.lookup("d5")) == [r for r in want if r[0] == "d5"] and store.lookup("d1").count() == 0
    with pytest.raises(ValueError):
        StatusStore(spark, str(tmp_path), 8).state()


def test_a_lookup_reads_one_bucket_and_no_folded_batch(spark, events, tmp_path):
    store = StatusStore(spark, str(tmp_path), 16)
    store.write(events, 0)
    store.compact(0)
    store.write(events.limit(5), 1)
    plan = store.lookup("d3")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = \d+\)", plan)) == 2
    assert re.search(r"PartitionFilters: \[[^\]]*\(batch#\d+L > 0\)", plan)
    files = store.rows().filter(F.col("bucket") == F.lit(3)).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("bucket=3/" in r["f"] for r in files) and not any("batch=0" in r["f"] for r in files)
