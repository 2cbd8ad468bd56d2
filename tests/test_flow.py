"""Sources, registry, storage, the whole way of a batch, and streams against their batch form."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import registry as R
from foliospark.operators import storage as S
from foliospark.operators.scoring import ClassifierModel
from foliospark.plans.process import process_documents
from foliospark.sources import documents as docs
from foliospark.sources import samples as smp
from foliospark.sources import sinks
from foliospark.streaming import streams


def put(folder, name, text="x"):
    path = folder / "documents" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def model(spark):
    """Two words per class decide."""
    classes = ["contract", "invoice", "other", "receipt"]
    rows = [(w, i, 1.0, [9.0 if c == k else 0.0 for c in classes])
            for i, (w, k) in enumerate([("party", "contract"), ("net", "invoice"), ("letter", "other"), ("cash", "receipt")])]
    return ClassifierModel(spark.createDataFrame(rows, "term string, idx int, idf double, coef array<double>"), [0.0] * 4, classes,
                           {"max_n": "1"})


FILLER = " one two three four five six seven eight nine ten eleven twelve"
TEXTS = [("good", "net" + FILLER), ("bad", "net vendorless" + FILLER), ("down", "cash broken" + FILLER),
         ("skip", "letter" + FILLER), ("short", "net"), ("gone", "net" + FILLER), ("deal", "party" + FILLER)]


def client_factory():
    def client(request):
        text = request["user_message"]
        if "broken" in text:
            raise RuntimeError("z" * 600)
        if request["doc_type"] == "contract":
            return json.dumps({"parties": ["A"], "key_terms": ["t"]}), 1, 1
        vendor = "" if "vendorless" in text else "Acme"
        items = [{"description": "a", "unit_price": 1, "amount": 1}, {"description": "b", "quantity": 2, "unit_price": 1, "amount": 2}]
        return json.dumps({"vendor_name": vendor, "line_items": items, "total_amount": 3}), 1, 1
    return lambda: client


def run(texts, model):
    known = texts.filter("document_id <> 'gone'")
    return process_documents(texts, known, model, client_factory(), "m")


EXPECTED = {
    "good": ["classifying", "extracting", "validating", "completed"], "bad": ["classifying", "extracting", "validating", "failed"],
    "down": ["classifying", "extracting", "failed"], "skip": ["classifying", "extracting", "completed"],
    "short": ["classifying", "extracting", "completed"], "deal": ["classifying", "extracting", "validating", "completed"]}


def trails(events):
    out = {}
    for r in events.orderBy("document_id", "seq").collect():
        out.setdefault(r["document_id"], []).append(r["status"])
    return out


def test_process_documents(spark, model):
    done = run(spark.createDataFrame(TEXTS, "document_id string, text string"), model)
    assert trails(done.events) == EXPECTED
    state = {r["document_id"]: r for r in R.current_status(done.events).collect()}
    assert state["bad"]["error_message"] == "Validation errors: Vendor name is empty"
    assert state["down"]["error_message"].startswith("Extraction failed after 2")
    assert state["short"]["doc_type"] == "unknown" and state["good"]["doc_type"] == "invoice"
    counts = {n: df.count() for n, df in done.tables.items()}
    assert counts == {"invoice_extractions": 1, "receipt_extractions": 0, "contract_extractions": 1, "line_items": 2, "rejected": 0}


def test_stream_process_equals_batch(spark, model, tmp_path):
    source = tmp_path / "in"
    frame = spark.createDataFrame(TEXTS, "document_id string, text string")
    frame.repartition(3).write.parquet(str(source))
    arriving = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    streams.stream_process(arriving, lambda b: run(b, model), target, checkpoint).awaitTermination()
    assert trails(spark.read.parquet(f"{target}/status_events")) == EXPECTED
    assert spark.read.parquet(f"{target}/line_items").count() == 2


def test_scan_and_stream_documents(spark, tmp_path):
    for name in ("1/a.pdf", "2/B.PDF", "3/c.txt"):
        put(tmp_path, name)
    batch = docs.split_document_key(docs.scan_documents(spark, str(tmp_path)))
    assert "content" not in batch.columns
    assert {(r["document_id"], r["filename"]) for r in batch.collect()} == {("1", "a.pdf"), ("2", "B.PDF")}
    out = str(tmp_path / "found")
    q = (streams.stream_documents(spark, str(tmp_path / "documents")).select("document_id", "filename").writeStream
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(out))
    q.awaitTermination()
    assert {(r["document_id"], r["filename"]) for r in spark.read.parquet(out).collect()} == {("1", "a.pdf"), ("2", "B.PDF")}


def test_long_documents_keep_page_order(spark):
    pages = spark.range(500).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("page_no"),
                                    F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("text")).repartition(5)
    want = "\n".join(str(i) if i % 7 else "" for i in range(500))
    assert docs.assemble_text(pages).first()["text"] == want


def test_samples_and_vocabulary(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"id": str(i), "label": c, "text": "t"} for i, c in enumerate(["invoice", "receipt", "contract", "other"])]))
    assert smp.load_samples(spark, str(path)).count() == 4
    with pytest.raises(ValueError, match="unexpected labels"):
        smp.load_samples(spark, str(path), ["invoice"])
    vocab = tmp_path / "v.json"
    vocab.write_text(json.dumps({"office": ["Pen", "Ink"], "grocery_receipt": ["Milk"]}))
    a = smp.load_vocab(spark, str(vocab), exclude=["grocery_receipt"])
    assert {tuple(r) for r in a.collect()} == {("office", "Pen"), ("office", "Ink")}
    b = spark.createDataFrame([("office", "Pen"), ("office", "Desk")], "category string, item string")
    assert smp.merge_vocab(a, b).count() == 3


def test_registry_keeps_set_values(spark):
    ids = spark.createDataFrame([("d", "f.pdf", "k")], "document_id string, filename string, s3_key string")

    def at(s):
        return F.lit(s).cast("timestamp")

    log = R.register(ids, now=at("2025-01-01 00:00:00"))
    log = log.unionByName(R.status_event(ids, "extracting", doc_type=F.lit("invoice"), confidence=F.lit(0.0), now=at("2025-01-01 00:00:01")))
    log = log.unionByName(R.status_event(ids, "completed", now=at("2025-01-01 00:00:02")))
    detail = R.document_detail(R.current_status(log.repartition(3))).first()
    assert (detail["status"], detail["doc_type"], detail["classification_confidence"]) == ("completed", "invoice", 0.0)
    assert detail["created_at"] == "2025-01-01 00:00:00" and detail["filename"] == "f.pdf" and detail["error_message"] is None


def test_written_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "uploaded"), ("b", "failed")], "document_id string, status string")
    sinks.write_extractions({"invoice_extractions": df}, str(tmp_path))
    sinks.write_status(df, str(tmp_path / "log"))
    sinks.write_status(df, str(tmp_path / "log"))
    sinks.write_state(df, str(tmp_path / "state"))
    sinks.write_report(df, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "invoice_extractions")).count() == 2
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    plan = spark.read.parquet(str(tmp_path / "state")).filter("status = 'failed'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_widths_are_enforced(spark):
    row = spark.createDataFrame([("x", "invoice", "d" * 501, 1.0, 1.0, 1.0, None)],
                                "extraction_id string, extraction_type string, description string, quantity double, unit_price double, amount double, category string")
    kept, rejected = S.length_limits(row, "line_items")
    assert kept.count() == 0 and rejected.first()["reject_reason"] == "description longer than 500"
    assert spark.range(1).select(S.to_money(F.lit(1e11)).alias("m"), S.to_quantity(F.lit(1.2345)).alias("q")).first()["m"] is None
