"""Long texts in parts, the ledger of paid calls, and batches that are published once."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import extraction as X
from foliospark.schemas import RECORD_TYPES
from foliospark.sources import sinks

DOC = "document_id string, doc_type string, text string"


def item(name):
    return {"description": name, "quantity": 1.0, "unit_price": 1.0, "amount": 1.0, "category": None}


@pytest.mark.parametrize("length,parts", [(0, 1), (30, 1), (100, 1), (101, 2), (180, 2), (181, 3), (260, 3), (1_000, 13)])
def test_parts_cover_the_text(spark, length, parts):
    text = "".join(chr(97 + i % 26) for i in range(length))
    rows = X.text_parts(spark.createDataFrame([("d", "invoice", text)], DOC), 100, 20).orderBy("part").collect()
    assert len(rows) == parts == rows[0]["parts"] and all(len(r["text"]) <= 100 for r in rows)
    whole = rows[0]["text"]
    for r in rows[1:]:
        assert r["text"][:20] == whole[-20:] or len(r["text"]) <= 20
        whole += r["text"][20:]
    assert whole == text


def test_parts_of_odd_texts(spark):
    assert [tuple(r) for r in X.text_parts(spark.createDataFrame([("d", "x", None)], DOC), 10, 2).select("part", "parts", "text").collect()] == [(0, 1, None)]
    with pytest.raises(ValueError):
        X.text_parts(spark.createDataFrame([("d", "x", "a")], DOC), 10, 10)


def test_the_gate_judges_the_whole_text_and_a_cut_only_its_prefix(spark):
    docs = spark.createDataFrame([("blank-first", "invoice", " " * 200 + "x" * 80), ("short", "invoice", " " * 500)], DOC)
    whole = X.build_requests(docs, "m", 100, 10).collect()
    assert {r["document_id"] for r in whole} == {"blank-first"} and len(whole) == 3 and {r["dropped_chars"] for r in whole} == {0}
    assert X.build_requests(docs, "m", 100, 10, cut=True).count() == 0
    cut = X.build_requests(docs, "m", 260, 10, cut=True).collect()
    assert [(r["document_id"], r["parts"], r["dropped_chars"]) for r in cut] == [("blank-first", 1, 20)]


def test_merge(spark):
    records = [("i", 1, {"line_items": [item("b"), item("c"), item("c")], "currency": "EUR", "total_amount": 3.0}),
               ("i", 0, {"vendor_name": "V", "line_items": [item("a"), item("b")]}), ("i", 2, {"vendor_name": "W", "line_items": [item("c"), item("c")], "subtotal": 2.0}),
               ("i", 3, {"line_items": []}), ("bad", 0, {"vendor_name": "V"}), ("bad", 1, {"total_amount": 1.0})]
    table = spark.createDataFrame([(d, p, json.dumps(r)) for d, p, r in records], "document_id string, part int, j string")
    parts = table.select("document_id", "part", F.from_json("j", RECORD_TYPES["invoice"]).alias("record"))
    got = {r["document_id"]: r for r in X.merge_parts(parts, "invoice").collect()}
    assert got["bad"]["parse_error"] == "line_items: missing" and got["bad"]["record"] is None
    merged = got["i"]["record"]
    assert [x["description"] for x in merged["line_items"]] == ["a", "b", "c", "c"]
    assert (merged["vendor_name"], merged["currency"], merged["subtotal"], merged["total_amount"]) == ("V", "EUR", 2.0, 3.0)
    contract = spark.createDataFrame([("c", 1, ["B", "A"]), ("c", 0, ["A"]), ("d", 0, None), ("d", 1, ["Z"])], "document_id string, part int, parties array<string>")
    struct = F.struct(*[(F.col("parties") if f.name == "parties" else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD_TYPES["contract"].fields])
    got = {r["document_id"]: r["record"] for r in X.merge_parts(contract.select("document_id", "part", struct.alias("record")), "contract").collect()}
    assert got["c"]["parties"] == ["A", "B"] and got["c"]["key_terms"] == [] and got["d"]["parties"] == ["Z"]


def test_a_part_may_leave_fields_out_and_one_failed_part_fails_its_document(spark):
    docs = spark.createDataFrame([("long", "receipt", "start " + "x" * 150 + " end"), ("broken", "receipt", "start " + "x" * 120 + " stop"), ("one", "receipt", "y" * 60)], DOC)

    line = item("?")

    def factory():
        def client(request):
            text = request["user_message"].split("DOCUMENT TEXT:\n", 1)[1]
            if "stop" in text:
                raise RuntimeError("stop")
            out = {"line_items": [{**line, "description": f"at {len(text)}"}]}
            return json.dumps({**out, **({"vendor_name": "V"} if "start" in text else {}), **({"total_amount": 5} if "end" in text else {})}), 1, 1
        return client

    attempts = X.extract(X.build_requests(docs, "m", 100, 10), factory)
    records = {r["document_id"]: r for r in X.merged_records(attempts).collect()}
    assert set(records) == {"long"} and records["long"]["record_type"] == "receipt" and records["long"]["parse_error"] is None
    assert [x["description"] for x in records["long"]["receipt"]["line_items"]] == ["at 100", "at 70"] and records["long"]["receipt"]["total_amount"] == 5.0
    failed = {r["document_id"]: r["error"] for r in X.extraction_failures(attempts).collect()}
    assert failed == {"broken": "Extraction failed after 2 attempts: stop", "one": "Extraction failed after 2 attempts: vendor_name: missing"}


def counting_factory(folder, fail_on=""):
    def factory():
        def client(request):
            with open(f"{folder}/calls", "a") as out:
                out.write(f"{request['document_id']}\n")
            if request["document_id"] == fail_on:
                raise SystemExit("the task is lost")  # no error of the client: it ends the task
            if request["document_id"] == "retried":
                raise RuntimeError("busy")
            return json.dumps({"parties": ["A"]}), 1, 1
        return client
    return factory


def test_a_replay_pays_for_no_call_twice(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "contract", "t" * 80) for i in range(6)] + [("retried", "contract", "t" * 80)], DOC)
    requests, ledger = X.build_requests(docs, "m"), X.Ledger(str(tmp_path / "ledger"), 3)
    first = X.extract(requests, counting_factory(tmp_path), ledger=ledger)
    calls = (tmp_path / "calls").read_text().split()
    assert len(calls) == 8 and calls.count("retried") == 2
    again = X.extract(requests, counting_factory(tmp_path), ledger=ledger)
    assert (tmp_path / "calls").read_text().split() == calls and sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    X.extract(requests, counting_factory(tmp_path), ledger=X.Ledger(ledger.path, 4))
    assert len((tmp_path / "calls").read_text().split()) == 16


def test_calls_of_ended_tasks_outlive_a_failed_job(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "contract", "t" * 80) for i in range(4)], DOC).repartition(4, "document_id")
    requests, ledger = X.build_requests(docs, "m"), X.Ledger(str(tmp_path / "ledger"), 0)
    with pytest.raises(Exception):
        X.extract(requests, counting_factory(tmp_path, fail_on="d3"), ledger=ledger, concurrency=None)
    kept = {r["document_id"] for r in ledger.calls(requests, 1).collect()}
    assert "d3" not in kept
    (tmp_path / "calls").write_text("")
    done = X.extract(requests, counting_factory(tmp_path), ledger=ledger)
    called = (tmp_path / "calls").read_text().split()
    assert "d3" in called and len(called) == len(set(called)) and kept.isdisjoint(called)  # tasks that end late may be kept too
    assert done.count() == 4


def test_published_batches_count_once(spark, tmp_path):
    target = str(tmp_path / "out")
    with pytest.raises(ValueError):
        sinks.published(spark, target, "a")
    make = lambda n, low=0: spark.range(low, low + n).toDF("id")
    sinks.publish({"a": make(5), "b": make(2)}, target, 1)
    make(9).write.parquet(f"{target}/a/batch=2/run=stopped")  # a run that never got to its manifest
    sinks.publish({"a": make(3, 100), "b": make(0)}, target, 2)
    sinks.publish({"a": make(4, 200), "b": make(1)}, target, 2)
    assert sorted((r["batch"], r["id"]) for r in sinks.published(spark, target, "a").collect()) == [(1, i) for i in range(5)] + [(2, 200 + i) for i in range(4)]
    assert sinks.published(spark, target, "b").count() == 3 and sinks.manifests(spark, target).count() == 2
