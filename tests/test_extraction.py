"""Requests, typed parsing, attempts and the retry rounds."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import extraction as X

ITEM = {"description": "Tea", "unit_price": 2.0, "amount": 4.0}
GOOD = {"vendor_name": "Acme", "line_items": [ITEM], "total_amount": 4.0}


def parse(spark, kind, value):
    raw = value if isinstance(value, str) else json.dumps(value)
    return X.parse_typed(spark.createDataFrame([(raw,)], "response string"), kind).first()


def test_defaults(spark):
    r = parse(spark, "invoice", {**GOOD, "total_amount": "4.5"})
    assert r["parse_error"] is None
    assert r["record"]["currency"] == "USD" and r["record"]["line_items"][0]["quantity"] == 1.0
    assert r["record"]["total_amount"] == 4.5 and r["record"]["due_date"] is None
    c = parse(spark, "contract", {"parties": ["A"]})
    assert c["record"]["key_terms"] == []


@pytest.mark.parametrize("value,error", [
    ("{bad", "response is not a JSON object"), ("[1]", "response is not a JSON object"),
    ({**GOOD, "vendor_name": None}, "vendor_name: null"), ({**GOOD, "vendor_name": 5}, "vendor_name: wrong type"),
    ({"vendor_name": "A", "line_items": []}, "total_amount: missing"), ({**GOOD, "currency": None}, "currency: null"),
    ({**GOOD, "line_items": [{**ITEM, "quantity": 0}]}, "quantity: not above 0"),
    ({**GOOD, "line_items": [{**ITEM, "quantity": None}]}, "quantity: null"),
    ({**GOOD, "line_items": [5]}, "line_items: not an object"), ({**GOOD, "line_items": "x"}, "line_items: wrong type"),
    ({**GOOD, "total_amount": "four"}, "total_amount: wrong type")])
def test_parse_errors(spark, value, error):
    r = parse(spark, "invoice", value)
    assert r["parse_error"] == error and r["record"] is None


def test_wrong_list_element(spark):
    assert parse(spark, "contract", {"parties": ["A", 1]})["parse_error"] == "parties: wrong type"


def test_short_text_makes_no_request(spark):
    df = spark.createDataFrame([("a", "invoice", "hi"), ("b", "invoice", "x" * 200)], "document_id string, doc_type string, text string")
    assert [r["document_id"] for r in X.build_requests(df, "m").collect()] == ["b"]
    assert df.select(F.length(X.truncate_text(F.col("text"), 100)).alias("n")).agg(F.max("n")).first()[0] == 100


def test_retry_rounds(spark):
    df = spark.createDataFrame([(k, "receipt", k + " " + "x" * 80) for k in ("once", "never", "bad-json", "wrong")],
                               "document_id string, doc_type string, text string")
    good = json.dumps({"vendor_name": "V", "line_items": [], "total_amount": 1})

    def factory():
        calls = {}

        def client(request):
            k = request["document_id"]
            calls[k] = calls.get(k, 0) + 1
            if k == "once":
                return good, 3, 2
            if k == "never":
                raise RuntimeError("down")
            return ("{", 1, 1) if k == "bad-json" else ('{"vendor_name": 1}', 1, 1)
        return client

    attempts = X.extract(X.build_requests(df, "m"), factory)
    assert attempts.count() == 7  # one success, three documents with two attempts
    assert [r["document_id"] for r in X.resolve_attempts(attempts).collect()] == ["once"]
    failed = {r["document_id"]: r["error"] for r in X.extraction_failures(attempts).collect()}
    assert failed["never"] == "Extraction failed after 2 attempts: down" and set(failed) == {"never", "bad-json", "wrong"}
    assert X.token_usage(attempts).first()["calls"] == 7
