"""Records that several tables store are gathered and checked once; answers are read without the types of their lists."""

from __future__ import annotations

import json

from foliospark.operators import extraction as X
from foliospark.plans import queries_records as Q
from foliospark.plans import tables as t

SF = "/root/testdata/sf0.001"


def test_all_tables_are_stored_from_one_written_check(spark, monkeypatch):
    seen = []
    write = Q.sinks.write_extractions
    monkeypatch.setattr(Q.sinks, "write_extractions", lambda tables, *more: (seen.append(tables), write(tables, *more)))
    rows = Q.written_invoices(spark, SF)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen[0].values()]
    assert rows.count() and not any("Join" in plan or "collect_list" in plan for plan in plans)


def test_lines_of_a_record_are_a_field_of_its_sorted_lines(spark):
    plan = t.invoices(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "items#" in plan and "transform(items" not in plan


def test_no_type_of_a_list_is_made(spark):
    item = {"description": "d", "unit_price": 1, "amount": 2}
    records = [{"vendor_name": "V", "line_items": [item, more], "total_amount": 3} for more in (item, 5, None, [], {}, {**item, "quantity": 0}, {**item, "amount": None})]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate([*records, [], None])], "i int, response string")
    parsed = X.parse_typed(df, "invoice")
    assert [r["parse_error"] for r in parsed.orderBy("i").collect()] == [
        None, *["line_items: not an object"] * 3, "description: missing", "quantity: not above 0", "amount: null", *["response is not a JSON object"] * 2]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant(_v" not in plan and "schema_of_variant(try_variant_get" not in plan
