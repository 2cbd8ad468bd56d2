"""Number ranges of the stored tables, and one pass over the lines of both purchase types."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import storage as S
from foliospark.operators import validation as V
from foliospark.schemas import MONEY, QUANTITY, RECORD_TYPES


@pytest.mark.parametrize("kind", [MONEY, QUANTITY], ids=str)
def test_out_of_range_is_what_a_cast_refuses(spark, kind):
    limit = 10.0 ** (kind.precision - kind.scale)
    step = 10.0 ** -kind.scale
    values = [0.0, 1.5, -2.0, 0.985 * limit, 0.995 * limit, limit - step, limit - 0.6 * step, limit - 0.4 * step, limit, 1e300, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in [*values, *[-v for v in values], None]], "v double")
    got = rows.select("v", F.coalesce(S._out_of_range(F.col("v"), kind), F.lit(False)).alias("out"),
                      (F.col("v").isNotNull() & F.col("v").try_cast(kind).isNull()).alias("refused")).collect()
    assert all(r.out == r.refused for r in got) and any(r.out for r in got)


def test_lines_of_both_types_leave_together(spark):
    item = [("Lamp", 2.0, 3.0, 6.0, None)]
    invoice = ("Lumen", "1", None, None, item, 6.0, 0.0, 6.0, "EUR", None)
    receipt = tuple({"vendor_name": "Kiosk", "line_items": item * 2, "subtotal": 12.0, "tax": 0.0, "total_amount": 12.0}.get(n)
                    for n in RECORD_TYPES["receipt"].names)
    schema = (F.lit(None).cast(RECORD_TYPES["invoice"]), F.lit(None).cast(RECORD_TYPES["receipt"]), F.lit(None).cast(RECORD_TYPES["contract"]))
    a = spark.createDataFrame([(1, "invoice", invoice)], f"document_id int, record_type string, invoice {RECORD_TYPES['invoice'].simpleString()}")
    b = spark.createDataFrame([(2, "receipt", receipt)], f"document_id int, record_type string, receipt {RECORD_TYPES['receipt'].simpleString()}")
    c = spark.createDataFrame([(3, "generic"), (4, "memo"), (5, None)], "document_id int, record_type string").withColumn("contract", schema[2])
    rows = V.validate(a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True))
    found = {r.document_id: r.validation for r in rows.collect()}
    assert [found[i].is_valid for i in range(1, 6)] == [True, True, True, False, False]
    assert found[4].errors == ["Unknown extraction type: memo"] and found[5].errors == ["Unknown extraction type: NULL"] and found[4].warnings == []
    lines = S.route_store(rows)["line_items"].collect()
    assert sorted((r.extraction_type, r.item_no) for r in lines) == [("invoice", 1), ("receipt", 1), ("receipt", 2)]
    assert len({r.extraction_id for r in lines}) == 2
