"""Golden cases of the rules, and the exact rounding and number texts they rest on."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.functions.dates import parse_date
from foliospark.functions.numbers import number_text, round_cents
from foliospark.operators import validation as V
from foliospark.schemas import CONTRACT, INVOICE, RECEIPT

LAMPS, SHIPPING = ("Brass lamp", 7.0, 31.4, 219.8, "light"), ("Freight", 1.0, 12.05, 12.05, None)
GOOD_INVOICE = dict(vendor_name="Lumen & Daughters", invoice_number="L-0093", invoice_date="2021-11-02", due_date="December 1, 2021",
                    line_items=[LAMPS, SHIPPING], subtotal=231.85, tax=44.05, total_amount=275.9, currency="EUR", payment_terms="29 days")
GOOD_RECEIPT = dict(vendor_name="Kiosk 9", receipt_date="02-Nov-2021", line_items=[("Stamps", 12.0, 0.85, 10.2, None)],
                    subtotal=10.2, tax=0.0, total_amount=10.2, payment_method="Transfer")
GOOD_CONTRACT = dict(parties=["Harbour Trust", "Tide Works"], effective_date="11/02/21", expiration_date="2 November 2024",
                     contract_value=731.5, key_terms=["berth"], summary="Mooring")


def check(spark, kind, **changes):
    schema, good, rule = {
        "invoice": (INVOICE, GOOD_INVOICE, V.validate_invoice), "receipt": (RECEIPT, GOOD_RECEIPT, V.validate_receipt),
        "contract": (CONTRACT, GOOD_CONTRACT, V.validate_contract)}[kind]
    record = {**good, **changes}
    df = spark.createDataFrame([tuple(record[n] for n in schema.names)], schema).select(F.struct("*").alias("record"))
    return rule(df).first()["validation"]


def test_good_records(spark):
    for kind in ("invoice", "receipt", "contract"):
        r = check(spark, kind)
        assert r["is_valid"] and r["errors"] == [] and r["warnings"] == []


@pytest.mark.parametrize("changes,errors", [
    ({"vendor_name": "\n\u2003"}, ["Vendor name is empty"]), ({"vendor_name": None, "line_items": None}, ["Vendor name is empty", "No line items found"]),
    ({"total_amount": 0.0}, ["Total amount must be positive, got 0.0"]),
    ({"total_amount": -0.005, "line_items": []}, ["No line items found", "Total amount must be positive, got -0.005"])])
def test_errors(spark, changes, errors):
    r = check(spark, "invoice", **changes)
    assert not r["is_valid"] and r["errors"] == errors


@pytest.mark.parametrize("amount,warned", [(219.84, False), (219.76, False), (219.86, True), (219.74, True)])
def test_line_tolerance(spark, amount, warned):
    warnings = check(spark, "invoice", line_items=[(*LAMPS[:3], amount, None), SHIPPING])["warnings"]
    assert warnings == ([f"Line 1: amount {amount} != qty 7.0 x price 31.4 = 219.8"] if warned else [])


@pytest.mark.parametrize("subtotal,total,warnings", [
    (232.35, 276.4, []), (232.36, 276.41, ["Line items sum 231.85 != subtotal 232.36"]),
    (231.85, 276.4, []), (231.85, 276.41, ["subtotal 231.85 + tax 44.05 = 275.9, but total is 276.41"]),
    (231.85, 275.39, ["subtotal 231.85 + tax 44.05 = 275.9, but total is 275.39"]), (None, 9.0, [])])
def test_total_tolerance(spark, subtotal, total, warnings):
    r = check(spark, "invoice", subtotal=subtotal, total_amount=total)
    assert r["is_valid"] and r["warnings"] == warnings


LAYOUTS = ["06/07/2022", "June 07, 2022", "07-Jun-2022", "2022-06-07", "06/07/22", "Jun 07, 2022", "07 June 2022"]


@pytest.mark.parametrize("text", LAYOUTS)
def test_every_layout_is_compared(spark, text):
    assert check(spark, "invoice", invoice_date=text, due_date=text)["warnings"] == []
    assert check(spark, "invoice", invoice_date="2022-06-08", due_date=text)["warnings"] == ["Due date is before invoice date"]
    assert check(spark, "contract", effective_date="2022-06-08", expiration_date=text)["warnings"] == ["Expiration date is before effective date"]


def test_several_lines_fail_at_once(spark):
    lines = [("a", 0.0, 3.1, 0.0, None), ("b", 2.0, -0.5, -1.0, None), ("c", -4.0, -1.5, 7.0, None)]
    assert check(spark, "invoice", line_items=lines, subtotal=None)["warnings"] == [
        "Line 1: negative or zero quantity (0.0)", "Line 2: negative unit price (-0.5)", "Line 3: negative or zero quantity (-4.0)",
        "Line 3: negative unit price (-1.5)", "Line 3: amount 7.0 != qty -4.0 x price -1.5 = 6.0"]


def test_receipt_and_contract(spark):
    r = check(spark, "receipt", receipt_date="yesterday", vendor_name="")
    assert (r["errors"], r["warnings"]) == (["Vendor name is empty"], ["Could not parse receipt date: yesterday"])
    r = check(spark, "contract", parties=None, contract_value=-0.01, effective_date="soon", expiration_date="2022-13-01")
    assert r["errors"] == ["No parties listed"]
    assert [w.split(":")[0] for w in r["warnings"]][:1] == ["Negative contract value"] and len(r["warnings"]) == 3


def test_flat_and_nested_forms_agree(spark):
    """A thousand lines of less than a cent, rounded once; an amount no decimal holds ends no job."""
    lines = spark.range(1000).select(F.lit(1).alias("document_id"), (F.col("id") + 1).alias("item_no"), F.lit(1.0).alias("quantity"),
                                     F.lit(0.004).alias("unit_price"), F.lit(0.004).alias("amount"))
    header = {**{n: None for n in INVOICE.names}, "vendor_name": "x", "subtotal": 5.0, "tax": 0.0, "total_amount": 5.0}
    flat = spark.createDataFrame([(1, *[header[n] for n in INVOICE.names if n != "line_items"])],
                                 "document_id bigint, vendor_name string, invoice_number string, invoice_date string, due_date string, subtotal double, "
                                 "tax double, total_amount double, currency string, payment_terms string")
    message = "Line items sum 4.0 != subtotal 5.0"
    assert [r["message"] for r in V.header_findings(flat, lines).collect()] == [message]
    assert check(spark, "invoice", **{**header, "line_items": [("y", 1.0, 0.004, 0.004, None)] * 1000})["warnings"] == [message]
    huge = lines.withColumn("amount", F.lit(1e30))
    assert [r["rule"] for r in V.header_findings(flat, huge).collect()] == ["line_sum_out_of_range"]


def test_round_and_text_agree_with_python(spark):
    rng = random.Random(7)
    values = [2.675, 0.125, 1.005, 0.375, -2.675, -0.125, 1e7, 1e15, 123456.785, 0.0, 1e-5, 1.5e-4, 1e16, 2.5e20]
    values += [1e13 + 0.006, 2e13 + 0.004, 12345678901234.567, 2.0 ** 45 + 0.125, 2.0 ** 45 - 0.375, 2.0 ** 46 + 0.015625, -(2.0 ** 46) - 0.5, 1e13 - 0.005]
    values += [rng.uniform(2.0 ** 43, 2.0 ** 46) for _ in range(3000)]
    values += [round(rng.uniform(-1e5, 1e5), 3) for _ in range(3000)] + [rng.randint(0, 10 ** 6) * 0.005 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", round_cents(F.col("x")).alias("r"), number_text(F.col("x")).alias("t")).collect():
        assert r["r"] == round(r["x"], 2), r
        assert r["t"] == repr(r["x"]), r


def test_dates_agree_with_python(spark):
    formats = ["%m/%d/%Y", "%B %d, %Y", "%d-%b-%Y", "%Y-%m-%d", "%m/%d/%y", "%b %d, %Y", "%d %B %Y"]
    texts = ["3/5/2025", "003/15/2025", "March  5, 2025", "march 5, 2025", "Mar 5, 2025", "5-MAR-2025", "2025-3-5", "03/15/69",
             "03/15/68", "02/30/2025", "02/29/2024", "5 March 2025", " 3/5/2025", "3/5/2025 ", "0000-01-01", "May 1, 2024",
             "31 April 2024", "", "Marchx 5, 2025", "13/01/2025"]

    def parse(s):
        for f in formats:
            try:
                return datetime.strptime(s, f).date()
            except ValueError:
                pass
        return None

    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for r in df.select("s", parse_date(F.col("s")).alias("d")).collect():
        assert r["d"] == parse(r["s"]), r
