"""Optional parts of rendered documents: what is missing, zero or blank leaves no line behind."""

from pyspark.sql import functions as F

from foliospark.operators import derivations as D

RECORD = ("struct<vendor_name:string,invoice_number:string,invoice_date:string,due_date:string,line_items:array<struct<description:string,quantity:double,"
          "unit_price:double,amount:double>>,subtotal:double,tax:double,total_amount:double,payment_terms:string,receipt_date:string,payment_method:string>")
BARE = ("Shop", "1", "2024-01-01", None, [("Pen", 2.0, 1.0, 2.0)], 2.0, 0.2, 2.2, "prepaid", "2024-01-02", "Visa")


def text(spark, doc_type, schema=None, values=None):
    df = spark.createDataFrame([(BARE,)], f"record {RECORD}")
    if schema:
        df = spark.createDataFrame([(BARE, values)], f"record {RECORD}, details struct<{schema}>")
    return D.render_text(df, doc_type, details="details" if schema else None).first()["text"].split("\n")


def test_without_details_or_with_empty_ones_the_text_is_the_same(spark):
    schema = "vendor_address:string,vendor_city:string,bill_to_name:string,discount:double,shipping:double,tip:double,notes:string,unknown_part:string"
    for doc_type in ("invoice", "receipt"):
        bare = text(spark, doc_type)
        assert text(spark, doc_type, schema, (None, " ", None, 0.0, None, 0.0, "", "x")) == bare
        assert text(spark, doc_type, schema, (None,) * 8) == bare


def test_every_part_has_its_line(spark):
    schema = ("vendor_address:string,vendor_city:string,vendor_state:string,vendor_zip:string,bill_to_name:string,bill_to_company:string,bill_to_city:string,"
              "discount:double,discount_pct:double,shipping:double,tax_rate:double,po_number:string,notes:string")
    got = text(spark, "invoice", schema, ("1 Elm St\nUnit 2", "Ames", "IA", "50010", "Ann Lee", "Lee Ltd", "Reno", 1234.5, 10.0, 9.0, 8.0, "77", "Thanks"))
    assert got == ["Shop", "1 Elm St, Unit 2", "Ames, IA 50010", "INVOICE", "Invoice #: 1", "Date: 2024-01-01", "PO #: 77", "Bill To:", "Ann Lee", "Lee Ltd", "Reno",
                   "Description Qty Unit Price Amount", "Pen 2.0 $1.00 $2.00", "Subtotal: $2.00", "Discount (10.0%): -$1,234.50", "Shipping: $9.00", "Tax (8.0%): $0.20",
                   "Total Due: $2.20", "Payment Terms: prepaid", "Thanks"]
    got = text(spark, "receipt", "tip:decimal(10,2),discount:int,discount_desc:string,card_last_four:string,change_due:double", (None, 3, "member", "0042", 0.8))
    assert got == ["Shop", "Date: 2024-01-02", "Pen x2 $2.00", "Subtotal: $2.00", "Discount (member): -$3.00", "Tax: $0.20", "TOTAL: $2.20", "Visa ending 0042", "Change: $0.80"]
