"""The given tables and the document-shaped views that the registered queries read.

Each view has a twin in ``sqlviews.py``. Money is computed in whole cents, so both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.numbers import number_text
from foliospark.operators.derivations import render_text
from foliospark.schemas import CONTRACT, INVOICE, RECEIPT

# The seven date layouts.
DATE_PATTERNS = ["MM/dd/yyyy", "MMMM dd, yyyy", "dd-MMM-yyyy", "yyyy-MM-dd", "MM/dd/yy", "MMM dd, yyyy", "dd MMMM yyyy"]
LANGS = ["de", "en", "es", "fr"]
TERMS = ["14 days", "end of month", "prepaid", "90 days", "on delivery", "by instalments"]
CARDS = {"1-URGENT": "Visa", "2-HIGH": "Debit", "3-MEDIUM": "Cash", "4-NOT SPECIFIED": "Apple Pay", "5-LOW": "Google Pay"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def date_text(day: Column, key: Column) -> Column:
    """A date in one of the seven layouts by key; ``??`` and NULL for two of nine keys."""
    slot = key % 9
    text = F.when(slot == 7, F.lit("??"))
    for i, pattern in enumerate(DATE_PATTERNS):
        text = text.when(slot == i, F.date_format(day, pattern))
    return text


#: Lines of an order follow each other by all of their columns.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
              "l_linestatus", "l_shipdate"]
ITEM = ["description", "quantity", "unit_price", "amount", "category"]


def invoice_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as invoice lines, with the columns that order them inside their document: row-wise, no shuffle."""
    return (table(spark, sf, "lineitem")
            .withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
            .withColumn("q", F.col("l_quantity").cast("bigint"))
            .select(F.col("l_orderkey").alias("document_id"), *LINE_ORDER,
                    F.concat(F.lit("Part "), F.col("l_partkey")).alias("description"),
                    F.col("q").cast("double").alias("quantity"),
                    (F.expr("(2 * cents + q) div (2 * q)") / F.lit(100.0)).alias("unit_price"),
                    (F.col("cents") / F.lit(100.0)).alias("amount"),
                    F.col("l_returnflag").alias("category"), "cents"))


def plain_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with their own line number: row-wise, no shuffle."""
    used = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return (used
            .withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
            .withColumn("q", F.col("l_quantity").cast("bigint"))
            .select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("item_no"),
                    F.concat(F.lit("Part "), F.col("l_partkey")).alias("description"),
                    F.col("q").cast("double").alias("quantity"),
                    (F.expr("(2 * cents + q) div (2 * q)") / F.lit(100.0)).alias("unit_price"),
                    (F.col("cents") / F.lit(100.0)).alias("amount"),
                    F.col("l_returnflag").alias("category"), "cents"))


def _order_headers(spark: SparkSession, sf: str, line_totals: DataFrame) -> DataFrame:
    """Orders with vendor, dates and totals; ``line_totals(document_id, line_cents)`` is joined on the way.

    The texts of an order are made on its scan, below the joins: made above them, every rule that reads a date
    would format it again.
    """
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf, "orders").select(
        key.alias("document_id"), "o_custkey", "o_orderstatus", day.alias("day"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("listed"),
        F.concat(F.lit("INV-"), F.lpad(key.cast("string"), 10, "0")).alias("invoice_number"),
        date_text(day, key).alias("invoice_date"),
        date_text(F.date_add(day, ((key % 5 - 1) * 10).cast("int")), key + 1).alias("due_date"),
        _pick(TERMS, key % 6).alias("payment_terms"), F.col("o_orderpriority").alias("payment_method"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    k = F.col("document_id")
    joined = (orders.join(line_totals, "document_id", "left").join(names, "o_custkey", "left")
              .withColumn("sub", F.col("line_cents") + F.when(k % 11 == 0, 500).otherwise(0))
              .withColumn("tax_cents", F.expr("(8 * sub + 50) div 100")))
    total = (F.when(k % 13 == 0, -F.col("listed"))
             .when((k % 7 == 0) | F.col("sub").isNull(), F.col("listed"))
             .otherwise(F.col("sub") + F.col("tax_cents")))
    return joined.withColumns({
        "vendor_name": F.when(F.col("o_custkey") % 17 == 0, " ").otherwise(F.col("c_name")),
        "subtotal": F.col("sub") / F.lit(100.0), "tax": F.col("tax_cents") / F.lit(100.0),
        "total_amount": total / F.lit(100.0), "currency": F.lit("USD"), "receipt_date": F.col("invoice_date")})


HEADER = ["document_id", "vendor_name", "invoice_number", "invoice_date", "due_date", "subtotal", "tax", "total_amount",
          "currency", "payment_terms", "payment_method", "receipt_date", "o_orderstatus", "o_custkey", "day"]


def invoice_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Flat invoices: only summed lines are joined."""
    sums = plain_lines(spark, sf).groupBy("document_id").agg(F.sum("cents").alias("line_cents"))
    return _order_headers(spark, sf, sums).select(*HEADER)


def headers_with(spark: SparkSession, sf: str, facts: DataFrame) -> DataFrame:
    """Flat invoices with what ``facts(document_id, line_cents, ...)`` says about their lines."""
    return _order_headers(spark, sf, facts)


def _nested(spark: SparkSession, sf: str, status: str | None = None) -> DataFrame:
    """Headers with their lines as an array, of one order status or of all. One array is one document's items, which a single
    response has to hold.

    Each document's lines are sorted inside its array, by a struct that leads with their order. Lines of other statuses
    go before anything is gathered. The join is told to shuffle the orders to the lists: a table of whole documents is
    nothing to broadcast.
    """
    lines = invoice_lines(spark, sf)
    if status is not None:
        wanted = table(spark, sf, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("document_id"))
        lines = lines.join(wanted, "document_id", "left_semi")
    lists = lines.groupBy("document_id").agg(
        F.sum("cents").alias("line_cents"), F.sort_array(F.collect_list(F.struct(*LINE_ORDER, F.struct(*ITEM).alias("item")))).alias("items"))
    headers = _order_headers(spark, sf, lists.hint("merge"))
    if status is not None:
        headers = headers.filter(F.col("o_orderstatus") == status)
    return headers.withColumn("line_items", F.col("items.item"))  # a field of an array costs nothing, however often a rule reads it


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """``(document_id, record)`` with an invoice struct."""
    return _nested(spark, sf).select("document_id", F.struct(*INVOICE.names).alias("record"))


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of status P as receipts."""
    return _nested(spark, sf, "P").select("document_id", F.struct(*RECEIPT.names).alias("record"))


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as an invoice, those of status P as a receipt too: ``(document_id, record_type, invoice, receipt)``.

    Lines are gathered once for both.
    """
    kinds = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("invoice"), F.lit("receipt"))).otherwise(F.array(F.lit("invoice")))
    both = _nested(spark, sf).withColumn("record_type", F.explode(kinds))
    structs = [F.when(F.col("record_type") == kind, F.struct(*names)).alias(kind)
               for kind, names in (("invoice", INVOICE.names), ("receipt", RECEIPT.names))]
    return both.select("document_id", "record_type", *structs)


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    """A contract between every customer and its nation; the nation table has 25 rows at any scale."""
    k = F.col("c_custkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int"))
    end = F.date_add(start, ((k % 5 - 1) * 100).cast("int"))
    nations = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    value = F.when(k % 11 == 0, -F.col("c_acctbal")).when(k % 23 == 0, None).otherwise(F.col("c_acctbal"))
    none = F.array().cast("array<string>")
    return (table(spark, sf, "customer").join(nations, "c_nationkey")
            .withColumn("parties", F.when(k % 19 == 0, none).otherwise(F.array("c_name", "n_name")))
            .withColumn("effective_date", date_text(start, k))
            .withColumn("expiration_date", date_text(end, k + 4))
            .withColumn("contract_value", value)
            .withColumn("key_terms", F.array(F.concat(F.lit("Segment "), F.col("c_mktsegment")), F.lit("Each party shall give notice")))
            .withColumn("summary", F.when(k % 3 == 0, F.concat(F.lit("Agreement with "), F.col("c_name"))))
            .select(F.col("c_custkey").alias("document_id"), F.struct(*CONTRACT.names).alias("record")))


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as status events of the document ``user_id``."""
    return status_columns(table(spark, sf, "events"))


def status_columns(events: DataFrame) -> DataFrame:
    odd = F.col("event_id") % 2
    return events.select(
        F.col("user_id").cast("string").alias("document_id"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".pdf"))).alias("filename"),
        F.when(F.col("event_type") == "signup", F.concat_ws("/", F.lit("documents"), F.col("user_id").cast("string"))).alias("s3_key"),
        F.col("event_type").alias("status"),
        F.when(odd == 0, F.get_json_object("props", "$.k")).alias("doc_type"),
        F.when(F.col("event_type") == "purchase", number_text(F.floor(F.col("value") * 100) / F.lit(10000.0))).alias("classification_confidence"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error_message"),
        F.col("ts").alias("event_time"), F.col("event_id").alias("seq"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as training samples: the language is the label."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text")


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by formula: right seven times in ten, with ties and every degree of confidence."""
    d = F.col("doc_id")
    scores = F.array(*[((d * (7 + 2 * k) + 3 * k) % 101 + 1 + F.when((d % 10 < 7) & (F.col("lang") == c), 400).otherwise(0))
                       for k, c in enumerate(LANGS)])
    df = table(spark, sf, "documents").select("doc_id", "lang", scores.alias("s"))
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x)
    df = df.withColumn("total", total)
    proba = F.transform("s", lambda x: x / F.col("total"))
    label = F.get(F.array(*[F.lit(c) for c in LANGS]), (F.array_position("s", F.array_max("s")) - 1).cast("int"))
    return df.select(F.col("doc_id").alias("id"), F.col("lang").alias("y_true"), label.alias("y_pred"), proba.alias("proba"))


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into pages at newlines; a blank page has no text."""
    return (table(spark, sf, "documents")
            .select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("page_no", "t"))
            .select("document_id", "page_no", F.when(F.col("t") != "", F.col("t")).alias("text")))


def object_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Upload keys: every tenth is a text file, every third has an upper-case suffix."""
    d = F.col("doc_id")
    suffix = F.when(d % 10 == 0, ".txt").otherwise(".pdf")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("documents/"), d.cast("string"), F.lit("/"), F.col("source"),
                 F.when(d % 3 == 0, F.upper(suffix)).otherwise(suffix)).alias("path"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as extraction attempts."""
    ok = F.col("role") == "assistant"
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("attempt"), ok.alias("ok"),
        F.when(ok, F.col("text")).alias("response"), F.when(~ok, F.concat(F.lit("refused by "), F.col("role"))).alias("error"),
        F.concat(F.lit("model-"), F.col("role")).alias("model"),
        F.length("text").cast("bigint").alias("input_tokens"), (F.length("text") % 97).cast("bigint").alias("output_tokens"))


def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices as JSON answers, most of them damaged in one of nine ways by key."""
    k = F.col("document_id") % 10

    def quoted(name: str, c: Column) -> Column:
        return F.concat(F.lit(f'"{name}": "'), c, F.lit('"'))

    def money(c: Column) -> Column:
        return c.cast("decimal(14,2)").cast("string")

    def item(x: Column) -> Column:
        quantity = F.when(k == 7, "").when(k == 3, '"quantity": 0, ').otherwise(
            F.concat(F.lit('"quantity": '), x["quantity"].cast("bigint").cast("string"), F.lit(", ")))
        return F.concat(F.lit("{"), quoted("description", x["description"]), F.lit(", "), quantity,
                        F.lit('"unit_price": '), money(x["unit_price"]), F.lit(', "amount": '), money(x["amount"]), F.lit("}"))

    r = F.col("record")
    items = F.array_join(F.transform(F.coalesce(r["line_items"], F.array().cast(INVOICE["line_items"].dataType)), item), ", ")
    vendor = F.when(k == 2, '"vendor_name": null').when(k == 6, '"vendor_name": 5').otherwise(quoted("vendor_name", r["vendor_name"]))
    total = (F.when(k == 1, "").when(k == 4, F.concat(F.lit(', "total_amount": "'), money(r["total_amount"]), F.lit('"')))
             .otherwise(F.concat(F.lit(', "total_amount": '), money(r["total_amount"]))))
    currency = F.when(k == 8, ', "currency": null').when(k == 9, "").otherwise(', "currency": "EUR"')
    text = F.concat(F.lit("{"), vendor, F.lit(', "line_items": ['), items, F.lit("]"), total, currency, F.lit("}"))
    return invoices(spark, sf).select(
        "document_id", F.when(k == 5, F.left(text, F.length(text) - 5)).otherwise(text).alias("response"))


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") / F.lit(100.0)).alias("amount"),
        (F.col("o_orderstatus") == "F").alias("is_debit"))


def openings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("opening"))


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices as document texts."""
    return render_text(invoices(spark, sf), "invoice").select(F.col("document_id").alias("id"), "text")
