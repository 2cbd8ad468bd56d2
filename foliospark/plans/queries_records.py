"""Queries on invoices, receipts and contracts: validation, storage, arithmetic, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.dates import parse_date
from foliospark.functions.rows import explode_rows
from foliospark.operators import derivations as D
from foliospark.operators import quality as Q
from foliospark.operators import storage as S
from foliospark.operators import validation as V
from foliospark.plans import tables as t
from foliospark.plans.catalogue import query
from foliospark.plans.sqlviews import cents, date, with_views
from foliospark.schemas import RECORD_TYPES
from foliospark.session import materialize, shared_folder
from foliospark.sources import sinks

# --- validation -------------------------------------------------------------------------------------------

_LINE_MESSAGES = f"""
  SELECT document_id, item_no, 1 AS pos, 'quantity_not_positive' AS rule, 'Line ' || item_no || ': negative or zero quantity (' || quantity || ')' AS message
  FROM {{lines}} WHERE quantity <= 0
  UNION ALL SELECT document_id, item_no, 2, 'negative_unit_price', 'Line ' || item_no || ': negative unit price (' || unit_price || ')'
  FROM {{lines}} WHERE unit_price < 0
  UNION ALL SELECT document_id, item_no, 3, 'amount_mismatch', 'Line ' || item_no || ': amount ' || amount || ' != qty ' || quantity
    || ' x price ' || unit_price || ' = ' || {cents('quantity * unit_price')}
  FROM {{lines}} WHERE abs(amount - {cents('quantity * unit_price')}) > 0.05::DOUBLE"""


def _purchase_sql(dates: str, where: str = "TRUE") -> str:
    """Errors and warnings per purchase record; ``dates`` lists its date messages."""
    return with_views("lines headers", f"""
SELECT document_id, errors = '' AS is_valid, errors, warnings FROM (
  SELECT h.document_id,
    concat_ws('; ', CASE WHEN coalesce(trim(vendor_name), '') = '' THEN 'Vendor name is empty' END,
      CASE WHEN line_count IS NULL THEN 'No line items found' END,
      CASE WHEN total_amount <= 0 THEN 'Total amount must be positive, got ' || total_amount END) AS errors,
    concat_ws('; ', w.messages,
      CASE WHEN abs(s.total - subtotal) > 0.5 THEN 'Line items sum ' || s.total || ' != subtotal ' || subtotal END,
      CASE WHEN total_amount > 0 AND abs(total_amount - {cents('subtotal + tax')}) > 0.5::DOUBLE THEN 'subtotal ' || subtotal || ' + tax ' || tax
        || ' = ' || {cents('subtotal + tax')} || ', but total is ' || total_amount END,
      {dates}) AS warnings
  FROM headers h
  LEFT JOIN (SELECT document_id, string_agg(message, '; ' ORDER BY item_no, pos) AS messages FROM found GROUP BY document_id) w USING (document_id)
  LEFT JOIN (SELECT document_id, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS total FROM lines GROUP BY document_id) s USING (document_id)
  WHERE {where})""", "found AS (" + _LINE_MESSAGES.format(lines="lines") + ")")


def _unparsed(kind: str, column: str) -> str:
    return f"CASE WHEN {column} <> '' AND {date(column)} IS NULL THEN 'Could not parse {kind} date: ' || {column} END"


INVOICE_RESULT = _purchase_sql(", ".join([
    _unparsed("invoice", "invoice_date"), _unparsed("due", "due_date"),
    f"CASE WHEN {date('due_date')} < {date('invoice_date')} THEN 'Due date is before invoice date' END"]))
RECEIPT_RESULT = _purchase_sql(_unparsed("receipt", "invoice_date"), "o_orderstatus = 'P'")
CONTRACT_RESULT = with_views("contracts", f"""
SELECT document_id, errors = '' AS is_valid, errors, warnings FROM (
  SELECT document_id, CASE WHEN len(parties) = 0 THEN 'No parties listed' ELSE '' END AS errors,
    concat_ws('; ', CASE WHEN contract_value < 0 THEN 'Negative contract value: ' || contract_value END,
      {_unparsed('effective', 'effective_date')}, {_unparsed('expiration', 'expiration_date')},
      CASE WHEN {date('expiration_date')} < {date('effective_date')} THEN 'Expiration date is before effective date' END) AS warnings
  FROM contracts)""")


def _flat_result(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*extra, "document_id", "validation.is_valid", F.array_join("validation.errors", "; ").alias("errors"),
                     F.array_join("validation.warnings", "; ").alias("warnings"))


def _rule_sql() -> str:
    headers = [
        ("error", "vendor_missing", "coalesce(trim(vendor_name), '') = ''"),
        ("error", "no_line_items", "line_count IS NULL"),
        ("error", "total_not_positive", "total_amount <= 0"),
        ("warning", "subtotal_mismatch", "abs(line_sum - subtotal) > 0.5"),
        ("warning", "total_mismatch", f"total_amount > 0 AND abs(total_amount - {cents('subtotal + tax')}) > 0.5::DOUBLE"),
        ("warning", "invoice_date_unparsed", f"invoice_date <> '' AND {date('invoice_date')} IS NULL"),
        ("warning", "due_date_unparsed", f"due_date <> '' AND {date('due_date')} IS NULL"),
        ("warning", "due_before_invoice", f"{date('due_date')} < {date('invoice_date')}"),
    ]
    parts = [f"SELECT document_id, '{s}' AS severity, '{r}' AS rule FROM h WHERE {c}" for s, r, c in headers]
    return with_views("plain_lines headers", f"""
SELECT severity, rule, count(*) AS findings, count(DISTINCT document_id) AS documents FROM (
  SELECT document_id, 'warning' AS severity, rule FROM found UNION ALL {' UNION ALL '.join(parts)}) GROUP BY severity, rule""",
        "found AS (" + _LINE_MESSAGES.format(lines="plain_lines") + """),
  h AS (SELECT * FROM headers LEFT JOIN (SELECT document_id, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS line_sum
        FROM plain_lines GROUP BY document_id) USING (document_id))""")


@query("invoice_validation_summary", _rule_sql())
def invoice_validation_summary(spark, sf):
    """Findings and documents per rule: the lines are read once and become one row a document, which joins its header."""
    facts = t.plain_lines(spark, sf).groupBy("document_id").agg(F.sum("cents").alias("line_cents"), *V.line_facts())
    return V.rule_counts(t.headers_with(spark, sf, facts))


@query("invoice_validation", INVOICE_RESULT)
def invoice_validation(spark, sf):
    return _flat_result(V.validate_invoice(t.invoices(spark, sf)))


@query("receipt_validation", RECEIPT_RESULT)
def receipt_validation(spark, sf):
    return _flat_result(V.validate_receipt(t.receipts(spark, sf)))


@query("contract_validation", CONTRACT_RESULT)
def contract_validation(spark, sf):
    return _flat_result(V.validate_contract(t.contracts(spark, sf)))


@query("invoice_errors_exploded", f"""
SELECT document_id, message FROM (SELECT document_id, unnest(string_split(errors, '; ')) AS message FROM ({INVOICE_RESULT}) WHERE errors <> '')""")
def invoice_errors_exploded(spark, sf):
    checked = V.validate_invoice(t.invoices(spark, sf))
    return explode_rows(checked, F.col("validation.errors"), "message", "document_id")


@query("line_math_violations", with_views("plain_lines", "SELECT document_id, item_no, rule, message FROM found",
                                          "found AS (" + _LINE_MESSAGES.format(lines="plain_lines") + ")"))
def line_math_violations(spark, sf):
    return V.line_findings(t.plain_lines(spark, sf)).drop("severity")


def _header_rule(spark, sf, rule):
    found = V.header_findings(t.invoice_headers(spark, sf), t.plain_lines(spark, sf))
    return found.filter(F.col("rule") == rule).select("document_id", "message")


@query("subtotal_mismatch", with_views("headers", """
SELECT document_id, 'Line items sum ' || line_sum || ' != subtotal ' || subtotal AS message FROM headers JOIN (
  SELECT l_orderkey AS document_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS line_sum
  FROM lineitem GROUP BY l_orderkey) USING (document_id) WHERE abs(line_sum - subtotal) > 0.5"""))
def subtotal_mismatch(spark, sf):
    return _header_rule(spark, sf, "subtotal_mismatch")


@query("total_mismatch", with_views("headers", f"""
SELECT document_id, 'subtotal ' || subtotal || ' + tax ' || tax || ' = ' || {cents('subtotal + tax')} || ', but total is ' || total_amount AS message
FROM headers WHERE total_amount > 0 AND abs(total_amount - {cents('subtotal + tax')}) > 0.5::DOUBLE"""))
def total_mismatch(spark, sf):
    return _header_rule(spark, sf, "total_mismatch")


@query("date_parse_matrix", with_views("headers", f"""
SELECT document_id % 9 AS layout, count(*) AS n, count({date('invoice_date')}) AS parsed,
       count(*) FILTER ({date('invoice_date')} = day) AS exact, min({date('invoice_date')})::VARCHAR AS first_day
FROM headers GROUP BY layout"""))
def date_parse_matrix(spark, sf):
    h = t.invoice_headers(spark, sf).select("document_id", "day", parse_date(F.col("invoice_date")).alias("d"))
    return h.groupBy((F.col("document_id") % 9).alias("layout")).agg(
        F.count(F.lit(1)).alias("n"), F.count("d").alias("parsed"), F.count_if(F.col("d") == F.col("day")).alias("exact"),
        F.min("d").cast("string").alias("first_day"))


@query("date_order_violations", with_views("headers contracts", f"""
SELECT 'invoice' AS kind, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS checked, count(*) FILTER (b < a) AS violations
FROM (SELECT {date('invoice_date')} AS a, {date('due_date')} AS b FROM headers)
UNION ALL SELECT 'contract', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), count(*) FILTER (b < a)
FROM (SELECT {date('effective_date')} AS a, {date('expiration_date')} AS b FROM contracts)"""))
def date_order_violations(spark, sf):
    invoices = Q.date_order_violations(t.invoice_headers(spark, sf))
    contracts = Q.date_order_violations(t.contracts(spark, sf).select("record.*"), "effective_date", "expiration_date")
    return invoices.select(F.lit("invoice").alias("kind"), "*").unionByName(contracts.select(F.lit("contract").alias("kind"), "*"))


def _mixed(spark, sf) -> DataFrame:
    """Records of every type in one table, with a few generic and unknown ones."""
    def typed(df, kind):
        return df.select("document_id", F.lit(kind).alias("record_type"), F.col("record").alias(kind))

    other = t.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("document_id"), F.when(F.col("s_suppkey") % 4 == 0, "memo").otherwise("generic").alias("record_type"))
    return (t.purchases(spark, sf)
            .unionByName(typed(t.contracts(spark, sf), "contract"), allowMissingColumns=True)
            .unionByName(other, allowMissingColumns=True))


@query("validate_router", f"""
SELECT record_type, is_valid, errors, count(*) AS n FROM (
  SELECT 'invoice' AS record_type, is_valid, errors FROM ({INVOICE_RESULT}) UNION ALL
  SELECT 'receipt', is_valid, errors FROM ({RECEIPT_RESULT}) UNION ALL
  SELECT 'contract', is_valid, errors FROM ({CONTRACT_RESULT}) UNION ALL
  SELECT 'generic', TRUE, '' FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL
  SELECT 'memo', FALSE, 'Unknown extraction type: memo' FROM supplier WHERE s_suppkey % 4 = 0
) GROUP BY record_type, is_valid, errors""")
def validate_router(spark, sf):
    return (_flat_result(V.validate(_mixed(spark, sf)), "record_type")
            .groupBy("record_type", "is_valid", "errors").agg(F.count(F.lit(1)).alias("n")))


# --- storage ----------------------------------------------------------------------------------------------

def _id(kind: str, key: str = "document_id") -> str:
    h = f"md5({key} || '|{kind}')"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _as_doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])



@query("store_invoices", f"""
SELECT {_id('invoice')} AS id, document_id, vendor_name, invoice_number, invoice_date, due_date, subtotal, tax, total_amount, currency, payment_terms
FROM ({with_views('headers', 'SELECT * FROM headers')}) JOIN ({INVOICE_RESULT}) USING (document_id) WHERE is_valid""")
def store_invoices(spark, sf):
    rows = S.invoice_rows(S.store_gate(V.validate_invoice(t.invoices(spark, sf)))).drop("created_at", "raw_json")
    return _as_doubles(rows, "subtotal", "tax", "total_amount")


@query("written_invoices", f"""
SELECT {_id('invoice')} AS id, document_id, vendor_name, invoice_number, invoice_date, due_date, subtotal, tax, total_amount, currency, payment_terms
FROM ({with_views('headers', 'SELECT * FROM headers')}) JOIN ({INVOICE_RESULT}) USING (document_id) WHERE is_valid""")
def written_invoices(spark, sf):
    """The stored tables of a batch, written and read back."""
    checked = V.validate_invoice(t.invoices(spark, sf)).select("document_id", F.lit("invoice").alias("record_type"), F.col("record").alias("invoice"), "validation")
    empty = {k: F.lit(None).cast(RECORD_TYPES[k]) for k in ("receipt", "contract")}
    target = shared_folder(spark, "stored")
    # Written once, or every stored table would gather and check all records again. No table has the messages: without them no warning is made.
    judged = S.with_reject_reason(checked.withColumns(empty).withColumn("validation", F.struct("validation.is_valid")))
    sinks.write_extractions(S.route_store(materialize(judged, "judged")), target)
    rows = spark.read.parquet(f"{target}/invoice_extractions").drop("created_at", "raw_json")
    return _as_doubles(rows, "subtotal", "tax", "total_amount")


@query("store_rejects", f"""
SELECT document_id, 'invoice' AS record_type, 'Cannot be stored: ' || CASE document_id % 10 WHEN 1 THEN 'total_amount out of range'
  WHEN 2 THEN 'invoice_number longer than 100' ELSE 'line item description longer than 500; line item quantity out of range' END AS reject_reason
FROM ({with_views('headers', 'SELECT * FROM headers')}) WHERE document_id % 10 IN (1, 2, 3) AND trim(vendor_name) <> '' AND line_count > 0
  AND (document_id % 10 = 1 OR total_amount > 0)""")
def store_rejects(spark, sf):
    """Records with an amount, a text or a line that the tables cannot hold: each is rejected as a whole, with its reason."""
    k, r = F.col("document_id") % 10, F.col("record")
    record = (r.withField("total_amount", F.when(k == 1, F.lit(1e11)).otherwise(r["total_amount"]))
              .withField("invoice_number", F.when(k == 2, F.repeat(F.lit("9"), F.lit(101))).otherwise(r["invoice_number"]))
              .withField("line_items", F.when(k == 3, F.transform(r["line_items"], lambda x: x.withField("description", F.repeat(F.lit("x"), F.lit(501)))
                                                                   .withField("quantity", F.lit(1e8)))).otherwise(r["line_items"])))
    records = t.invoices(spark, sf).select("document_id", record.alias("record"))
    checked = V.validate_invoice(records).select("document_id", F.lit("invoice").alias("record_type"), F.col("record").alias("invoice"), "validation")
    empty = {c: F.lit(None).cast(RECORD_TYPES[c]) for c in ("receipt", "contract")}
    return S.route_store(checked.withColumns(empty))["rejected"]


@query("store_receipts", f"""
SELECT {_id('receipt')} AS id, document_id, vendor_name, invoice_date AS receipt_date, subtotal, tax, total_amount, payment_method
FROM ({with_views('headers', 'SELECT * FROM headers')}) JOIN ({RECEIPT_RESULT}) USING (document_id) WHERE is_valid""")
def store_receipts(spark, sf):
    rows = S.receipt_rows(S.store_gate(V.validate_receipt(t.receipts(spark, sf)))).drop("created_at", "raw_json")
    return _as_doubles(rows, "subtotal", "tax", "total_amount")


@query("store_contracts", f"""
SELECT {_id('contract')} AS id, document_id, array_to_string(parties, '|') AS parties, effective_date, expiration_date,
       contract_value, array_to_string(key_terms, '|') AS key_terms, summary
FROM ({with_views('contracts', 'SELECT * FROM contracts')}) JOIN ({CONTRACT_RESULT}) USING (document_id) WHERE is_valid""")
def store_contracts(spark, sf):
    rows = S.contract_rows(S.store_gate(V.validate_contract(t.contracts(spark, sf)))).drop("created_at", "raw_json")
    return _as_doubles(rows, "contract_value").withColumns(
        {"parties": F.array_join("parties", "|"), "key_terms": F.array_join("key_terms", "|")})


_LINE_ROWS = f"""
SELECT {{id}} AS extraction_id, '{{kind}}' AS extraction_type, item_no, description, quantity, unit_price, amount, category
FROM ({with_views('lines', 'SELECT * FROM lines')}) JOIN ({{result}}) USING (document_id) WHERE is_valid"""
STORED_LINES = (_LINE_ROWS.format(id=_id("invoice"), kind="invoice", result=INVOICE_RESULT) + " UNION ALL "
                + _LINE_ROWS.format(id=_id("receipt"), kind="receipt", result=RECEIPT_RESULT))


@query("store_line_items", STORED_LINES)
def store_line_items(spark, sf):
    rows = S.route_store(V.validate(_mixed(spark, sf)))["line_items"]
    return _as_doubles(rows, "quantity", "unit_price", "amount").withColumn("item_no", F.col("item_no").cast("bigint"))


@query("items_for_extraction", f"""
SELECT document_id, count(*) AS items, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS cents FROM (
  {_LINE_ROWS.format(id=_id('receipt'), kind='receipt', result=RECEIPT_RESULT)}) l
JOIN (SELECT {_id('receipt')} AS id, document_id FROM ({RECEIPT_RESULT}) WHERE is_valid) e ON l.extraction_id = e.id GROUP BY document_id""")
def items_for_extraction(spark, sf):
    checked = S.store_gate(V.validate_receipt(t.receipts(spark, sf)))
    items = S.items_for(S.receipt_rows(checked), S.line_item_rows(checked, "receipt"), "receipt")
    return items.groupBy("document_id").agg(F.count(F.lit(1)).alias("items"),
                                            (F.sum("amount") * 100).cast("bigint").alias("cents"))


@query("orphan_extractions", f"""
SELECT {_id('contract')} AS id, document_id FROM ({CONTRACT_RESULT}) WHERE is_valid AND document_id::VARCHAR NOT IN (SELECT user_id::VARCHAR FROM events)""")
def orphan_extractions(spark, sf):
    rows = S.contract_rows(S.store_gate(V.validate_contract(t.contracts(spark, sf))))
    known = t.status_log(spark, sf).select("document_id").distinct()
    return S.orphans(rows.withColumn("document_id", F.col("document_id").cast("string")), known).select(
        "id", F.col("document_id").cast("bigint").alias("document_id"))


@query("length_rejects", """
SELECT doc_id AS document_id, concat_ws('; ', CASE WHEN length(text) > 500 THEN 'description longer than 500' END,
  CASE WHEN length(source || lang || text) > 100 THEN 'category longer than 100' END) AS reason
FROM documents WHERE length(text) > 500 OR length(source || lang || text) > 100""")
def length_rejects(spark, sf):
    """Whole texts as item descriptions: the long ones do not fit the stored table."""
    d = t.table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("document_id"), F.lit("x").alias("extraction_id"), F.lit("invoice").alias("extraction_type"),
                    F.col("text").alias("description"), F.lit(1).alias("quantity"), F.lit(1).alias("unit_price"), F.lit(1).alias("amount"),
                    F.concat("source", "lang", "text").alias("category"))
    return S.length_limits(rows, "line_items")[1].select("document_id", F.col("reject_reason").alias("reason"))


@query("money_overflow", """
SELECT l_orderkey AS document_id, l_linenumber AS item_no, l_extendedprice * 100000 AS price FROM lineitem
WHERE round(l_extendedprice * 100000, 2) > 9999999999.99""")
def money_overflow(spark, sf):
    """Prices blown up until some no longer fit numeric(12,2): those become NULL and are set aside."""
    li = t.table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("item_no"),
                     (F.col("l_extendedprice") * 100000).alias("price"))
    return rows.filter(F.col("price").isNotNull() & S.to_money(F.col("price")).isNull())


@query("keep_raw", with_views("headers", """
SELECT document_id, raw->>'$.vendor_name' AS vendor_name, raw->>'$.payment_method' AS payment_method,
       CAST(raw->>'$.total_amount' AS DOUBLE) AS total_amount
FROM (SELECT document_id, to_json({'vendor_name': vendor_name, 'payment_method': payment_method, 'total_amount': total_amount}) AS raw
      FROM headers WHERE o_orderstatus = 'P')"""))
def keep_raw(spark, sf):
    rows = S.keep_raw(t.receipts(spark, sf))
    return rows.select("document_id", *[F.get_json_object("raw_json", f"$.{c}").alias(c) for c in ("vendor_name", "payment_method")],
                       F.get_json_object("raw_json", "$.total_amount").cast("double").alias("total_amount"))


# --- arithmetic -------------------------------------------------------------------------------------------

@query("line_amount", with_views("plain_lines", f"""
SELECT document_id, count(*) AS n, CAST(sum(CAST(round({cents('quantity * unit_price')} * 100) AS BIGINT)) AS BIGINT) AS cents
FROM plain_lines GROUP BY document_id"""))
def line_amount(spark, sf):
    lines = D.with_line_amount(t.plain_lines(spark, sf))
    return lines.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents"))


def _rates(df: DataFrame) -> DataFrame:
    k = F.col("document_id")
    rates = F.array(*[F.lit(x) for x in (3.0, 4.75, 5.5, 11.0, 12.625, 17.0, 19.0, 21.25)])
    return (df.select(F.col("o_orderkey").alias("document_id"))
            .withColumn("tax_rate", F.get(rates, (k % 8).cast("int")))
            .withColumn("shipping", F.when(k % 2 == 0, (k % 7919 + 31) / 100.0))
            .withColumn("discount_pct", F.when(k % 5 == 0, 10.0).when(k % 7 == 0, 5.0).otherwise(0.0)))


_TOTALS = """
  SELECT document_id, CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)), 0) AS BIGINT) / 100.0::DOUBLE AS subtotal,
         [3.0, 4.75, 5.5, 11.0, 12.625, 17.0, 19.0, 21.25][document_id % 8 + 1]::DOUBLE AS tax_rate,
         CASE WHEN document_id % 2 = 0 THEN (document_id % 7919 + 31) / 100.0::DOUBLE END AS shipping,
         CASE WHEN document_id % 5 = 0 THEN 10.0 WHEN document_id % 7 = 0 THEN 5.0 ELSE 0.0 END::DOUBLE AS discount_pct
  FROM (SELECT o_orderkey AS document_id, l_extendedprice FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY document_id"""


@query("invoice_totals", f"""
SELECT document_id, subtotal, tax, discount, {cents('subtotal + tax + coalesce(shipping, 0) - coalesce(discount, 0)')} AS total FROM (
  SELECT *, {cents('subtotal * tax_rate / 100.0::DOUBLE')} AS tax,
         CASE WHEN discount_pct > 0 THEN {cents('subtotal * discount_pct / 100.0::DOUBLE')} END AS discount FROM ({_TOTALS}))""")
def invoice_totals(spark, sf):
    return D.invoice_totals(_rates(t.table(spark, sf, "orders")), t.plain_lines(spark, sf)).select(
        "document_id", "subtotal", "tax", "discount", "total")


@query("receipt_totals", f"""
SELECT document_id, subtotal, tax, {cents('subtotal + tax - coalesce(shipping, 0)')} AS total FROM (
  SELECT *, {cents('subtotal * tax_rate / 100.0::DOUBLE')} AS tax FROM ({_TOTALS}))""")
def receipt_totals(spark, sf):
    headers = _rates(t.table(spark, sf, "orders")).withColumnRenamed("shipping", "discount")
    return D.receipt_totals(headers, t.plain_lines(spark, sf)).select("document_id", "subtotal", "tax", "total")


@query("totals_add_up", with_views("headers", """
SELECT document_id, subtotal, coalesce(s, 0.0::DOUBLE) AS line_sum FROM headers LEFT JOIN (
  SELECT l_orderkey AS document_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS s
  FROM lineitem GROUP BY l_orderkey) USING (document_id) WHERE NOT abs(coalesce(s, 0.0::DOUBLE) - subtotal) < 0.01"""))
def totals_add_up(spark, sf):
    return Q.totals_add_up(t.invoice_headers(spark, sf), t.plain_lines(spark, sf))


_BALANCE = """
SELECT account, id, ts, is_debit, amount, opening + CAST(sum(CASE WHEN is_debit THEN -c ELSE c END) OVER (
  PARTITION BY account ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM (
  SELECT o_custkey AS account, o_orderkey AS id, o_orderdate AS ts, o_orderstatus = 'F' AS is_debit,
         CAST(round(o_totalprice * 100) AS BIGINT) AS c, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE AS amount,
         CAST(round(coalesce(c_acctbal, 0) * 100) AS BIGINT) AS opening FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


@query("running_balance", f"SELECT account, id, balance / 100.0::DOUBLE AS balance FROM ({_BALANCE})")
def running_balance(spark, sf):
    return D.running_balance(t.transactions(spark, sf), t.openings(spark, sf)).select(
        "account", "id", F.col("balance").cast("double").alias("balance"))


@query("debit_credit", f"""
SELECT account, id, CASE WHEN is_debit THEN format('{{:,.2f}}', amount) ELSE '' END AS debit,
  CASE WHEN is_debit THEN '' ELSE format('{{:,.2f}}', amount) END AS credit, format('{{:,.2f}}', balance / 100.0::DOUBLE) AS balance_text
FROM ({_BALANCE})""")
def debit_credit(spark, sf):
    rows = D.running_balance(t.transactions(spark, sf), t.openings(spark, sf))
    return D.debit_credit_columns(rows).select("account", "id", "debit", "credit", "balance_text")


@query("closing_balance", """
SELECT coalesce(c_custkey, o_custkey) AS account, count(o_orderkey) AS n, CAST(round(coalesce(any_value(c_acctbal), 0) * 100) AS BIGINT) / 100.0::DOUBLE AS opening,
  (CAST(round(coalesce(any_value(c_acctbal), 0) * 100) AS BIGINT) + coalesce(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END
   * CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT), 0)) / 100.0::DOUBLE AS closing
FROM orders FULL JOIN customer ON o_custkey = c_custkey GROUP BY coalesce(c_custkey, o_custkey)""")
def closing_balance(spark, sf):
    return _as_doubles(D.closing_balance(t.transactions(spark, sf), t.openings(spark, sf)), "opening", "closing")


@query("utility_total", f"""
SELECT id, current_charges, {cents('current_charges + prev_balance - payments + fees')} AS total FROM (
  SELECT *, {cents('usage * rate')} AS current_charges FROM (
    SELECT p_partkey AS id, (p_size * 37 + 20)::DOUBLE AS usage, (p_partkey % 997 + 13) / 10000.0::DOUBLE AS rate,
      CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE 0.0 END AS prev_balance,
      CASE WHEN p_partkey % 6 = 0 THEN p_retailprice ELSE 0.0 END AS payments, (p_partkey % 389 + 7) / 100.0::DOUBLE AS fees FROM part))""")
def utility_total(spark, sf):
    k = F.col("p_partkey")
    bills = t.table(spark, sf, "part").select(
        k.alias("id"), (F.col("p_size") * 37 + 20).cast("double").alias("usage"), ((k % 997 + 13) / 10000.0).alias("rate"),
        F.when(k % 3 == 0, F.col("p_retailprice")).otherwise(0.0).alias("prev_balance"),
        F.when(k % 6 == 0, F.col("p_retailprice")).otherwise(0.0).alias("payments"), ((k % 389 + 7) / 100.0).alias("fees"))
    return D.utility_total(bills).select("id", "current_charges", "total")


@query("backordered", """
SELECT l_orderkey AS document_id, count(*) AS lines, CAST(sum(l_quantity - CASE WHEN l_returnflag = 'R' THEN floor(l_quantity / 2) ELSE l_quantity END) AS BIGINT) AS backordered
FROM lineitem GROUP BY l_orderkey""")
def backordered(spark, sf):
    """Returned lines were shipped by half; the rest is summed per delivery note."""
    q = F.col("l_quantity").cast("bigint")
    lines = t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), q.alias("qty_ordered"),
        F.when(F.col("l_returnflag") == "R", F.floor(q / 2)).otherwise(q).alias("qty_shipped"))
    return D.backordered(lines).groupBy("document_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("backordered").alias("backordered"))


_BANDS = ", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE, {lo}::DOUBLE, {hi}::DOUBLE)" for c, (a, b, lo, hi) in D.ITEM_BANDS.items())
_CATEGORIES = ["hardware", "retail", "saas", "freight", "office", "unlisted"]


@query("price_band", f"""
SELECT category, count(*) AS n, count(*) FILTER (NOT (unit_price BETWEEN lo AND hi AND quantity BETWEEN qlo AND qhi)) AS outside, min(lo) AS price_min, max(hi) AS price_max
FROM (SELECT category, quantity, unit_price, coalesce(a, 10.0) AS lo, coalesce(b, 1000.0) AS hi, coalesce(x, 1.0) AS qlo, coalesce(y, 10.0) AS qhi FROM (
  SELECT {_CATEGORIES}[l_partkey % 6 + 1] AS category, l_quantity AS quantity, ((2 * cents + q) // (2 * q)) / 100.0::DOUBLE AS unit_price
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q FROM lineitem))
  LEFT JOIN (VALUES {_BANDS}) AS bands(c, a, b, x, y) ON category = c) GROUP BY category""")
def price_band(spark, sf):
    names = F.array(*[F.lit(c) for c in _CATEGORIES])
    lines = t.plain_lines(spark, sf).withColumn(
        "category", F.get(names, (F.substring("description", 6, 20).cast("bigint") % 6).cast("int")))
    return D.price_band(lines).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("in_band")).alias("outside"),
        F.min("price_min").alias("price_min"), F.max("price_max").alias("price_max"))


@query("sample_per_group", """
SELECT category, item, pick FROM (SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY md5(item || '|42'), item) AS pick
  FROM (SELECT DISTINCT p_type AS category, p_name || ' ' || p_size AS item FROM part)) WHERE pick <= 7""")
def sample_per_group(spark, sf):
    items = t.table(spark, sf, "part").select(
        F.col("p_type").alias("category"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("item"))
    return D.sample_per_group(items, 7)


@query("sample_ids", """
SELECT c_custkey AS n, ['inv', 'rec', 'con', 'oth'][c_custkey % 4 + 1] || '_' || lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INT, '0')
  || CASE WHEN c_custkey % 7 = 0 THEN '_ocr' ELSE '' END AS id FROM customer""")
def sample_ids(spark, sf):
    kinds = F.array(*[F.lit(c) for c in ("invoice", "receipt", "contract", "other")])
    rows = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("n"), F.get(kinds, (F.col("c_custkey") % 4).cast("int")).alias("label"), (F.col("c_custkey") % 7 == 0).alias("is_ocr"))
    return D.sample_ids(rows).select("n", "id")


# --- strings of records -----------------------------------------------------------------------------------

@query("slug", """
SELECT c_custkey AS id, 'billing@' || left(replace(replace(replace(lower(c_name || ', ' || c_mktsegment || '-Group'), ' ', ''), ',', ''), '-', ''), 20) || '.com' AS email
FROM customer""")
def slug(spark, sf):
    name = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit("-Group"))
    return t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("billing@"), T.company_slug(name), F.lit(".com")).alias("email"))


@query("doc_number", """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'INV-' || strftime(o_orderdate, '%Y%m') || '-' || s
  WHEN 1 THEN p || '-' || strftime(o_orderdate, '%Y') || '-' || s WHEN 2 THEN '#' || s ELSE p || s END AS number
FROM (SELECT *, lpad((o_orderkey % 99999)::VARCHAR, 5, '0') AS s, upper(substr(o_orderpriority, 3, 3)) AS p FROM orders)""")
def doc_number(spark, sf):
    k = F.col("o_orderkey")
    return t.table(spark, sf, "orders").select(k.alias("id"), T.document_number(
        k % 4, F.col("o_orderdate").cast("date"), F.upper(F.substring("o_orderpriority", 3, 3)), k % 99999).alias("number"))


_CLAUSES = ["The fee is {rate} per hour for {duration}.", "Either party may end this with {notice_period} days notice.", "Payment is due in {payment_days} days at {rate}."]


@query("fill_placeholders", f"""
SELECT c_custkey AS id, replace(replace(replace(replace(clause, '{{rate}}', '$' || (c_custkey % 400 + 100)), '{{duration}}', 'one (1) year'),
  '{{notice_period}}', (c_custkey % 90)::VARCHAR), '{{payment_days}}', '30') AS clause
FROM (SELECT c_custkey, {_CLAUSES}[c_custkey % 3 + 1] AS clause FROM customer)""")
def fill_placeholders(spark, sf):
    k = F.col("c_custkey")
    values = F.create_map(F.lit("rate"), F.concat(F.lit("$"), (k % 400 + 100).cast("string")), F.lit("duration"), F.lit("one (1) year"),
                          F.lit("notice_period"), (k % 90).cast("string"), F.lit("payment_days"), F.lit("30"))
    clause = F.get(F.array(*[F.lit(c) for c in _CLAUSES]), (k % 3).cast("int"))
    return t.table(spark, sf, "customer").select(k.alias("id"), T.fill_placeholders(clause, values).alias("clause"))


def _sections(spark, sf):
    k = F.col("c_custkey")
    clause = F.concat(F.lit("Clause of "), F.col("c_name"))
    sections = F.array(
        F.struct(F.lit("Scope").alias("title"), F.array(clause, F.lit("Second clause")).alias("clauses")),
        F.struct(F.col("c_mktsegment").alias("title"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Only clause"))).alias("clauses")))
    return t.table(spark, sf, "customer").select(k.alias("document_id"), F.when(k % 9 == 0, F.slice(sections, 1, 1)).otherwise(sections).alias("sections"))


@query("number_sections", """
SELECT c_custkey AS document_id, 1 AS section_no, 'Scope' AS title, '1.1' AS number, 'Clause of ' || c_name AS clause FROM customer
UNION ALL SELECT c_custkey, 1, 'Scope', '1.2', 'Second clause' FROM customer
UNION ALL SELECT c_custkey, 2, c_mktsegment, '2.1', 'Only clause' FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 5 <> 0""")
def number_sections(spark, sf):
    return D.number_sections(_sections(spark, sf)).select("document_id", "section_no", "title", "number", "clause")


@query("nested_structure", """
SELECT CASE WHEN c_custkey % 9 = 0 THEN FALSE WHEN c_custkey % 5 = 0 THEN FALSE ELSE TRUE END AS well_formed, count(*) AS n FROM customer GROUP BY well_formed""")
def nested_structure(spark, sf):
    checked = Q.nested_structure(_sections(spark, sf), {"sections": 2}, inner={"sections": "clauses"})
    return checked.groupBy("well_formed").agg(F.count(F.lit(1)).alias("n"))


@query("nested_items", """
SELECT coalesce(n >= 2 AND positive, FALSE) AS well_formed, count(*) AS documents FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, bool_and(l_quantity > 0 AND l_extendedprice > 0) AS positive FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY well_formed""")
def nested_items(spark, sf):
    items = t.invoices(spark, sf).select("document_id", "record.line_items")
    checked = Q.nested_structure(items, {"line_items": 2}, positive={"line_items": ["quantity", "unit_price"]})
    return checked.groupBy("well_formed").agg(F.count(F.lit(1)).alias("documents"))


@query("mask_account", "SELECT c_custkey AS id, '****' || right(c_name, 4) AS account FROM customer")
def mask_account(spark, sf):
    return t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.mask_account(F.col("c_name")).alias("account"))


@query("address_line", "SELECT doc_id AS id, md5(replace(text, chr(10), ', ')) AS line FROM documents")
def address_line(spark, sf):
    return t.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(T.address_line(F.col("text"))).alias("line"))


@query("join_names", with_views("contracts", "SELECT document_id AS id, CASE WHEN len(parties) > 0 THEN array_to_string(parties, ', ') END AS names FROM contracts"))
def join_names(spark, sf):
    return t.contracts(spark, sf).select(F.col("document_id").alias("id"), T.join_names(F.col("record.parties")).alias("names"))


@query("render_invoices", with_views("rendered", "SELECT id, text FROM rendered"))
def render_invoices(spark, sf):
    return t.rendered(spark, sf)


@query("render_receipts", with_views("lines headers", """
SELECT document_id AS id, concat_ws(chr(10), vendor_name, 'Date: ' || invoice_date, items, 'Subtotal: $' || format('{:,.2f}', subtotal),
  CASE WHEN tax > 0 THEN 'Tax: $' || format('{:,.2f}', tax) END, 'TOTAL: $' || format('{:,.2f}', total_amount), payment_method) AS text
FROM headers LEFT JOIN (SELECT document_id, string_agg(concat_ws(' ', description, CASE WHEN quantity > 1 THEN 'x' || quantity::BIGINT END,
  '$' || format('{:,.2f}', amount)), chr(10) ORDER BY item_no) AS items FROM lines GROUP BY document_id) USING (document_id) WHERE o_orderstatus = 'P'"""))
def render_receipts(spark, sf):
    return D.render_text(t.receipts(spark, sf), "receipt").select(F.col("document_id").alias("id"), "text")


@query("render_contracts", with_views("contracts", """
SELECT document_id AS id, concat_ws(chr(10), 'AGREEMENT', 'This Agreement is entered into as of ' || effective_date || ' (the "Effective Date"), by and between:',
  CASE WHEN len(parties) > 0 THEN array_to_string(parties, chr(10) || 'AND' || chr(10)) END, '1. ' || key_terms[1], '2. ' || key_terms[2],
  'Term ends: ' || expiration_date, 'Contract value: $' || format('{:,.2f}', contract_value), summary, 'IN WITNESS WHEREOF, each party shall sign this Agreement.') AS text
FROM contracts"""))
def render_contracts(spark, sf):
    return D.render_text(t.contracts(spark, sf), "contract").select(F.col("document_id").alias("id"), "text")


def _detailed(spark, sf, records):
    """Optional parts by formula of the order: buyer and nation, discount, shipping and tip, some of them missing or zero."""
    orders, customer = t.table(spark, sf, "orders"), t.table(spark, sf, "customer")
    nations = F.broadcast(t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    k = F.col("o_orderkey")
    parts = {
        "vendor_address": F.when(k % 2 == 0, F.concat((k % 90 + 1).cast("string"), F.lit(" Main St\nFloor 2"))), "vendor_city": F.when(k % 5 != 0, F.lit("Port")),
        "vendor_state": F.when(k % 3 == 0, F.lit("WA")), "vendor_zip": F.when(k % 10 != 0, F.lpad((k % 1000).cast("string"), 5, "0")),
        "vendor_phone": F.when(k % 3 == 1, F.lit("555-0100")), "bill_to_name": F.col("c_name"), "bill_to_city": F.col("n_name"),
        "ship_to_name": F.when(k % 4 == 0, F.col("c_name")), "discount": (k % 3) * 1250.5, "discount_pct": F.when(k % 2 == 1, F.lit(2.5)),
        "discount_desc": F.when(k % 2 == 0, F.lit("member")), "shipping": F.when(k % 5 > 1, (k % 5 - 2) * 10.0), "tax_rate": F.when(k % 7 != 0, F.lit(8.0)),
        "tip": F.when(k % 2 == 0, k % 4 * 1.5), "card_last_four": F.when(k % 6 == 0, F.lpad((k % 10000).cast("string"), 4, "0"))}
    details = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nations, "c_nationkey", "left")
               .select(k.alias("document_id"), F.struct(*[c.alias(n) for n, c in parts.items()]).alias("details")))
    return records.join(details, "document_id")


_PLACE = """nullif(concat_ws(chr(10), CASE WHEN k % 2 = 0 THEN (k % 90 + 1)::VARCHAR || ' Main St, Floor 2' END,
    nullif(concat_ws(', ', CASE WHEN k % 5 <> 0 THEN 'Port' END,
                     nullif(concat_ws(' ', CASE WHEN k % 3 = 0 THEN 'WA' END, CASE WHEN k % 10 <> 0 THEN lpad((k % 1000)::VARCHAR, 5, '0') END), '')), '')), '')"""
_RATE = "'Tax' || CASE WHEN k % 7 <> 0 THEN ' (8.0%)' ELSE '' END || ': $' || format('{:,.2f}', tax)"
_PHONE = "CASE WHEN k % 3 = 1 THEN '555-0100' END"


@query("render_invoice_details", with_views("lines headers", f"""
SELECT document_id AS id, concat_ws(chr(10), vendor_name, {_PLACE}, {_PHONE}, 'INVOICE', 'Invoice #: ' || invoice_number, 'Date: ' || invoice_date, 'Due Date: ' || due_date,
  CASE WHEN c_name IS NOT NULL THEN concat_ws(chr(10), 'Bill To:', c_name, n_name) END, CASE WHEN k % 4 = 0 AND c_name IS NOT NULL THEN 'Ship To:' || chr(10) || c_name END,
  'Description Qty Unit Price Amount', items, 'Subtotal: $' || format('{{:,.2f}}', subtotal),
  CASE WHEN k % 3 <> 0 THEN 'Discount' || CASE WHEN k % 2 = 1 THEN ' (2.5%)' ELSE '' END || ': -$' || format('{{:,.2f}}', ((k % 3) * 1250.5)::DOUBLE) END,
  CASE WHEN k % 5 > 2 THEN 'Shipping: $' || format('{{:,.2f}}', ((k % 5 - 2) * 10)::DOUBLE) END, {_RATE},
  'Total Due: $' || format('{{:,.2f}}', total_amount), 'Payment Terms: ' || payment_terms) AS text
FROM (SELECT *, document_id AS k FROM headers) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (
  SELECT document_id, string_agg(concat_ws(' ', description, quantity::VARCHAR, '$' || format('{{:,.2f}}', unit_price), '$' || format('{{:,.2f}}', amount)),
         chr(10) ORDER BY item_no) AS items FROM lines GROUP BY document_id) USING (document_id)"""))
def render_invoice_details(spark, sf):
    """Invoices with addresses, buyer, discount and shipping where an order has them."""
    return D.render_text(_detailed(spark, sf, t.invoices(spark, sf)), "invoice", details="details").select(F.col("document_id").alias("id"), "text")


@query("render_receipt_details", with_views("lines headers", f"""
SELECT document_id AS id, concat_ws(chr(10), vendor_name, {_PLACE}, {_PHONE}, 'Date: ' || invoice_date, items, 'Subtotal: $' || format('{{:,.2f}}', subtotal),
  CASE WHEN k % 3 <> 0 THEN 'Discount' || CASE WHEN k % 2 = 0 THEN ' (member)' ELSE '' END || ': -$' || format('{{:,.2f}}', ((k % 3) * 1250.5)::DOUBLE) END,
  CASE WHEN tax > 0 THEN {_RATE} END, CASE WHEN k % 4 = 2 THEN 'Tip: $3.00' END, 'TOTAL: $' || format('{{:,.2f}}', total_amount),
  payment_method || CASE WHEN k % 6 = 0 THEN ' ending ' || lpad((k % 10000)::VARCHAR, 4, '0') ELSE '' END) AS text
FROM (SELECT *, document_id AS k FROM headers) LEFT JOIN (
  SELECT document_id, string_agg(concat_ws(' ', description, CASE WHEN quantity > 1 THEN 'x' || quantity::BIGINT END, '$' || format('{{:,.2f}}', amount)),
         chr(10) ORDER BY item_no) AS items FROM lines GROUP BY document_id) USING (document_id) WHERE o_orderstatus = 'P'"""))
def render_receipt_details(spark, sf):
    """Receipts with address, discount, tip and card where an order has them."""
    return D.render_text(_detailed(spark, sf, t.receipts(spark, sf)), "receipt", details="details").select(F.col("document_id").alias("id"), "text")


# --- money and fields in documents ------------------------------------------------------------------------

_AMOUNTS = r"regexp_extract_all(text, '\$[\d,.]+')"


@query("dollar_amounts", with_views("rendered", f"""
SELECT id, len({_AMOUNTS}) AS n_amounts, TRY_CAST(replace(replace({_AMOUNTS}[-1], '$', ''), ',', '') AS DOUBLE) AS last_amount FROM rendered"""))
def dollar_amounts(spark, sf):
    return Q.last_amounts(t.rendered(spark, sf))


@query("amount_spread", with_views("rendered", f"""
SELECT count(*) AS n, min(a) AS low, max(a) AS high, max(a) / greatest(min(a), 0.01) AS spread FROM (
  SELECT TRY_CAST(replace(replace({_AMOUNTS}[-1], '$', ''), ',', '') AS DOUBLE) AS a FROM rendered) WHERE a IS NOT NULL"""))
def amount_spread(spark, sf):
    return Q.amount_spread(t.rendered(spark, sf))


@query("comma_check", with_views("rendered", f"""
SELECT id, len(big) AS big_amounts, len(list_filter(big, lambda a: contains(a, ','))) > 0 AS has_comma FROM (
  SELECT id, list_filter({_AMOUNTS}, lambda a: TRY_CAST(replace(replace(a, '$', ''), ',', '') AS DOUBLE) >= 1000) AS big FROM rendered) WHERE len(big) > 0"""))
def comma_check(spark, sf):
    return Q.thousands_commas(t.rendered(spark, sf))


@query("required_fields", with_views("headers", """
SELECT 'invoice_date' AS field, count(*) FILTER (invoice_date IS NULL) AS missing FROM headers
UNION ALL SELECT 'due_date', count(*) FILTER (due_date IS NULL) FROM headers
UNION ALL SELECT 'subtotal', count(*) FILTER (subtotal IS NULL) FROM headers
UNION ALL SELECT 'any', count(*) FILTER (invoice_date IS NULL OR due_date IS NULL OR subtotal IS NULL) FROM headers"""))
def required_fields(spark, sf):
    return Q.required_fields(t.invoice_headers(spark, sf), ["invoice_date", "due_date", "subtotal"])


@query("variety", with_views("headers", "SELECT count(DISTINCT payment_terms) AS terms, count(DISTINCT vendor_name) AS vendors FROM headers"))
def variety(spark, sf):
    """Distinct values of two columns, each counted in its own aggregate."""
    h = t.invoice_headers(spark, sf)
    return h.agg(F.count_distinct("payment_terms").alias("terms"), F.count_distinct("vendor_name").alias("vendors"))


@query("category_variety", "SELECT count(DISTINCT p_type) AS variety FROM part")
def category_variety(spark, sf):
    return Q.category_variety(t.table(spark, sf, "part"), "p_type")


@query("payment_consistency", """
SELECT document_id, CASE WHEN method IN ('Visa', 'Debit') THEN 'card without four digits' ELSE 'cash without change' END AS problem FROM (
  SELECT o_orderkey AS document_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Visa' WHEN '2-HIGH' THEN 'Debit' WHEN '3-MEDIUM' THEN 'Cash'
         WHEN '4-NOT SPECIFIED' THEN 'Apple Pay' ELSE 'Google Pay' END AS method,
    CASE WHEN o_orderkey % 10 <> 0 THEN right(lpad(o_custkey::VARCHAR, 4, '0'), 4) WHEN o_orderkey % 20 = 0 THEN '12' END AS suffix,
    (o_orderkey % 20) / 10.0 AS change_due FROM orders WHERE o_orderstatus = 'P')
WHERE (method IN ('Visa', 'Debit') AND length(coalesce(suffix, '')) <> 4) OR (method = 'Cash' AND NOT change_due > 0)""")
def payment_consistency(spark, sf):
    k = F.col("o_orderkey")
    methods = F.create_map(*[F.lit(v) for pair in t.CARDS.items() for v in pair])
    receipts = t.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        k.alias("document_id"), F.element_at(methods, F.col("o_orderpriority")).alias("payment_method"),
        F.when(k % 10 != 0, F.right(F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.lit(4))).when(k % 20 == 0, "12").alias("card_last_four"),
        ((k % 20) / 10.0).alias("change_due"))
    return Q.payment_consistency(receipts).select("document_id", "problem")
