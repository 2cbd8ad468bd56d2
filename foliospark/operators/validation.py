"""Consistency rules for extracted records.

A rule is a Column that gives its message or NULL. Errors block saving, warnings do not. The nested form checks one
record per row; the flat form at the end checks a table of headers against a table of lines, for documents whose
lines are not (or cannot be) gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.dates import parse_date
from foliospark.functions.numbers import exact_sum, let, number_text, round_cents
from foliospark.functions.rows import explode_rows
from foliospark.functions.text import strip
from foliospark.schemas import LINE_ITEM_TOLERANCE, TOTAL_TOLERANCE


# --- rules on single values -------------------------------------------------------------------------------

def vendor_missing(vendor: Column) -> Column:
    return F.when(F.coalesce(strip(vendor), F.lit("")) == "", F.lit("Vendor name is empty"))


def no_line_items(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) <= 0, F.lit("No line items found"))


def line_problems(number: Column, quantity: Column, price: Column, amount: Column, expected: Column) -> dict[str, Column]:
    """The three line rules by code, in message order. ``expected`` is quantity times price in whole cents."""
    label = F.concat(F.lit("Line "), number.cast("string"), F.lit(": "))
    return {
        "quantity_not_positive": F.when(
            quantity <= 0,
            F.concat(label, F.lit("negative or zero quantity ("), number_text(quantity), F.lit(")"))),
        "negative_unit_price": F.when(
            price < 0, F.concat(label, F.lit("negative unit price ("), number_text(price), F.lit(")"))),
        "amount_mismatch": F.when(
            F.abs(amount - expected) > LINE_ITEM_TOLERANCE,
            F.concat(label, F.lit("amount "), number_text(amount), F.lit(" != qty "), number_text(quantity),
                     F.lit(" x price "), number_text(price), F.lit(" = "), number_text(expected))),
    }


def subtotal_mismatch(count: Column, line_sum: Column, subtotal: Column) -> Column:
    def rule(rounded: Column) -> Column:
        return F.when(
            F.abs(rounded - subtotal) > TOTAL_TOLERANCE,
            F.concat(F.lit("Line items sum "), number_text(rounded), F.lit(" != subtotal "), number_text(subtotal)))
    return F.when((count > 0) & subtotal.isNotNull(), let(let(line_sum, round_cents), rule))


def line_sum_out_of_range(count: Column, line_sum: Column) -> Column:
    """Only in the flat form: a sum that no decimal holds."""
    return F.when((count > 0) & line_sum.isNull(), F.lit("Line items sum is out of range"))


def total_not_positive(total: Column) -> Column:
    return F.when(total <= 0, F.concat(F.lit("Total amount must be positive, got "), number_text(total)))


def total_mismatch(subtotal: Column, tax: Column, total: Column) -> Column:
    def rule(expected: Column) -> Column:
        return F.when(
            F.abs(total - expected) > TOTAL_TOLERANCE,
            F.concat(F.lit("subtotal "), number_text(subtotal), F.lit(" + tax "), number_text(tax), F.lit(" = "),
                     number_text(expected), F.lit(", but total is "), number_text(total)))
    return F.when(total > 0, let(round_cents(subtotal + tax), rule))


def unparsed_date(kind: str, text: Column) -> Column:
    return F.when((text != "") & parse_date(text).isNull(),
                  F.concat(F.lit(f"Could not parse {kind} date: "), text))


def date_before(later: Column, earlier: Column, message: str) -> Column:
    return F.when(parse_date(later) < parse_date(earlier), F.lit(message))


def due_before_invoice(due: Column, issued: Column) -> Column:
    return date_before(due, issued, "Due date is before invoice date")


def no_parties(parties: Column) -> Column:
    return F.when(F.coalesce(F.size(parties), F.lit(0)) <= 0, F.lit("No parties listed"))


def negative_value(value: Column) -> Column:
    return F.when(value < 0, F.concat(F.lit("Negative contract value: "), number_text(value)))


def expires_before_effective(expiration: Column, effective: Column) -> Column:
    return date_before(expiration, effective, "Expiration date is before effective date")


# --- whole records ----------------------------------------------------------------------------------------

def _messages(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda m: m.isNotNull())


def _result(errors: Column, warnings: Column) -> Column:
    """A plain struct, no cast around it: reading one of its fields then computes only that field."""
    return F.struct(
        (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def _line_warnings(items: Column) -> Column:
    numbers = F.transform(items, lambda x: F.struct(
        x["quantity"].alias("q"), x["unit_price"].alias("p"), x["amount"].alias("a"),
        round_cents(x["quantity"] * x["unit_price"]).alias("e")))
    per_line = F.transform(numbers, lambda x, i: _messages(*line_problems(i + 1, x["q"], x["p"], x["a"], x["e"]).values()))
    return F.coalesce(F.flatten(per_line), F.array().cast("array<string>"))


def _line_sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["amount"])


def _purchase_errors(r: Column) -> Column:
    return _messages(vendor_missing(r["vendor_name"]), no_line_items(F.size(r["line_items"])),
                     total_not_positive(r["total_amount"]))


def _purchase_warnings(r: Column, *dates: Column) -> Column:
    return F.concat(
        _line_warnings(r["line_items"]),
        _messages(subtotal_mismatch(F.size(r["line_items"]), _line_sum(r["line_items"]), r["subtotal"]),
                  total_mismatch(r["subtotal"], r["tax"], r["total_amount"]), *dates))


def _invoice_messages(r: Column) -> tuple[Column, Column]:
    return _purchase_errors(r), _purchase_warnings(
        r, unparsed_date("invoice", r["invoice_date"]), unparsed_date("due", r["due_date"]),
        due_before_invoice(r["due_date"], r["invoice_date"]))


def _receipt_messages(r: Column) -> tuple[Column, Column]:
    return _purchase_errors(r), _purchase_warnings(r, unparsed_date("receipt", r["receipt_date"]))


def _contract_messages(r: Column) -> tuple[Column, Column]:
    return _messages(no_parties(r["parties"])), _messages(
        negative_value(r["contract_value"]), unparsed_date("effective", r["effective_date"]),
        unparsed_date("expiration", r["expiration_date"]),
        expires_before_effective(r["expiration_date"], r["effective_date"]))


def invoice_result(r: Column) -> Column:
    return _result(*_invoice_messages(r))


def receipt_result(r: Column) -> Column:
    return _result(*_receipt_messages(r))


def contract_result(r: Column) -> Column:
    return _result(*_contract_messages(r))


def validate_invoice(df: DataFrame, record: str = "record") -> DataFrame:
    """Add ``validation`` (is_valid, errors, warnings) for an invoice struct column."""
    return df.withColumn("validation", invoice_result(F.col(record)))


def validate_receipt(df: DataFrame, record: str = "record") -> DataFrame:
    return df.withColumn("validation", receipt_result(F.col(record)))


def validate_contract(df: DataFrame, record: str = "record") -> DataFrame:
    return df.withColumn("validation", contract_result(F.col(record)))


def validate(df: DataFrame, type_column: str = "record_type") -> DataFrame:
    """Check rows of mixed type: struct columns ``invoice``, ``receipt``, ``contract``, chosen by ``record_type``.

    A ``generic`` record always passes; any other type is an error. Errors and warnings are chosen by type apart: who only
    asks for ``is_valid`` makes no warnings.
    """
    kind = F.col(type_column)
    none = F.array().cast("array<string>")
    errors = F.array(F.concat(F.lit("Unknown extraction type: "), F.coalesce(kind, F.lit("NULL"))))
    warnings = none
    messages = {"generic": (none, none), "contract": _contract_messages(F.col("contract")),
                "receipt": _receipt_messages(F.col("receipt")), "invoice": _invoice_messages(F.col("invoice"))}
    for name, (wrong, odd) in messages.items():
        errors = F.when(kind == name, wrong).otherwise(errors)
        warnings = F.when(kind == name, odd).otherwise(warnings)
    return df.withColumn("validation", _result(errors, warnings))


# --- counts per rule, without texts -----------------------------------------------------------------------

LINE_RULES = ["quantity_not_positive", "negative_unit_price", "amount_mismatch"]


def line_facts() -> list[Column]:
    """Aggregates over the lines of a document: how many there are, their sum, and how many break each line rule."""
    quantity, price, amount = F.col("quantity"), F.col("unit_price"), F.col("amount")
    broken = [quantity <= 0, price < 0, F.abs(amount - round_cents(quantity * price)) > LINE_ITEM_TOLERANCE]
    return [F.count(F.lit(1)).alias("line_count"), exact_sum(amount).alias("line_sum"),
            *[F.count_if(rule).alias(name) for name, rule in zip(LINE_RULES, broken)]]


def rule_counts(documents: DataFrame) -> DataFrame:
    """``(severity, rule, findings, documents)`` over headers that carry ``line_facts``: one row a document, plain predicates."""
    subtotal, tax, total, count = F.col("subtotal"), F.col("tax"), F.col("total_amount"), F.col("line_count")
    dates = documents.withColumns({"_issued": parse_date(F.col("invoice_date")), "_due": parse_date(F.col("due_date"))})
    broken = {
        ("error", "vendor_missing"): F.coalesce(strip(F.col("vendor_name")), F.lit("")) == "",
        ("error", "no_line_items"): F.coalesce(count, F.lit(0)) <= 0,
        ("error", "total_not_positive"): total <= 0,
        ("warning", "subtotal_mismatch"): (count > 0) & (F.abs(round_cents(F.col("line_sum")) - subtotal) > TOTAL_TOLERANCE),
        ("warning", "line_sum_out_of_range"): (count > 0) & F.col("line_sum").isNull(),
        ("warning", "total_mismatch"): (total > 0) & (F.abs(total - round_cents(subtotal + tax)) > TOTAL_TOLERANCE),
        ("warning", "invoice_date_unparsed"): (F.col("invoice_date") != "") & F.col("_issued").isNull(),
        ("warning", "due_date_unparsed"): (F.col("due_date") != "") & F.col("_due").isNull(),
        ("warning", "due_before_invoice"): F.col("_due") < F.col("_issued"),
    }
    found = {key: F.when(F.coalesce(rule, F.lit(False)), 1).otherwise(0).cast("bigint") for key, rule in broken.items()}
    found |= {("warning", name): F.coalesce(F.col(name), F.lit(0)) for name in LINE_RULES}
    sums = [F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), F.sum(n).alias("findings"), F.count_if(n > 0).alias("documents"))
            for (s, r), n in found.items()]
    return dates.agg(F.array(*sums).alias("r")).select(F.inline("r")).filter("findings > 0")


# --- flat form: one row per line, one row per header ------------------------------------------------------

def line_findings(lines: DataFrame) -> DataFrame:
    """Line rules over ``(document_id, item_no, quantity, unit_price, amount)``: one row per message, no shuffle."""
    lines = lines.withColumn("expected", round_cents(F.col("quantity") * F.col("unit_price")))
    rules = line_problems(F.col("item_no"), F.col("quantity"), F.col("unit_price"), F.col("amount"), F.col("expected"))
    found = F.filter(
        F.array(*[F.struct(F.lit(code).alias("rule"), message.alias("message")) for code, message in rules.items()]),
        lambda x: x["message"].isNotNull())
    return (explode_rows(lines, found, "f", "document_id", "item_no")
            .select("document_id", "item_no", F.lit("warning").alias("severity"), "f.rule", "f.message"))


def line_sums(lines: DataFrame) -> DataFrame:
    """Lines and their summed amount per document; partial sums are built before the shuffle, so a document with
    very many lines costs no more than any other."""
    return lines.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        exact_sum(F.col("amount")).alias("line_sum"))


def header_findings(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Header rules of an invoice over flat tables: one row per message.

    Amounts are added as decimals and rounded once, so the sum depends neither on the order of the lines nor on their number. A
    document with an amount beyond any decimal is a finding of its own.
    """
    h = headers.join(line_sums(lines), "document_id", "left")
    rules = [
        ("error", "vendor_missing", vendor_missing(F.col("vendor_name"))),
        ("error", "no_line_items", no_line_items(F.col("line_count"))),
        ("error", "total_not_positive", total_not_positive(F.col("total_amount"))),
        ("warning", "subtotal_mismatch", subtotal_mismatch(F.col("line_count"), F.col("line_sum"), F.col("subtotal"))),
        ("warning", "line_sum_out_of_range", line_sum_out_of_range(F.col("line_count"), F.col("line_sum"))),
        ("warning", "total_mismatch", total_mismatch(F.col("subtotal"), F.col("tax"), F.col("total_amount"))),
        ("warning", "invoice_date_unparsed", unparsed_date("invoice", F.col("invoice_date"))),
        ("warning", "due_date_unparsed", unparsed_date("due", F.col("due_date"))),
        ("warning", "due_before_invoice", due_before_invoice(F.col("due_date"), F.col("invoice_date"))),
    ]
    found = F.filter(
        F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(code).alias("rule"), m.alias("message"))
                  for s, code, m in rules]),
        lambda x: x["message"].isNotNull())
    return explode_rows(h, found, "f", "document_id").select("document_id", "f.*")
