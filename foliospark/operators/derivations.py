"""Arithmetic, running totals and text of the document records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numbers import exact_sum, line_amount, money_text, number_text, percent_of, round_cents
from foliospark.functions.ordering import hash_rank, running_sums, seeded_order, with_even_bucket
from foliospark.functions.text import address_line

# Price and quantity ranges per category, and the range of every other category.
ITEM_BANDS = {
    "construction": (50.0, 15000.0, 1, 20),
    "legal_services": (75.0, 650.0, 1, 10),
    "retail": (10.0, 800.0, 1, 50),
    "office": (5.0, 500.0, 1, 30),
    "saas": (10.0, 5000.0, 1, 25),
    "cloud_services": (0.5, 3000.0, 1, 1),
    "healthcare": (5.0, 5000.0, 1, 10),
    "freight": (25.0, 5000.0, 1, 5),
    "technology": (50.0, 2000.0, 1, 20),
    "services": (100.0, 3000.0, 1, 10),
    "manufacturing": (200.0, 10000.0, 1, 5),
    "hardware": (5.0, 500.0, 1, 25),
    "hospitality": (20.0, 2000.0, 1, 10),
}
DEFAULT_ITEM_BAND = (10.0, 1000.0, 1, 10)
STORE_BANDS = {
    "grocery": (1.5, 25.0, 1, 4),
    "restaurant": (6.0, 45.0, 1, 4),
    "hardware": (3.0, 65.0, 1, 4),
    "electronics": (8.0, 80.0, 1, 4),
    "pharmacy": (4.0, 50.0, 1, 4),
}
DEFAULT_STORE_BAND = (1.5, 50.0, 1, 4)
ID_PREFIXES = {"invoice": "inv", "receipt": "rec", "contract": "con", "other": "oth"}


def with_line_amount(lines: DataFrame) -> DataFrame:
    return lines.withColumn("amount", line_amount(F.col("quantity"), F.col("unit_price")))


def _with_subtotals(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with the sum of their lines: 0 without any, NULL where the sum is out of range, so that nothing counts as a total then."""
    sums = lines.groupBy("document_id").agg(exact_sum(F.col("amount")).alias("subtotal"), F.count("amount").alias("_amounts"))
    none = F.coalesce("_amounts", F.lit(0)) == 0
    return headers.join(sums, "document_id", "left").withColumn("subtotal", F.when(none, 0.0).otherwise(F.col("subtotal"))).drop("_amounts")


def invoice_totals(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Subtotal, tax, discount and total per invoice: ``headers(document_id, tax_rate, shipping, discount_pct)``."""
    h = _with_subtotals(headers, lines)
    h = (h.withColumn("tax", percent_of(F.col("subtotal"), F.col("tax_rate")))
         .withColumn("discount", F.when(F.col("discount_pct") > 0, percent_of(F.col("subtotal"), F.col("discount_pct")))))
    total = (F.col("subtotal") + F.col("tax") + F.coalesce("shipping", F.lit(0.0)) - F.coalesce("discount", F.lit(0.0)))
    return h.withColumn("total", round_cents(total))


def receipt_totals(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """As for invoices, with a flat ``discount`` and no shipping."""
    h = _with_subtotals(headers, lines)
    h = h.withColumn("tax", percent_of(F.col("subtotal"), F.col("tax_rate")))
    return h.withColumn("total", round_cents(F.col("subtotal") + F.col("tax") - F.coalesce("discount", F.lit(0.0))))


def running_balance(transactions: DataFrame, opening: DataFrame) -> DataFrame:
    """Balance after every transaction: ``transactions(account, ts, id, amount, is_debit)``, ``opening(account, opening)``.

    Sums run over buckets first and then inside one bucket. A bucket is a span of time between two quantiles of all
    transactions, and a busy span is cut again at its own account's quantiles, so one account in one month is spread over
    many tasks too. An account without opening row starts at 0. Amounts are two-place decimals: rounding after each step and at the end is then the same.
    """
    signed = F.when(F.col("is_debit"), -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)")
    t = with_even_bucket(transactions.withColumn("signed", signed), ["account"], "ts")
    summed = running_sums(t, ["account"], "_bucket", [F.col("ts"), F.col("id")], {"signed": "moved"})
    return (summed.join(opening.select("account", F.col("opening").cast("decimal(18,2)").alias("opening")), "account", "left")
            .withColumn("opening", F.coalesce("opening", F.lit(0).cast("decimal(18,2)")))
            .withColumn("balance", (F.col("opening") + F.col("moved")).cast("decimal(18,2)"))
            .drop("_bucket", "moved", "signed"))


def closing_balance(transactions: DataFrame, opening: DataFrame) -> DataFrame:
    """Opening and closing balance of every account that has an opening row or a transaction; only partial sums are shuffled."""
    signed = F.when(F.col("is_debit"), -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)")
    moved = transactions.groupBy("account").agg(F.sum(signed).alias("moved"), F.count(F.lit(1)).alias("n"))
    start, change = (F.coalesce(F.col(c).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")) for c in ("opening", "moved"))
    return (opening.join(moved, "account", "full")
            .select("account", F.coalesce("n", F.lit(0)).alias("n"), start.alias("opening"),
                    (start + change).cast("decimal(18,2)").alias("closing")))


def debit_credit_columns(df: DataFrame) -> DataFrame:
    """Amount as statement text in the debit or the credit column, the other one empty."""
    shown = money_text(F.col("amount"))
    return (df.withColumn("debit", F.when(F.col("is_debit"), shown).otherwise(""))
            .withColumn("credit", F.when(F.col("is_debit"), "").otherwise(shown))
            .withColumn("balance_text", money_text(F.col("balance"))))


def utility_total(df: DataFrame) -> DataFrame:
    current = round_cents(F.col("usage") * F.col("rate"))
    return (df.withColumn("current_charges", current)
            .withColumn("total", round_cents(F.col("current_charges") + F.col("prev_balance") - F.col("payments") + F.col("fees"))))


def backordered(df: DataFrame) -> DataFrame:
    """Ordered minus shipped per line."""
    return df.withColumn("backordered", F.col("qty_ordered") - F.col("qty_shipped"))


def number_sections(df: DataFrame, key: str = "document_id") -> DataFrame:
    """``sections array<struct<title, clauses>>`` to one row per clause, numbered ``s.c``."""
    sections = df.select(key, F.posexplode("sections").alias("s", "section"))
    return (sections.select(key, (F.col("s") + 1).alias("section_no"), "section.title",
                            F.posexplode("section.clauses").alias("c", "clause"))
            .select(key, "section_no", "title", (F.col("c") + 1).alias("clause_no"),
                    F.format_string("%d.%d", "section_no", F.col("c") + 1).alias("number"), "clause"))


def price_band(items: DataFrame, bands: dict[str, tuple] | None = None, default: tuple | None = None) -> DataFrame:
    """Add the price and quantity range of each row's category and whether the row lies inside it."""
    default = default or DEFAULT_ITEM_BAND
    table = bands or ITEM_BANDS
    names = ("price_min", "price_max", "qty_min", "qty_max")
    lookup = {n: F.create_map(*[F.lit(v) for c, band in table.items() for v in (c, float(band[i]))])
              for i, n in enumerate(names)}
    out = items
    for i, name in enumerate(names):
        out = out.withColumn(name, F.coalesce(F.try_element_at(lookup[name], F.col("category")), F.lit(float(default[i]))))
    return out.withColumn("in_band", F.col("unit_price").between(F.col("price_min"), F.col("price_max"))
                          & F.col("quantity").between(F.col("qty_min"), F.col("qty_max")))


def sample_per_group(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Up to ``k`` distinct items of every category, in a seeded order."""
    items = df.select("category", "item").distinct().withColumn("_order", seeded_order(F.col("item"), seed))
    return hash_rank(items, ["category"], "_order", ["item"], "pick", at_most=F.lit(k), digits=2).drop("_order", "_n")


def sample_ids(df: DataFrame, number: str = "n") -> DataFrame:
    """``inv_0001``-style ids by label; OCR copies end in ``_ocr``."""
    prefix = F.create_map(*[F.lit(v) for pair in ID_PREFIXES.items() for v in pair])
    suffix = F.when(F.col("is_ocr"), "_ocr").otherwise("") if "is_ocr" in df.columns else F.lit("")
    base = F.format_string("%s_%04d", F.element_at(prefix, F.col("label")), F.col(number))
    return df.withColumn("id", F.concat(base, suffix))


# --- records as document text -----------------------------------------------------------------------------

class Details:
    """Optional parts of a rendered document, by name: the fields of a struct column. A part that the struct has not is NULL, as a
    field without value is, and its line is left out."""

    def __init__(self, column: Column | None = None, names: list[str] | None = None):
        self.column, self.names = column, set(names or [])

    def __getitem__(self, name: str) -> Column:
        return self.column[name] if name in self.names else F.lit(None)

    def text(self, name: str) -> Column:
        value = self[name].cast("string")
        return F.when(F.trim(value) != "", value)

    def money(self, label: Column | str, name: str, sign: str = "") -> Column:
        """A labelled amount; none where it is missing or zero."""
        amount, label = self[name].cast("double"), F.lit(label) if isinstance(label, str) else label
        return F.when(amount != 0, F.concat(label, F.lit(f": {sign}"), _dollars(amount)))

    def address(self, prefix: str) -> Column:
        """Street and city on a line each: ``12 Main St``, ``Springfield, IL 62701``; NULL without either."""
        place = F.concat_ws(", ", self.text(f"{prefix}_city"), _joined(" ", self.text(f"{prefix}_state"), self.text(f"{prefix}_zip")))
        return _joined("\n", address_line(self.text(f"{prefix}_address")), F.when(place != "", place))

    def party(self, label: str, prefix: str) -> Column:
        """Whom a document is billed or sent to; the block needs a name."""
        name = self.text(f"{prefix}_name")
        return F.when(name.isNotNull(), F.concat_ws("\n", F.lit(f"{label}:"), name, self.text(f"{prefix}_company"), self.address(prefix)))


def _joined(mark: str, *parts: Column) -> Column:
    text = F.concat_ws(mark, *parts)
    return F.when(text != "", text)


def _dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), money_text(c))


def _labelled(label: str, c: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), c)


def _with_note(label: str, note: Column) -> Column:
    return F.concat(F.lit(label), F.coalesce(F.concat(F.lit(" ("), note, F.lit(")")), F.lit("")))


def _rate(c: Column) -> Column:
    return F.concat(number_text(c.cast("double")), F.lit("%"))


def render_invoice(r: Column, more: Details = Details()) -> Column:
    """An invoice record as text, one line per part; parts that are missing are left out."""
    items = F.transform(r["line_items"], lambda x: F.concat_ws(
        " ", x["description"], number_text(x["quantity"]), _dollars(x["unit_price"]), _dollars(x["amount"])))
    return F.concat_ws(
        "\n", r["vendor_name"], more.address("vendor"), more.text("vendor_phone"), more.text("vendor_email"), _labelled("Tax ID", more.text("vendor_tax_id")),
        F.lit("INVOICE"), _labelled("Invoice #", r["invoice_number"]),
        _labelled("Date", r["invoice_date"]), _labelled("Due Date", r["due_date"]), _labelled("PO #", more.text("po_number")),
        more.party("Bill To", "bill_to"), more.party("Ship To", "ship_to"),
        F.lit("Description Qty Unit Price Amount"), items,
        _labelled("Subtotal", _dollars(r["subtotal"])), more.money(_with_note("Discount", _rate(more["discount_pct"])), "discount", "-"),
        more.money("Shipping", "shipping"), F.concat(_with_note("Tax", _rate(more["tax_rate"])), F.lit(": "), _dollars(r["tax"])),
        _labelled("Total Due", _dollars(r["total_amount"])), _labelled("Payment Terms", r["payment_terms"]), more.text("notes"))


def render_receipt(r: Column, more: Details = Details()) -> Column:
    """A receipt record as text; a quantity above one is shown after the item."""
    items = F.transform(r["line_items"], lambda x: F.concat_ws(
        " ", x["description"],
        F.when(x["quantity"] > 1, F.concat(F.lit("x"), F.regexp_replace(number_text(x["quantity"]), r"\.0$", ""))),
        _dollars(x["amount"])))
    paid = F.concat(r["payment_method"], F.coalesce(F.concat(F.lit(" ending "), more.text("card_last_four")), F.lit("")))
    return F.concat_ws(
        "\n", r["vendor_name"], more.address("vendor"), more.text("vendor_phone"), _labelled("Date", r["receipt_date"]),
        _labelled("Time", more.text("transaction_time")), _labelled("Cashier", more.text("cashier")), items,
        _labelled("Subtotal", _dollars(r["subtotal"])), more.money(_with_note("Discount", more.text("discount_desc")), "discount", "-"),
        F.when(r["tax"] > 0, F.concat(_with_note("Tax", _rate(more["tax_rate"])), F.lit(": "), _dollars(r["tax"]))),
        more.money("Tip", "tip"), _labelled("TOTAL", _dollars(r["total_amount"])), paid, more.money("Change", "change_due"))


def render_contract(r: Column) -> Column:
    """A contract record as text."""
    terms = F.transform(r["key_terms"], lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    return F.concat_ws(
        "\n", F.lit("AGREEMENT"),
        F.concat(F.lit("This Agreement is entered into as of "), r["effective_date"], F.lit(' (the "Effective Date"), by and between:')),
        F.when(F.size(r["parties"]) > 0, F.array_join(r["parties"], "\nAND\n")), terms,
        _labelled("Term ends", r["expiration_date"]), _labelled("Contract value", _dollars(r["contract_value"])),
        r["summary"], F.lit("IN WITNESS WHEREOF, each party shall sign this Agreement."))


def render_text(df: DataFrame, doc_type: str, record: str = "record", details: str | None = None) -> DataFrame:
    """Add ``text``. ``details`` names a struct column of optional parts of invoices and receipts: address parts of ``vendor``, ``bill_to``
    and ``ship_to``, discount, shipping, tip, rates, contact and payment data (``Details``)."""
    if doc_type == "contract":
        return df.withColumn("text", render_contract(F.col(record)))
    more = Details(F.col(details), df.schema[details].dataType.names) if details else Details()
    render = {"invoice": render_invoice, "receipt": render_receipt}[doc_type]
    return df.withColumn("text", render(F.col(record), more))
