"""Fan-out of checked records to the four stored tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from foliospark.schemas import DECIMAL_COLUMNS, LENGTH_LIMITS, MONEY, QUANTITY, RECORD_TYPES, REQUIRED_COLUMNS


def to_money(c: Column) -> Column:
    """numeric(12,2); NULL when it does not fit, which ``unstorable`` finds before a record gets here."""
    return c.try_cast(MONEY)


def to_quantity(c: Column) -> Column:
    """numeric(10,3); NULL when it does not fit."""
    return c.try_cast(QUANTITY)


def extraction_id(doc_type: str | Column) -> Column:
    """A uuid-shaped id fixed by document and type, so that a rerun writes the same id."""
    h = F.md5(F.concat_ws("|", F.col("document_id"), F.lit(doc_type)))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def store_gate(df: DataFrame) -> DataFrame:
    """Only valid records are stored; warnings do not matter."""
    return df.filter(F.col("validation.is_valid"))


def _rows(df: DataFrame, doc_type: str, columns: list[str], record: str) -> DataFrame:
    money = DECIMAL_COLUMNS[doc_type]
    fields = [(to_money(F.col(f"{record}.{c}")) if c in money else F.col(f"{record}.{c}")).alias(c) for c in columns]
    raw = F.col("raw_json") if "raw_json" in df.columns else F.lit(None).cast("string")
    return df.select(extraction_id(doc_type).alias("id"), "document_id", *fields,
                     raw.alias("raw_json"), F.current_timestamp().alias("created_at"))


def invoice_rows(df: DataFrame, record: str = "record") -> DataFrame:
    return _rows(df, "invoice", ["vendor_name", "invoice_number", "invoice_date", "due_date", "subtotal", "tax",
                                 "total_amount", "currency", "payment_terms"], record)


def receipt_rows(df: DataFrame, record: str = "record") -> DataFrame:
    return _rows(df, "receipt", ["vendor_name", "receipt_date", "subtotal", "tax", "total_amount",
                                 "payment_method"], record)


def contract_rows(df: DataFrame, record: str = "record") -> DataFrame:
    return _rows(df, "contract", ["parties", "effective_date", "expiration_date", "contract_value", "key_terms",
                                  "summary"], record)


def line_item_rows(df: DataFrame, doc_type: str, record: str = "record") -> DataFrame:
    """One row per line item, tagged with its extraction and that extraction's type."""
    return _item_rows(df, F.lit(doc_type), F.col(f"{record}.line_items"))


def _item_rows(df: DataFrame, kind: Column, items: Column) -> DataFrame:
    return (df.select(extraction_id(kind).alias("extraction_id"), kind.alias("extraction_type"), F.posexplode(items).alias("pos", "x"))
            .select("extraction_id", "extraction_type", (F.col("pos") + 1).alias("item_no"),
                    "x.description", to_quantity(F.col("x.quantity")).alias("quantity"),
                    to_money(F.col("x.unit_price")).alias("unit_price"), to_money(F.col("x.amount")).alias("amount"),
                    "x.category"))


def keep_raw(df: DataFrame, record: str = "record") -> DataFrame:
    """Keep the record's JSON text beside the typed columns."""
    return df.withColumn("raw_json", F.to_json(record))


def _out_of_range(number: Column, kind: DecimalType) -> Column:
    """Whether a double does not fit a stored number. Only those near its limit, and NaN, which is above all numbers, are cast."""
    near = F.abs(number) >= 0.99 * 10.0 ** (kind.precision - kind.scale)
    return near & number.try_cast(kind).isNull()


def _problems(table: str, value: Callable[[str], Column], known: Callable[[str], bool], label: str = "") -> list[Column]:
    """One message or NULL for each width, number range and missing value of a stored table."""
    text = [F.when(F.length(value(c)) > n, F.lit(f"{label}{c} longer than {n}")) for c, n in LENGTH_LIMITS[table].items() if known(c)]
    size = [F.when(_out_of_range(value(c), kind), F.lit(f"{label}{c} out of range"))
            for c, kind in DECIMAL_COLUMNS[table].items()]
    gone = [F.when(value(c).isNull(), F.lit(f"{label}{c} missing")) for c in REQUIRED_COLUMNS[table] if known(c)]
    return [*text, *size, *gone]


def _line_unfit(x: Column) -> Column:
    long = [F.length(x[c]) > n for c, n in LENGTH_LIMITS["line_items"].items() if c != "extraction_type"]
    numbers = DECIMAL_COLUMNS["line_items"]
    unfit = [F.coalesce(_out_of_range(x[c], kind), F.lit(True)) for c, kind in numbers.items()]
    return reduce(or_, [*unfit, x["description"].isNull(), *[F.coalesce(c, F.lit(False)) for c in long]])


def unstorable(doc_type: str, record: str) -> Column:
    """Why a record cannot be stored as a whole, its lines included; NULL when it can."""
    fields = RECORD_TYPES[doc_type].names
    header = _problems(doc_type, lambda c: F.col(f"{record}.{c}"), lambda c: c in fields)
    parts = [F.concat_ws("; ", *header)]
    if "line_items" in fields:
        names = RECORD_TYPES["invoice"]["line_items"].dataType.elementType.names
        items = F.col(f"{record}.line_items")

        def of(x: Column) -> list[Column]:
            return _problems("line_items", lambda c: x[c], lambda c: c in names, "line item ")

        found = F.flatten(F.transform(items, lambda x: F.filter(F.array(*of(x)), lambda m: m.isNotNull())))
        parts.append(F.when(F.exists(items, _line_unfit), F.array_join(F.array_distinct(found), "; ")))  # texts only where one is needed
    text = F.array_join(F.filter(F.array(*parts), lambda m: m != ""), "; ")  # drops NULL parts too
    return F.when(text != "", F.concat(F.lit("Cannot be stored: "), text))


def with_reject_reason(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to checked records of mixed type: NULL for what fits, and for types that are stored nowhere."""
    kind, reason = F.col("record_type"), F.lit(None).cast("string")
    for doc_type in ("invoice", "receipt", "contract"):
        reason = F.when((kind == doc_type) & F.col("validation.is_valid"), unstorable(doc_type, doc_type)).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def route_store(df: DataFrame) -> dict[str, DataFrame]:
    """Valid records of mixed type to the four tables, and ``rejected(document_id, record_type, reject_reason)``.

    A record that violates a width, a number range or a required column is stored in no part. Generic and unknown records are
    stored nowhere. Lines of both purchase types leave in one pass.
    """
    df = df if "reject_reason" in df.columns else with_reject_reason(df)
    valid = store_gate(df).filter(F.col("reject_reason").isNull())
    of = {t: valid.filter(F.col("record_type") == t) for t in ("invoice", "receipt", "contract")}
    kind = F.col("record_type")
    items = F.when(kind == "invoice", F.col("invoice.line_items")).otherwise(F.col("receipt.line_items"))
    return {
        "invoice_extractions": invoice_rows(of["invoice"], "invoice"),
        "receipt_extractions": receipt_rows(of["receipt"], "receipt"),
        "contract_extractions": contract_rows(of["contract"], "contract"),
        "line_items": _item_rows(valid.filter(kind.isin("invoice", "receipt")), kind, items),
        "rejected": df.filter(F.col("reject_reason").isNotNull()).select("document_id", "record_type", "reject_reason"),
    }


def reject_reason(table: str, source: dict[str, Column] | None = None) -> Column:
    """Why a row cannot be stored, NULL when it can: over-long text, a number that does not fit, a missing value.

    ``source`` gives the numbers before their cast; a number that was set but is NULL after the cast did not fit.
    """
    too_long = [F.when(F.length(c) > n, F.lit(f"{c} longer than {n}")) for c, n in LENGTH_LIMITS[table].items()]
    too_big = [F.when(source[c].isNotNull() & F.col(c).isNull(), F.lit(f"{c} out of range"))
               for c in DECIMAL_COLUMNS[table] if source and c in source]
    missing = [F.when(F.col(c).isNull() & (source[c].isNull() if source and c in source else F.lit(True)),
                      F.lit(f"{c} missing"))
               for c in REQUIRED_COLUMNS[table]]
    reason = F.concat_ws("; ", *too_long, *too_big, *missing)
    return F.when(reason != "", reason)


def length_limits(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the stored table, and those that do not, with the reason."""
    checked = df.withColumn("reject_reason", reject_reason(table))
    return (checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            checked.filter(F.col("reject_reason").isNotNull()))


def items_for(extractions: DataFrame, line_items: DataFrame, doc_type: str) -> DataFrame:
    """Items of the extractions of one type, by (id, type)."""
    keys = extractions.select(F.col("id").alias("extraction_id"), "document_id")
    return line_items.filter(F.col("extraction_type") == doc_type).join(keys, "extraction_id")


def orphans(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Stored rows whose document the registry no longer knows."""
    return child.join(parent.select("document_id"), "document_id", "left_anti")

