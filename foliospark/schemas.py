"""Record types, table types and fixed limits."""

from __future__ import annotations

from pyspark.sql import types as T

# Document types, statuses, gates and tolerances of the data model.
DOCUMENT_CLASSES = ["contract", "invoice", "other", "receipt"]
EXTRACTABLE_TYPES = ["invoice", "receipt", "contract"]
SKIPPED_TYPES = ["other", "unknown"]
STATUSES = ["uploaded", "classifying", "extracting", "validating", "completed", "failed"]
CONFIDENCE_THRESHOLD = 0.75
MIN_WORDS = 10
MIN_EXTRACT_CHARS = 50
MAX_EXTRACT_CHARS = 180_000
PART_OVERLAP = 2_000  # characters that a part of a long text shares with the one before it
MAX_RETRIES = 1
LINE_ITEM_TOLERANCE = 0.05
TOTAL_TOLERANCE = 0.50
ERROR_TEXT_LIMIT = 500


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in pairs])


S, D = T.StringType(), T.DoubleType()
MONEY, QUANTITY = T.DecimalType(12, 2), T.DecimalType(10, 3)

LINE_ITEM = _fields(("description", S), ("quantity", D), ("unit_price", D), ("amount", D), ("category", S))
INVOICE = _fields(
    ("vendor_name", S), ("invoice_number", S), ("invoice_date", S), ("due_date", S),
    ("line_items", T.ArrayType(LINE_ITEM)), ("subtotal", D), ("tax", D), ("total_amount", D),
    ("currency", S), ("payment_terms", S),
)
RECEIPT = _fields(
    ("vendor_name", S), ("receipt_date", S), ("line_items", T.ArrayType(LINE_ITEM)),
    ("subtotal", D), ("tax", D), ("total_amount", D), ("payment_method", S),
)
CONTRACT = _fields(
    ("parties", T.ArrayType(S)), ("effective_date", S), ("expiration_date", S),
    ("contract_value", D), ("key_terms", T.ArrayType(S)), ("summary", S),
)
RECORD_TYPES = {"invoice": INVOICE, "receipt": RECEIPT, "contract": CONTRACT}

SAMPLE = _fields(("id", S), ("label", S), ("text", S))
VALIDATION = _fields(("is_valid", T.BooleanType()), ("errors", T.ArrayType(S)), ("warnings", T.ArrayType(S)))
STATUS_EVENT = _fields(
    ("document_id", S), ("filename", S), ("s3_key", S), ("status", S), ("doc_type", S),
    ("classification_confidence", S), ("error_message", S), ("event_time", T.TimestampType()), ("seq", T.IntegerType()),
)
ATTEMPT = _fields(
    ("document_id", S), ("part", T.IntegerType()), ("attempt", T.IntegerType()), ("ok", T.BooleanType()), ("response", S), ("error", S),
    ("model", S), ("input_tokens", T.LongType()), ("output_tokens", T.LongType()),
)

# Column widths and decimal columns of the stored tables.
LENGTH_LIMITS = {
    "invoice": {"vendor_name": 255, "invoice_number": 100, "invoice_date": 50, "due_date": 50,
                "currency": 10, "payment_terms": 100},
    "receipt": {"vendor_name": 255, "receipt_date": 50, "payment_method": 50},
    "contract": {"effective_date": 50, "expiration_date": 50},
    "line_items": {"extraction_type": 50, "description": 500, "category": 100},
}
DECIMAL_COLUMNS = {
    "invoice": {"subtotal": MONEY, "tax": MONEY, "total_amount": MONEY},
    "receipt": {"subtotal": MONEY, "tax": MONEY, "total_amount": MONEY},
    "contract": {"contract_value": MONEY},
    "line_items": {"quantity": QUANTITY, "unit_price": MONEY, "amount": MONEY},
}
REQUIRED_COLUMNS = {
    "invoice": ["document_id", "vendor_name", "total_amount"],
    "receipt": ["document_id", "vendor_name", "total_amount"],
    "contract": ["document_id", "parties"],
    "line_items": ["extraction_id", "extraction_type", "description", "quantity", "unit_price", "amount"],
}
