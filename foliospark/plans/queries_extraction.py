"""Queries on extraction requests, answers and attempts."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from foliospark.operators import extraction as X
from foliospark.plans import tables as t
from foliospark.plans.catalogue import query
from foliospark.plans.sqlviews import with_views
from foliospark.functions.text import SPACE
from foliospark.schemas import MAX_EXTRACT_CHARS, PART_OVERLAP

MODEL = "extractor-1"


def _typed_documents(spark, sf):
    """Documents with a type by key."""
    kinds = F.array(*[F.lit(c) for c in ("invoice", "receipt", "contract", "other")])
    return t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("doc_type"), "text")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STRIPPED = f"regexp_replace(left(text, 5000), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_WHOLE = f"regexp_replace(coalesce(text, ''), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_USER = "CASE doc_id % 4 " + " ".join(
    f"WHEN {i} THEN replace({_sql_text(p)}, '{{text}}', t)"
    for i, p in enumerate([X.PROMPTS["invoice"], X.PROMPTS["receipt"], X.PROMPTS["contract"], X.GENERIC_PROMPT])) + " END"


def _parts_sql(limit: int = MAX_EXTRACT_CHARS, overlap: int = PART_OVERLAP) -> str:
    """``(doc_id, part, parts, t)`` of the documents that are long enough."""
    return f"""
SELECT doc_id, part::INT AS part, parts, substr(text, part * {limit - overlap} + 1, {limit}) AS t FROM (
  SELECT *, unnest(range(parts)) AS part FROM (
    SELECT doc_id, text, greatest(ceil((length(text) - {overlap})::DOUBLE / {limit - overlap}), 1)::BIGINT AS parts FROM documents WHERE length({_WHOLE}) >= 50))"""


_SCHEMA = "CASE doc_id % 4 " + " ".join(
    f"WHEN {i} THEN md5({_sql_text(X.response_schema(kind))})" for i, kind in enumerate(("invoice", "receipt", "contract"))) + " END"


@query("prompt_requests", f"""
SELECT doc_id AS document_id, part, md5({_USER}) AS message_md5, md5({_sql_text(X.SYSTEM_PROMPT)}) AS system_md5, 'extractor-1' AS model, 4096 AS max_tokens,
  0.0::DOUBLE AS temperature, doc_id % 4 < 3 AS typed,
  {_SCHEMA} AS schema_md5, 0::BIGINT AS dropped_chars FROM ({_parts_sql()})""")
def prompt_requests(spark, sf):
    r = X.build_requests(_typed_documents(spark, sf), MODEL)
    return r.select("document_id", "part", F.md5("user_message").alias("message_md5"), F.md5("system").alias("system_md5"), "model", "max_tokens", "temperature", "typed",
                    F.md5("response_schema").alias("schema_md5"), "dropped_chars")


#: Parts so short that half of the texts need several.
PART, SHARED = 1_000, 100


def word_client():
    """Factory of a stand-in client that names the long words of its part, and refuses some lengths."""
    def factory():
        def client(request: dict) -> tuple[str, int, int]:
            text = request["user_message"].split("DOCUMENT TEXT:\n", 1)[1]
            if len(text) % 7 == 0:
                raise RuntimeError(f"busy at {len(text)}")
            return json.dumps({"parties": list(dict.fromkeys(re.findall("[a-z]{9,}", text))), "summary": str(len(text))}), len(text), 1
        return client
    return factory


@query("long_text_parts", f"""
SELECT doc_id AS document_id, any_value(parts) AS parts, CASE WHEN bool_and(ok) THEN arg_min(n, part)::VARCHAR END AS summary,
  CASE WHEN bool_and(ok) THEN coalesce(len(list_distinct(flatten(list(words)))), 0) END AS n_words,
  CASE WHEN bool_and(ok) THEN md5(array_to_string(list_sort(list_distinct(flatten(list(words)))), ' ')) END AS words_md5,
  CASE WHEN NOT bool_and(ok) THEN 'Extraction failed after 2 attempts: busy at ' || arg_min(n, part) FILTER (NOT ok) END AS error
FROM (SELECT *, length(t) AS n, length(t) % 7 <> 0 AS ok, regexp_extract_all(t, '[a-z]{{9,}}') AS words FROM ({_parts_sql(PART, SHARED)})) GROUP BY doc_id""")
def long_text_parts(spark, sf):
    """Texts read in parts of a thousand characters: one record a document, or the error of its first part that failed."""
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("contract").alias("doc_type"), "text")
    requests = X.build_requests(docs, MODEL, PART, SHARED)
    attempts = X.extract(requests, word_client())
    records = X.merged_records(attempts).select("document_id", "contract")
    told = records.join(X.extraction_failures(attempts), "document_id", "full").join(requests.filter("part = 0").select("document_id", "parts"), "document_id")
    words = F.array_sort(F.col("contract.parties"))
    return told.select(F.col("document_id").cast("bigint").alias("document_id"), F.col("parts").cast("bigint").alias("parts"), "contract.summary",
                       F.when(words.isNotNull(), F.size(words)).cast("bigint").alias("n_words"), F.md5(F.array_join(words, " ")).alias("words_md5"), "error")


@query("truncate_gate", f"""
SELECT doc_id AS document_id, least(length(text), 5000) AS chars, CASE WHEN length({_STRIPPED}) < 50 THEN 'Document text too short for extraction' END AS error FROM documents""")
def truncate_gate(spark, sf):
    """The gates with a shorter limit, which some of the texts exceed."""
    return _typed_documents(spark, sf).select(
        "document_id", F.length(X.truncate_text(F.col("text"), 5000)).cast("bigint").alias("chars"), X.extractable_error(F.col("text"), 5000).alias("error"))


_PARSED = """
  SELECT document_id, response, TRY_CAST(response AS JSON) AS j, json_type(TRY_CAST(response AS JSON), '$.vendor_name') AS vt,
    json_type(TRY_CAST(response AS JSON), '$.currency') AS ct, TRY_CAST(TRY_CAST(response AS JSON)->>'$.total_amount' AS DOUBLE) AS total,
    CAST(TRY_CAST(response AS JSON)->'$.line_items' AS JSON[]) AS items FROM responses"""


@query("parse_typed", with_views("responses", f"""
SELECT document_id, CASE WHEN j IS NULL THEN 'response is not a JSON object' WHEN vt = 'NULL' THEN 'vendor_name: null' WHEN vt <> 'VARCHAR' THEN 'vendor_name: wrong type'
    WHEN total IS NULL THEN 'total_amount: missing' WHEN ct = 'NULL' THEN 'currency: null' WHEN bad > 0 THEN 'quantity: not above 0' END AS parse_error,
  CASE WHEN ok THEN j->>'$.vendor_name' END AS vendor_name, CASE WHEN ok THEN coalesce(j->>'$.currency', 'USD') END AS currency, CASE WHEN ok THEN total END AS total_amount,
  CASE WHEN ok THEN len(items) END AS n_items, CASE WHEN ok THEN coalesce(list_sum(list_transform(items, lambda x: coalesce(CAST(x->>'$.quantity' AS DOUBLE), 1))), 0) END AS quantity
FROM (SELECT *, j IS NOT NULL AND vt = 'VARCHAR' AND total IS NOT NULL AND coalesce(ct, '') <> 'NULL' AND coalesce(bad, 0) = 0 AS ok
  FROM (SELECT *, len(list_filter(items, lambda x: CAST(x->>'$.quantity' AS DOUBLE) <= 0)) AS bad FROM ({_PARSED})))"""))
def parse_typed(spark, sf):
    parsed = X.parse_typed(t.raw_responses(spark, sf), "invoice")
    r = F.col("record")
    quantity = F.aggregate(r["line_items"], F.lit(0.0), lambda a, x: a + x["quantity"])
    return parsed.select("document_id", "parse_error", r["vendor_name"].alias("vendor_name"), r["currency"].alias("currency"), r["total_amount"].alias("total_amount"),
                         F.when(r.isNotNull(), F.size(r["line_items"])).cast("bigint").alias("n_items"), quantity.alias("quantity"))


@query("parse_generic", with_views("responses", """
SELECT document_id, CASE WHEN TRY_CAST(response AS JSON) IS NULL THEN 'response is not JSON' END AS parse_error, TRY_CAST(response AS JSON)->>'$.currency' AS currency FROM responses"""))
def parse_generic(spark, sf):
    parsed = X.parse_generic(t.raw_responses(spark, sf))
    return parsed.select("document_id", "parse_error", F.try_variant_get("generic", "$.currency", "string").alias("currency"))


@query("apply_defaults", with_views("headers", """
SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  coalesce(q, 0.0) AS quantity FROM headers LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_quantity < 10 THEN 1.0 ELSE l_quantity END)::DOUBLE AS q
    FROM lineitem GROUP BY l_orderkey) ON document_id = l_orderkey"""))
def apply_defaults(spark, sf):
    """Small quantities and every third currency taken away, then filled by default."""
    items = F.transform(F.coalesce("record.line_items", F.array()), lambda x: x.withField("quantity", F.when(x["quantity"] >= 10, x["quantity"])))
    cut = t.invoices(spark, sf).withColumn("record", F.col("record").withField("line_items", items).withField(
        "currency", F.when(F.col("document_id") % 3 != 0, "EUR")))
    done = cut.select("document_id", X.apply_defaults(F.col("record")).alias("r"))
    return done.select("document_id", "r.currency", F.aggregate("r.line_items", F.lit(0.0), lambda a, x: a + x["quantity"]).alias("quantity"))


@query("attempts_resolved", with_views("attempts", """
SELECT document_id, min(attempt) AS attempt, md5(arg_min(response, attempt)) AS response_md5 FROM attempts WHERE ok AND attempt <= 2 GROUP BY document_id"""))
def attempts_resolved(spark, sf):
    return X.resolve_attempts(t.attempts(spark, sf)).select("document_id", "attempt", F.md5("response").alias("response_md5"))


@query("attempts_failed", with_views("attempts", """
SELECT document_id, 'Extraction failed after 2 attempts: ' || arg_max(error, attempt) AS error FROM attempts WHERE attempt <= 2 GROUP BY document_id HAVING NOT bool_or(ok)"""))
def attempts_failed(spark, sf):
    return X.extraction_failures(t.attempts(spark, sf))


@query("token_usage", with_views("attempts", """
SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM attempts GROUP BY model"""))
def token_usage(spark, sf):
    return X.token_usage(t.attempts(spark, sf))


def echo_client():
    """Factory of a stand-in client: answers with the length of the message, fails when that is a multiple of five.

    The factory is a local function, so tasks get it by value and need not import this module.
    """
    def factory():
        def client(request: dict) -> tuple[str, int, int]:
            size = len(request["user_message"])
            if size % 5 == 0:
                raise RuntimeError(f"busy at {size}")
            return f'{{"summary": "{size} characters"}}', size, 1
        return client
    return factory


@query("run_stub_extractor", f"""
SELECT document_id, part, 1 AS attempt, n % 5 <> 0 AS ok, CASE WHEN n % 5 <> 0 THEN '{{"summary": "' || n || ' characters"}}' END AS response,
  CASE WHEN n % 5 = 0 THEN 'busy at ' || n END AS error, CASE WHEN n % 5 <> 0 THEN n ELSE 0 END AS input_tokens FROM (
  SELECT doc_id AS document_id, part, length({_USER}) AS n FROM ({_parts_sql()}))""")
def run_stub_extractor(spark, sf):
    """One call per request through an injected client; refusals are rows."""
    requests = X.build_requests(_typed_documents(spark, sf), MODEL)
    return X.run_extractor(requests.withColumn("document_id", F.col("document_id").cast("string")), echo_client()).select(
        F.col("document_id").cast("bigint").alias("document_id"), "part", "attempt", "ok", "response", "error", "input_tokens")
