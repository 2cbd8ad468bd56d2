"""Extraction requests, calls to a user-supplied client, and typed parsing of its JSON answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from foliospark.functions.text import spans
from foliospark.schemas import (
    ATTEMPT, EXTRACTABLE_TYPES, INVOICE, LINE_ITEM, MAX_EXTRACT_CHARS, MAX_RETRIES, MIN_EXTRACT_CHARS, PART_OVERLAP, RECORD_TYPES,
)
from foliospark.session import materialize

# The texts of a request and its settings.
SYSTEM_PROMPT = (
    "You are a document data extraction specialist. You extract structured data from raw text that was obtained by "
    "running text extraction or OCR on PDF documents.\n\n"
    "The text may contain OCR artifacts, merged words, irregular spacing, and formatting noise. Extract accurate data "
    "despite these issues.\n\n"
    "When a field cannot be determined from the text, use null.\n"
    "For dates, preserve the original format from the document.\n"
    "For monetary amounts, use numeric values without currency symbols."
)
PROMPTS = {
    "invoice": (
        "Extract all structured data from this invoice document.\n\nPay special attention to:\n"
        "- The vendor/seller name (company issuing the invoice)\n"
        "- Invoice number and dates (invoice date, due date)\n"
        "- Each line item with description, quantity, unit price, and amount\n"
        "- Subtotal, tax, and total amount\n"
        "- Currency (default to USD if not specified)\n"
        "- Payment terms (e.g. Net 30, Due on receipt)\n\nDOCUMENT TEXT:\n{text}"
    ),
    "receipt": (
        "Extract all structured data from this receipt document.\n\nPay special attention to:\n"
        "- The vendor/store name\n"
        "- Receipt/transaction date\n"
        "- Each line item with description, quantity, and amount\n"
        "- Subtotal, tax, and total amount\n"
        "- Payment method (cash, credit card type, etc.)\n\nDOCUMENT TEXT:\n{text}"
    ),
    "contract": (
        "Extract all structured data from this contract document.\n\nPay special attention to:\n"
        "- All parties involved (full legal names)\n"
        "- Effective date and expiration date\n"
        "- Contract value or total compensation\n"
        "- Key terms and conditions (summarize each as a short phrase)\n"
        "- A 2-3 sentence summary of what the contract covers\n\nDOCUMENT TEXT:\n{text}"
    ),
}
GENERIC_PROMPT = (
    "Extract whatever structured information you can find from this document.\n\nLook for:\n"
    "- Any names, organizations, or parties mentioned\n"
    "- Any dates\n"
    "- Any monetary amounts\n"
    "- A brief summary of the document's purpose\n\n"
    "Return a JSON object with keys: entities, dates, amounts, summary.\n\nDOCUMENT TEXT:\n{text}"
)
MAX_TOKENS = 4096
TEMPERATURE = 0.0
TOO_SHORT = "Document text too short for extraction"
TEXT_SLOT = "{text}"

Client = Callable[[dict], tuple[str, int, int]]


# --- requests ---------------------------------------------------------------------------------------------

def truncate_text(c: Column, limit: int = MAX_EXTRACT_CHARS) -> Column:
    return F.left(c, F.lit(limit))


def extractable_error(c: Column, limit: int | None = None, least: int = MIN_EXTRACT_CHARS) -> Column:
    """The error of a text that is too short once it is stripped, else NULL. The whole text counts unless a ``limit`` cuts it."""
    text = F.coalesce(c, F.lit(""))
    return F.when(~spans(text if limit is None else truncate_text(text, limit), least), F.lit(TOO_SHORT))


def text_parts(df: DataFrame, limit: int = MAX_EXTRACT_CHARS, overlap: int = PART_OVERLAP) -> DataFrame:
    """One row per part of ``text``: ``part`` from 0, ``parts`` how many the document has.

    A part has at most ``limit`` characters and starts with the last ``overlap`` of the one before it. A text within the limit is one part;
    a null text is one null part.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be shorter than a part")
    step = limit - overlap
    parts = F.greatest(F.ceil((F.length("text") - overlap) / step), F.lit(1)).cast("int")
    counted = df.withColumn("parts", F.coalesce(parts, F.lit(1)))
    rows = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("text", F.when(F.col("parts") == 1, F.col("text")).otherwise(
        F.substring("text", F.col("part") * step + 1, F.lit(limit))))


def route_prompt(doc_type: Column) -> Column:
    """The prompt of a type; the generic one for every other type."""
    prompt = F.when(doc_type == "invoice", PROMPTS["invoice"])
    for name in ("receipt", "contract"):
        prompt = prompt.when(doc_type == name, PROMPTS[name])
    return prompt.otherwise(GENERIC_PROMPT)


def response_schema(doc_type: str) -> str:
    """JSON schema of a record type, as text: what is optional may be null."""
    def of(f: _Field) -> dict:
        if f.kind == "items":
            return {"type": "array", "items": record(_ITEM)}
        if f.kind == "texts":
            return {"type": "array", "items": {"type": "string"}}
        kind = "number" if f.kind == "number" else "string"
        return {"type": kind if f.required or f.default is not None else [kind, "null"]}

    def record(fields: list[_Field]) -> dict:
        return {"type": "object", "properties": {f.name: of(f) for f in fields}, "required": [f.name for f in fields if f.required]}

    return json.dumps(record(_SPECS[doc_type]))


def build_requests(df: DataFrame, model: str, limit: int = MAX_EXTRACT_CHARS, overlap: int = PART_OVERLAP, cut: bool = False) -> DataFrame:
    """One request for each part of every document ``(document_id, doc_type, text)`` that is long enough.

    ``typed`` says that the answer must follow ``response_schema``, the JSON schema of the type; the generic prompt has none. With ``cut`` a
    document is one part, its first ``limit`` characters, which are also what is judged; ``dropped_chars`` is then what is not sent.
    """
    doc_type = F.col("doc_type")
    schema = F.lit(None).cast("string")
    for kind in EXTRACTABLE_TYPES:
        schema = F.when(doc_type == kind, F.lit(response_schema(kind))).otherwise(schema)
    long_enough = df.select("document_id", "doc_type", "text").filter(extractable_error(F.col("text"), limit if cut else None).isNull())
    dropped = F.greatest(F.length("text") - limit, F.lit(0)) if cut else F.lit(0)
    long_enough = long_enough.withColumn("dropped_chars", dropped.cast("bigint"))
    if cut:
        parts = long_enough.withColumns({"text": truncate_text(F.col("text"), limit), "parts": F.lit(1), "part": F.lit(0)})
    else:
        parts = text_parts(long_enough, limit, overlap)
    return parts.select(
        "document_id", "part", "parts", "doc_type", F.lit(SYSTEM_PROMPT).alias("system"),
        F.replace(route_prompt(doc_type), F.lit(TEXT_SLOT), F.col("text")).alias("user_message"),
        F.lit(model).alias("model"), F.lit(MAX_TOKENS).alias("max_tokens"),
        F.lit(TEMPERATURE).alias("temperature"), doc_type.isin(EXTRACTABLE_TYPES).alias("typed"), schema.alias("response_schema"), "dropped_chars")


def run_extractor(requests: DataFrame, factory: Callable[[], Client], attempt: int = 1,
                  concurrency: int | None = None) -> DataFrame:
    """Call a client once per request and log the answer or the error as an attempt.

    ``factory`` is called once per task that has a request and returns ``client(request) -> (json_text, input_tokens, output_tokens)``.
    ``concurrency`` is the number of tasks, and so of calls, at a time.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in batches:
            rows = []
            client = client or (factory() if len(batch) else None)
            for request in batch.to_dict("records"):
                head = (request["document_id"], request["part"], attempt)
                try:
                    response, tokens_in, tokens_out = client(request)
                    rows.append((*head, True, response, None, request["model"], tokens_in, tokens_out))
                except Exception as error:  # an attempt that failed is a row, not the end of the job
                    rows.append((*head, False, None, str(error), request["model"], 0, 0))
            yield pd.DataFrame(rows, columns=ATTEMPT.names)

    spread = requests.repartition(concurrency) if concurrency else requests
    return spread.mapInPandas(call, ATTEMPT)


# --- typed parsing ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Field:
    """What a JSON field has to be: ``default`` is taken only when the key is absent."""

    name: str
    kind: str
    required: bool = False
    default: str | float | None = None
    positive: bool = False


_ITEM = [
    _Field("description", "text", required=True), _Field("quantity", "number", default=1.0, positive=True),
    _Field("unit_price", "number", required=True), _Field("amount", "number", required=True),
    _Field("category", "text"),
]
_PURCHASE = [_Field("vendor_name", "text", required=True), _Field("line_items", "items", required=True),
             _Field("subtotal", "number"), _Field("tax", "number"), _Field("total_amount", "number", required=True)]
_SPECS = {
    "invoice": [*_PURCHASE, _Field("invoice_number", "text"), _Field("invoice_date", "text"), _Field("due_date", "text"),
                _Field("currency", "text", default="USD"), _Field("payment_terms", "text")],
    "receipt": [*_PURCHASE, _Field("receipt_date", "text"), _Field("payment_method", "text")],
    "contract": [_Field("parties", "texts", required=True), _Field("effective_date", "text"),
                 _Field("expiration_date", "text"), _Field("contract_value", "number"),
                 _Field("key_terms", "texts", default=""), _Field("summary", "text")],
}


def _variants(fields: list[_Field]) -> str:
    return f"struct<{', '.join(f'{f.name}: variant' for f in fields)}>"


_TYPES = {"text": "string", "number": "double", "texts": "array<variant>", "items": f"array<{_variants(_ITEM)}>"}


def _probe(v: Column, fields: list[_Field]) -> list[Column]:
    """Kind and value of every field of an object, a struct of variants, each read once. The kind is NULL for an absent key.

    Only a text needs its type by name. Of a list ``schema_of_variant`` would merge the types of all its elements.
    """
    out = []
    for f in fields:
        kind = F.schema_of_variant(v[f.name]) if f.kind == "text" else F.when(v[f.name].isNotNull(), F.when(F.is_variant_null(v[f.name]), "VOID").otherwise("OTHER"))
        out.append(kind.alias(f"k_{f.name}"))
        out.append(F.try_variant_get(v[f.name], "$", _TYPES[f.kind]).alias(f"v_{f.name}"))
    return out


def _problem(f: _Field, kind: Column, value: Column, partial: Column | None = None) -> Column:
    """What is wrong with a field, NULL if nothing. In a ``partial`` record anything may be absent or null."""
    null = kind == "VOID"
    wrong = (kind != "STRING") if f.kind == "text" else value.isNull()
    if f.kind == "texts":
        wrong = wrong | F.coalesce(F.exists(value, lambda x: F.schema_of_variant(x) != "STRING"), F.lit(False))
    unless = F if partial is None else F.when(partial & (null | kind.isNull()), F.lit(None))
    problem = unless.when(null, F.lit(f"{f.name}: null") if f.required or f.default is not None else F.lit(None))
    problem = problem.when(kind.isNull(), F.lit(f"{f.name}: missing") if f.required else F.lit(None))
    problem = problem.when(wrong, F.lit(f"{f.name}: wrong type"))
    return problem.when(value <= 0, F.lit(f"{f.name}: not above 0")) if f.positive else problem


def _value(f: _Field, kind: Column, value: Column, partial: Column | None = None) -> Column:
    """The field's value, or its default when the key is absent; a ``partial`` record leaves defaults to the whole one."""
    if f.kind == "texts":
        value = F.transform(value, lambda x: F.try_variant_get(x, "$", "string"))
    if f.default is None:
        return value
    absent = F.array().cast("array<string>") if f.kind == "texts" else F.lit(f.default)
    use = kind.isNull() if partial is None else kind.isNull() & ~partial
    return F.when(use, absent).otherwise(value)


def _probe_item(x: Column) -> Column:
    return F.struct(x.isNotNull().alias("object"), *_probe(x, _ITEM))


def _read_item(p: Column) -> Column:
    """A probed line item as a typed struct with its first problem."""
    found = {f.name: (f, p[f"k_{f.name}"], p[f"v_{f.name}"]) for f in _ITEM}
    not_object = F.when(~p["object"], F.lit("line_items: not an object"))
    return F.struct(
        F.struct(*[_value(*found[n]).alias(n) for n in LINE_ITEM.names]).alias("item"),
        F.coalesce(not_object, *[_problem(*x) for x in found.values()]).alias("problem"))


def parse_typed(df: DataFrame, doc_type: str, raw: str = "response", partial: Column | None = None) -> DataFrame:
    """Add ``record`` (the typed struct with defaults) and ``parse_error`` (NULL when the record is complete).

    Where ``partial`` holds the record is one part's: fields may be missing, and defaults wait for ``merge_parts``. The text goes through VARIANT once: only there can an explicit null be told from an absent key, and a string
    from a number. Kinds and values are columns first; problems and the record are built from those columns.
    """
    keep, fields = df.columns, _SPECS[doc_type]
    is_part = None if partial is None else F.col("_partial")
    # What is no object is no struct: the type of the whole answer, its lines included, need not be found for that.
    whole = F.try_variant_get(F.try_parse_json(raw), "$", _variants(fields))
    probed = df.withColumn("_v", whole).withColumn("_partial", F.lit(False) if partial is None else partial).select(
        *keep, "_partial", F.col("_v").isNotNull().alias("_object"), *_probe(F.col("_v"), fields))
    problem = F.coalesce(F.when(~F.col("_object"), F.lit("response is not a JSON object")),
                         *[_problem(f, F.col(f"k_{f.name}"), F.col(f"v_{f.name}"), is_part) for f in fields])
    values = {f.name: _value(f, F.col(f"k_{f.name}"), F.col(f"v_{f.name}"), is_part) for f in fields}
    if "line_items" in values:
        items = F.transform(F.transform("v_line_items", _probe_item), _read_item)
        probed = probed.withColumn("_items", items)
        bad = F.filter(F.transform("_items", lambda x: x["problem"]), lambda p: p.isNotNull())
        problem = F.coalesce(problem, F.get(bad, F.lit(0)))
        values["line_items"] = F.transform("_items", lambda x: x["item"])
    record = F.struct(*[values[n].alias(n) for n in RECORD_TYPES[doc_type].names])
    return (probed.withColumn("parse_error", problem)
            .withColumn("record", F.when(F.col("parse_error").isNull(), record))
            .select(*keep, "record", "parse_error"))


def apply_defaults(record: Column) -> Column:
    """Defaults of an invoice struct whose quantities or currency were never set."""
    items = F.transform(record["line_items"], lambda x: x.withField("quantity", F.coalesce(x["quantity"], F.lit(1.0))))
    return (record.withField("line_items", items)
            .withField("currency", F.coalesce(record["currency"], F.lit("USD"))).cast(INVOICE))


def parse_generic(df: DataFrame, raw: str = "response") -> DataFrame:
    """Any JSON text as VARIANT, with an error for text that is not JSON."""
    return (df.withColumn("generic", F.try_parse_json(raw))
            .withColumn("parse_error", F.when(F.col("generic").isNull(), F.lit("response is not JSON"))))


# --- parts of a document ----------------------------------------------------------------------------------

def _joined_items(parts: Column) -> Column:
    """Lists one after the other; what the next one repeats of the end of those before it, the overlap's lines, comes once."""
    def append(done: Column, more: Column) -> Column:
        most = F.least(F.size(done), F.size(more))
        lengths = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        same = F.filter(lengths, lambda k: F.slice(done, F.size(done) - k + 1, k) == F.slice(more, F.lit(1), k))
        repeated = F.coalesce(F.array_max(same), F.lit(0))
        return F.concat(done, F.slice(more, repeated + 1, F.size(more)))

    return F.aggregate(parts, F.array().cast(ArrayType(LINE_ITEM)), append)


def merge_parts(parts: DataFrame, doc_type: str) -> DataFrame:
    """``(document_id, record, parse_error)`` from the records ``(document_id, part, record)`` of all parts of each document.

    Of a single value the first part that has one decides; lists are joined, line items without the repeats of the overlap, texts each
    once. Defaults and required fields are then those of a whole record. One document's parts meet in one row, as its text did.
    """
    gathered = parts.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("part", "record"))).alias("p"))
    values, problems = {}, []
    for f in _SPECS[doc_type]:
        given = F.filter(F.col(f"p.record.{f.name}"), lambda v: v.isNotNull())
        if f.kind == "items":
            value = F.when(F.size(given) > 0, _joined_items(given))
        elif f.kind == "texts":
            value = F.when(F.size(given) > 0, F.array_distinct(F.flatten(given)))
        else:
            value = F.get(given, F.lit(0))
        if f.default is not None:
            value = F.coalesce(value, F.array().cast("array<string>") if f.kind == "texts" else F.lit(f.default))
        if f.required:
            problems.append(F.when(value.isNull(), F.lit(f"{f.name}: missing")))
        values[f.name] = value
    record = F.struct(*[values[n].alias(n) for n in RECORD_TYPES[doc_type].names])
    checked = gathered.select("document_id", F.coalesce(*problems).alias("parse_error"), record.alias("record"))
    return checked.withColumn("record", F.when(F.col("parse_error").isNull(), F.col("record")))


def merged_records(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """One row per document whose parts all succeeded: ``(document_id, record_type, invoice, receipt, contract, parse_error)``.

    ``attempts`` are checked ones, with ``parts``. Documents of one part pass as they are.
    """
    first_ok = resolve_attempts(attempts, max_retries).select("document_id", "part", "attempt")
    rows = attempts.filter("ok").join(first_ok, ["document_id", "part", "attempt"])
    whole = rows.filter("parts = 1").select("document_id", F.col("doc_type").alias("record_type"), *EXTRACTABLE_TYPES, F.lit(None).cast("string").alias("parse_error"))
    several = rows.filter("parts > 1")
    complete = several.groupBy("document_id", "parts").agg(F.count(F.lit(1)).alias("n")).filter("n = parts").select("document_id")
    several = several.join(complete, "document_id", "left_semi")
    out = whole
    for doc_type in EXTRACTABLE_TYPES:
        merged = merge_parts(several.filter(F.col("doc_type") == doc_type).select("document_id", "part", F.col(doc_type).alias("record")), doc_type)
        of = {t: (F.col("record") if t == doc_type else F.lit(None)).cast(RECORD_TYPES[t]).alias(t) for t in EXTRACTABLE_TYPES}
        out = out.unionByName(merged.select("document_id", F.lit(doc_type).alias("record_type"), *of.values(), "parse_error"))
    return out


# --- attempts ---------------------------------------------------------------------------------------------

def _request_keys(df: DataFrame) -> list[str]:
    return ["document_id", "part"] if "part" in df.columns else ["document_id"]


def resolve_attempts(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The first success among the first 1 + ``max_retries`` attempts of every document, or part of one, that has one."""
    ok_attempt = F.when(F.col("ok"), F.col("attempt"))
    return (attempts.filter(F.col("attempt") <= 1 + max_retries)
            .groupBy(*_request_keys(attempts)).agg(F.min(ok_attempt).alias("attempt"), F.min_by("response", ok_attempt).alias("response"))
            .filter(F.col("attempt").isNotNull()))


def extraction_failures(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Documents without a success, or with a part without one: the last error, of the first such part."""
    last = F.coalesce(F.max_by("error", "attempt"), F.lit("None"))
    keys = _request_keys(attempts)
    failed = (attempts.filter(F.col("attempt") <= 1 + max_retries)
              .groupBy(*keys).agg(F.bool_or("ok").alias("ok"), last.alias("last"))
              .filter(~F.col("ok")))
    if len(keys) > 1:
        failed = failed.groupBy("document_id").agg(F.min_by("last", "part").alias("last"))
    return failed.select("document_id", F.concat(F.lit(f"Extraction failed after {1 + max_retries} attempts: "), F.col("last")).alias("error"))


def token_usage(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))


def check_attempts(attempts: DataFrame, requests: DataFrame) -> DataFrame:
    """Attempts with their parsed record: an answer that does not fit its type is a failed attempt.

    One struct column per type is filled, the others are NULL. The answer to one of several parts may leave fields out.
    """
    typed = attempts.join(requests.select("document_id", "part", "parts", "doc_type"), ["document_id", "part"])
    for doc_type in EXTRACTABLE_TYPES:
        answer = F.when(F.col("doc_type") == doc_type, F.col("response"))
        typed = (parse_typed(typed.withColumn("_answer", answer), doc_type, "_answer", F.col("parts") > 1).drop("_answer")
                 .withColumnRenamed("record", doc_type).withColumnRenamed("parse_error", f"_e_{doc_type}"))
    problem = F.when(F.col("doc_type") == "invoice", F.col("_e_invoice"))
    for doc_type in ("receipt", "contract"):
        problem = problem.when(F.col("doc_type") == doc_type, F.col(f"_e_{doc_type}"))
    problem = problem.otherwise(F.when(F.try_parse_json("response").isNull(), F.lit("response is not JSON")))
    return (typed.withColumn("error", F.when(F.col("ok"), problem).otherwise(F.col("error")))
            .withColumn("ok", F.col("error").isNull())
            .drop(*[f"_e_{t}" for t in EXTRACTABLE_TYPES]))


@dataclass(frozen=True)
class Ledger:
    """Where a batch writes its calls, by (document, part, attempt), before anything uses them.

    A replay of the batch finds there what is paid for. Every task's calls are kept once the task ends, also when the job or the driver
    goes down later, so only calls of unfinished tasks are made again.
    """

    path: str
    batch_id: int

    def _folder(self, attempt: int) -> str:
        return f"{self.path}/batch={self.batch_id}/attempt_no={attempt}"

    def calls(self, requests: DataFrame, attempt: int) -> DataFrame:
        """What is written of an attempt, for these requests; a call that two tasks made counts once."""
        spark = requests.sparkSession
        written = spark.read.schema(ATTEMPT).option("ignoreMissingFiles", "true")
        try:
            rows = written.parquet(self._folder(attempt))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], ATTEMPT)
        return rows.join(requests.select("document_id", "part"), ["document_id", "part"], "left_semi").dropDuplicates(["document_id", "part"])

    def run(self, requests: DataFrame, factory: Callable[[], Client], attempt: int, concurrency: int | None) -> DataFrame:
        """The attempt of every request; those that are not written yet are called and written."""
        keys = requests.select("document_id", "part")
        paid = self.calls(requests, attempt).select("document_id", "part")
        missing = requests
        if not paid.isEmpty():  # only keys are compared: in a replay no message moves
            missing = requests.join(materialize(keys.join(paid, ["document_id", "part"], "left_anti"), "unpaid-requests"), ["document_id", "part"], "left_semi")
        # Each task's file appears when the task ends, not when the job does.
        (run_extractor(missing, factory, attempt, concurrency).write.mode("append")
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self._folder(attempt)))
        return materialize(self.calls(requests, attempt), "attempts")


def extract(requests: DataFrame, factory: Callable[[], Client], max_retries: int = MAX_RETRIES,
            concurrency: int | None = None, ledger: Ledger | None = None) -> DataFrame:
    """All attempts for a request table, retrying whatever failed, as a written table.

    Every round of calls is written before it is used: a task that is repeated later, or one of the four sinks,
    reads the answers and does not pay for them again. With a ``ledger`` neither does a replay of the whole batch.
    """
    rounds = []
    types = materialize(requests.select("document_id", "part", "parts", "doc_type"), "request-types")  # no text is joined to the answers
    pending = requests
    for attempt in range(1, 2 + max_retries):
        done = (ledger.run(pending, factory, attempt, concurrency) if ledger
                else materialize(run_extractor(pending, factory, attempt, concurrency), "attempts"))
        checked = materialize(check_attempts(done, types), "checked-attempts")
        rounds.append(checked)
        if attempt <= max_retries:
            failed = materialize(checked.filter("not ok").select("document_id", "part"), "failed-requests")
            pending = requests.join(failed, ["document_id", "part"], "left_semi")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out
