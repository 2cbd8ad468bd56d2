"""The views of ``tables.py`` in DuckDB's SQL, for the side-by-side check."""

from __future__ import annotations

from foliospark.functions.text import DIGIT, SPACE, WORD

# The seven date layouts.
DATE_FORMATS = ["%m/%d/%Y", "%B %d, %Y", "%d-%b-%Y", "%Y-%m-%d", "%m/%d/%y", "%b %d, %Y", "%d %B %Y"]


def cents(x: str) -> str:
    """Round to two places by exact binary value, ties to even (see ``functions.numbers``)."""
    p = f"(({x}) * 100.0::DOUBLE)"
    s = f"(({x}) * 134217729.0::DOUBLE)"
    hi = f"({s} - ({s} - ({x})))"
    error = f"(({hi} * 100.0::DOUBLE - {p}) + (({x}) - {hi}) * 100.0::DOUBLE)"
    return (f"(CASE WHEN {p} - floor({p}) <> 0.5::DOUBLE THEN floor({p} + 0.5::DOUBLE) WHEN {error} > 0 THEN ceil({p}) "
            f"WHEN {error} < 0 THEN floor({p}) ELSE floor({p}) + abs(floor({p}) % 2) END / 100.0::DOUBLE)")


def date(c: str) -> str:
    """The date a text stands for, or NULL."""
    t = f"regexp_replace({c}, '[{SPACE}]+', ' ', 'g')"
    full = "january|february|march|april|may|june|july|august|september|october|november|december"
    short = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    # The same layouts as patterns.
    shapes = [
        (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"), (rf"(?i)({full}) \d{{1,2}}, \d{{4}}", "%B %d, %Y"),
        (rf"(?i)\d{{1,2}}-({short})-\d{{4}}", "%d-%b-%Y"), (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"),
        (r"\d{1,2}/\d{1,2}/\d{2}", "%m/%d/%y"), (rf"(?i)({short}) \d{{1,2}}, \d{{4}}", "%b %d, %Y"),
        (rf"(?i)\d{{1,2}} ({full}) \d{{4}}", "%d %B %Y"),
    ]
    cases = " ".join(f"WHEN regexp_full_match({t}, '{s}') THEN try_strptime({t}, '{f}')::DATE" for s, f in shapes)
    return f"(CASE {cases} END)"


def text_of_date(day: str, key: str) -> str:
    cases = " ".join(f"WHEN ({key}) % 9 = {i} THEN strftime({day}, '{f}')" for i, f in enumerate(DATE_FORMATS))
    return f"(CASE WHEN ({key}) % 9 = 7 THEN '??' {cases} END)"


def clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"


def words(c: str) -> str:
    return f"(CASE WHEN {clean(c)} = '' THEN 0 ELSE len(string_split({clean(c)}, ' ')) END)::BIGINT"


def token_set(c: str) -> str:
    return (f"list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[{SPACE}]+', ' ', 'g'), ' '), "
            f"lambda w: length(w) > 2 AND NOT regexp_full_match(replace(replace(w, '.', ''), ',', ''), '[{DIGIT}]+')))")


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[{WORD}]{{2,}}')"


_LINES = """
  SELECT l_orderkey AS document_id, {number} AS item_no, 'Part ' || l_partkey AS description,
         q::DOUBLE AS quantity, ((2 * cents + q) // (2 * q)) / 100.0::DOUBLE AS unit_price,
         cents / 100.0::DOUBLE AS amount, l_returnflag AS category, cents
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "lines": ([], _LINES.format(number="""row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
         l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""")),
    "plain_lines": ([], _LINES.format(number="l_linenumber")),
    "headers": ([], f"""
  SELECT o_orderkey AS document_id, CASE WHEN o_custkey % 17 = 0 THEN ' ' ELSE c_name END AS vendor_name,
         'INV-' || lpad(o_orderkey::VARCHAR, 10, '0') AS invoice_number,
         {text_of_date('day', 'o_orderkey')} AS invoice_date,
         {text_of_date('due', 'o_orderkey + 1')} AS due_date,
         sub / 100.0::DOUBLE AS subtotal, tax_cents / 100.0::DOUBLE AS tax,
         (CASE WHEN o_orderkey % 13 = 0 THEN -listed WHEN o_orderkey % 7 = 0 OR sub IS NULL THEN listed
               ELSE sub + tax_cents END) / 100.0::DOUBLE AS total_amount,
         'USD' AS currency,
         ['14 days', 'end of month', 'prepaid', '90 days', 'on delivery', 'by instalments'][o_orderkey % 6 + 1] AS payment_terms,
         o_orderpriority AS payment_method, o_orderstatus, o_custkey, line_count, day
  FROM (SELECT *, (8 * sub + 50) // 100 AS tax_cents FROM (
    SELECT o.*, c.c_name, s.line_count, s.line_cents + CASE WHEN o_orderkey % 11 = 0 THEN 500 ELSE 0 END AS sub,
           CAST(round(o_totalprice * 100) AS BIGINT) AS listed, o_orderdate::DATE AS day,
           o_orderdate::DATE + CAST((o_orderkey % 5 - 1) * 10 AS INTEGER) AS due
    FROM orders o
    LEFT JOIN (SELECT l_orderkey, count(*) AS line_count, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS line_cents
               FROM lineitem GROUP BY l_orderkey) s ON o.o_orderkey = s.l_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey))"""),
    "contracts": ([], f"""
  SELECT c_custkey AS document_id, CASE WHEN c_custkey % 19 = 0 THEN [] ELSE [c_name, n_name] END AS parties,
         {text_of_date('start_day', 'c_custkey')} AS effective_date,
         {text_of_date('end_day', 'c_custkey + 4')} AS expiration_date,
         CASE WHEN c_custkey % 11 = 0 THEN -c_acctbal WHEN c_custkey % 23 = 0 THEN NULL ELSE c_acctbal END AS contract_value,
         ['Segment ' || c_mktsegment, 'Each party shall give notice'] AS key_terms,
         CASE WHEN c_custkey % 3 = 0 THEN 'Agreement with ' || c_name END AS summary
  FROM (SELECT *, DATE '2024-01-01' + CAST(c_custkey % 700 AS INTEGER) AS start_day,
               DATE '2024-01-01' + CAST(c_custkey % 700 + (c_custkey % 5 - 1) * 100 AS INTEGER) AS end_day
        FROM customer JOIN nation ON c_nationkey = n_nationkey)"""),
    "log": ([], """
  SELECT user_id::VARCHAR AS document_id,
         CASE WHEN event_type = 'signup' THEN 'f' || event_id || '.pdf' END AS filename,
         CASE WHEN event_type = 'signup' THEN 'documents/' || user_id END AS s3_key,
         event_type AS status, CASE WHEN event_id % 2 = 0 THEN props->>'$.k' END AS doc_type,
         CASE WHEN event_type = 'purchase' THEN (floor(value * 100) / 10000.0::DOUBLE)::VARCHAR END AS classification_confidence,
         CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error_message, ts AS event_time, event_id AS seq
  FROM events"""),
    "state": (["log"], """
  SELECT document_id, arg_max(status, (event_time, seq)) AS status,
         arg_max(filename, (event_time, seq)) FILTER (filename IS NOT NULL) AS filename,
         arg_max(s3_key, (event_time, seq)) FILTER (s3_key IS NOT NULL) AS s3_key,
         arg_max(doc_type, (event_time, seq)) FILTER (doc_type IS NOT NULL) AS doc_type,
         arg_max(classification_confidence, (event_time, seq)) FILTER (classification_confidence IS NOT NULL) AS classification_confidence,
         arg_max(error_message, (event_time, seq)) FILTER (error_message IS NOT NULL) AS error_message,
         min(event_time) AS created_at, max(event_time) AS updated_at
  FROM log GROUP BY document_id"""),
    "samples": ([], "SELECT doc_id AS id, lang AS label, text FROM documents"),
    "preds": ([], """
  SELECT id, y_true, ['de', 'en', 'es', 'fr'][list_position(s, list_max(s))] AS y_pred,
         list_transform(s, lambda x: x::DOUBLE / list_sum(s)::DOUBLE) AS proba
  FROM (SELECT doc_id AS id, lang AS y_true, [
    (doc_id * 7 + 0) % 101 + 1 + CASE WHEN doc_id % 10 < 7 AND lang = 'de' THEN 400 ELSE 0 END,
    (doc_id * 9 + 3) % 101 + 1 + CASE WHEN doc_id % 10 < 7 AND lang = 'en' THEN 400 ELSE 0 END,
    (doc_id * 11 + 6) % 101 + 1 + CASE WHEN doc_id % 10 < 7 AND lang = 'es' THEN 400 ELSE 0 END,
    (doc_id * 13 + 9) % 101 + 1 + CASE WHEN doc_id % 10 < 7 AND lang = 'fr' THEN 400 ELSE 0 END] AS s FROM documents)"""),
    "onehot": (["preds"], """
  SELECT id, c AS class, (y_true = c)::INT AS y, proba[list_position(['de', 'en', 'es', 'fr'], c)] AS p
  FROM preds CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS c)"""),
    "scores": (["onehot"], """
  SELECT class, p AS score, sum(y) AS pos, count(*) - sum(y) AS neg FROM onehot GROUP BY class, p"""),
    "curve": (["scores"], """
  SELECT class, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY class) AS pos_all, sum(neg) OVER (PARTITION BY class) AS neg_all
  FROM scores WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""),
    "report": (["preds"], """
  SELECT c AS class, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1, support::BIGINT AS support
  FROM (SELECT c, count(*) FILTER (y_true = c AND y_pred = c)::DOUBLE AS tp, count(*) FILTER (y_true = c)::DOUBLE AS support,
               count(*) FILTER (y_pred = c)::DOUBLE AS predicted
        FROM preds CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS c) GROUP BY c)"""),
    "keys": ([], """
  SELECT doc_id, 'documents/' || doc_id || '/' || source || CASE WHEN doc_id % 10 = 0 AND doc_id % 3 = 0 THEN '.TXT'
         WHEN doc_id % 10 = 0 THEN '.txt' WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.pdf' END AS path FROM documents"""),
    "attempts": ([], """
  SELECT conv_id AS document_id, (turn + 1)::INT AS attempt, role = 'assistant' AS ok,
         CASE WHEN role = 'assistant' THEN text END AS response,
         CASE WHEN role <> 'assistant' THEN 'refused by ' || role END AS error, 'model-' || role AS model,
         length(text) AS input_tokens, length(text) % 97 AS output_tokens FROM conversations"""),
    "responses": (["lines", "headers"], """
  SELECT document_id, CASE WHEN k = 5 THEN left(t, length(t) - 5) ELSE t END AS response FROM (
    SELECT document_id, k, '{' ||
      CASE k WHEN 2 THEN '"vendor_name": null' WHEN 6 THEN '"vendor_name": 5' ELSE '"vendor_name": "' || vendor_name || '"' END ||
      ', "line_items": [' || coalesce(items, '') || ']' ||
      CASE k WHEN 1 THEN '' WHEN 4 THEN ', "total_amount": "' || total_amount::DECIMAL(14,2) || '"'
             ELSE ', "total_amount": ' || total_amount::DECIMAL(14,2) END ||
      CASE k WHEN 8 THEN ', "currency": null' WHEN 9 THEN '' ELSE ', "currency": "EUR"' END || '}' AS t
    FROM (SELECT *, document_id % 10 AS k FROM headers) LEFT JOIN (
      SELECT document_id, string_agg('{"description": "' || description || '", ' ||
        CASE document_id % 10 WHEN 7 THEN '' WHEN 3 THEN '"quantity": 0, ' ELSE '"quantity": ' || quantity::BIGINT || ', ' END ||
        '"unit_price": ' || unit_price::DECIMAL(14,2) || ', "amount": ' || amount::DECIMAL(14,2) || '}', ', ' ORDER BY item_no) AS items
      FROM lines GROUP BY document_id) USING (document_id))"""),
    "rendered": (["lines", "headers"], """
  SELECT document_id AS id, concat_ws(chr(10), vendor_name, 'INVOICE', 'Invoice #: ' || invoice_number, 'Date: ' || invoice_date,
         'Due Date: ' || due_date, 'Description Qty Unit Price Amount', items,
         'Subtotal: $' || format('{:,.2f}', subtotal), 'Tax: $' || format('{:,.2f}', tax),
         'Total Due: $' || format('{:,.2f}', total_amount), 'Payment Terms: ' || payment_terms) AS text
  FROM headers LEFT JOIN (
    SELECT document_id, string_agg(concat_ws(' ', description, quantity::VARCHAR, '$' || format('{:,.2f}', unit_price),
           '$' || format('{:,.2f}', amount)), chr(10) ORDER BY item_no) AS items FROM lines GROUP BY document_id) USING (document_id)"""),
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """``body`` behind the named views and those they read; ``extra`` adds its own ``name AS (...)`` parts."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in order]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
