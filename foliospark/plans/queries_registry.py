"""Queries on document objects, vocabulary and samples, and on the status registry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from foliospark.operators import registry as R
from foliospark.operators import validation as V
from foliospark.plans import tables as t
from foliospark.plans.catalogue import query
from foliospark.plans.queries_records import INVOICE_RESULT
from foliospark.plans.sqlviews import with_views
from foliospark.session import shared_folder
from foliospark.sources import documents as docs
from foliospark.sources import samples as smp
from foliospark.sources import sinks
from foliospark.sources.status_store import StatusStore
from foliospark.streaming import streams
from foliospark.streaming.registration import deletions, registrations, write_registrations
from foliospark.streaming.registration import stream_registrations as stream_registrations_of

# --- objects, vocabulary, samples -------------------------------------------------------------------------


@query("key_split", with_views("keys", "SELECT path, split_part(path, '/', 2) AS document_id, split_part(path, '/', 3) AS filename FROM keys"))
def key_split(spark, sf):
    return docs.split_document_key(t.object_keys(spark, sf))


@query("accepted_uploads", with_views("keys", "SELECT split_part(path, '/', 2) AS document_id FROM keys WHERE lower(path) LIKE '%.pdf'"))
def accepted_uploads(spark, sf):
    return docs.accept_pdf(docs.split_document_key(t.object_keys(spark, sf))).select("document_id")


@query("non_pdf_rejects", with_views("keys", """
SELECT split_part(path, '/', 2) AS document_id, split_part(path, '/', 3) AS filename, 'Only PDF files are accepted' AS error
FROM keys WHERE NOT lower(path) LIKE '%.pdf'"""))
def non_pdf_rejects(spark, sf):
    return docs.reject_non_pdf(docs.split_document_key(t.object_keys(spark, sf))).select("document_id", "filename", "error")


@query("assemble_text", """
SELECT doc_id AS document_id, md5(string_agg(coalesce(line, ''), chr(10) ORDER BY page_no)) AS text_md5, sum(length(line) + 1)::BIGINT - 1 AS chars FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents) GROUP BY doc_id""")
def assemble_text(spark, sf):
    return docs.assemble_text(t.page_rows(spark, sf)).select(
        "document_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


@query("samples_json", "SELECT lang AS label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def samples_json(spark, sf):
    """Samples written as JSON lines, read back with their schema and checked."""
    path = shared_folder(spark, "samples")
    smp.save_samples(t.samples(spark, sf), path)
    return smp.load_samples(spark, path, t.LANGS, multi_line=False).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


def _vocab(spark, sf, name):
    """One JSON object per part: its type with its names."""
    part = t.table(spark, sf, "part")
    text = F.to_json(F.create_map(F.col("p_type"), F.array(F.col(name))))
    return part.select(F.from_json(text, smp.VOCABULARY).alias("vocab"))


@query("vocab_explode", "SELECT DISTINCT p_type AS category, p_name AS item FROM part WHERE p_type NOT IN ('SMALL')")
def vocab_explode(spark, sf):
    return smp.explode_vocab(_vocab(spark, sf, "p_name"), exclude=["SMALL"]).distinct()


@query("vocab_files", "SELECT DISTINCT p_type AS category, p_brand AS item FROM part WHERE p_type NOT IN ('SMALL')")
def vocab_files(spark, sf):
    """Vocabulary files, one JSON object a category with its brands, read back without the excluded one."""
    brands, path = t.table(spark, sf, "part").select("p_type", "p_brand").distinct(), shared_folder(spark, "vocabulary")
    listed = brands.groupBy("p_type").agg(F.sort_array(F.collect_list("p_brand")).alias("items"))
    listed.select(F.to_json(F.create_map("p_type", "items"))).write.option("maxRecordsPerFile", 1).text(path)
    return smp.load_vocab(spark, path, exclude=["SMALL"])


@query("vocab_merge", "SELECT p_type AS category, p_name AS item FROM part UNION SELECT p_type, p_brand FROM part")
def vocab_merge(spark, sf):
    return smp.merge_vocab(smp.explode_vocab(_vocab(spark, sf, "p_name")), smp.explode_vocab(_vocab(spark, sf, "p_brand")))


# --- status registry --------------------------------------------------------------------------------------

_STATE = "document_id, status, filename, s3_key, doc_type, classification_confidence, error_message, created_at::VARCHAR AS created_at, updated_at::VARCHAR AS updated_at"


def _state(spark, sf):
    return R.current_status(t.status_log(spark, sf))


def _printed(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("created_at", "updated_at")})


@query("status_register", with_views("keys", """
SELECT split_part(path, '/', 2) AS document_id, split_part(path, '/', 3) AS filename, path AS s3_key, 'uploaded' AS status FROM keys WHERE lower(path) LIKE '%.pdf'"""))
def status_register(spark, sf):
    uploads = docs.accept_pdf(docs.split_document_key(t.object_keys(spark, sf))).withColumnRenamed("path", "s3_key")
    return R.register(uploads).select("document_id", "filename", "s3_key", "status")


@query("status_events", """
SELECT conv_id::VARCHAR AS document_id, CASE WHEN role = 'assistant' THEN 'extracting' ELSE 'failed' END AS status,
  CASE WHEN role = 'assistant' THEN 'invoice' END AS doc_type, CASE WHEN role = 'assistant' THEN (((turn + 1) / 16.0)::DOUBLE)::VARCHAR END AS classification_confidence,
  CASE WHEN role <> 'assistant' THEN 'refused by ' || role END AS error_message, turn AS seq FROM conversations""")
def status_events(spark, sf):
    ok = F.col("role") == "assistant"
    turns = t.table(spark, sf, "conversations").withColumn("document_id", F.col("conv_id"))
    events = R.status_event(
        turns, F.when(ok, "extracting").otherwise("failed"), doc_type=F.when(ok, "invoice"),
        confidence=F.when(ok, (F.col("turn") + 1) / 16.0), error=F.when(~ok, F.concat(F.lit("refused by "), F.col("role"))), seq=F.col("turn"))
    return events.select("document_id", "status", "doc_type", "classification_confidence", "error_message", F.col("seq").cast("bigint").alias("seq"))


@query("status_current", with_views("state", f"SELECT {_STATE} FROM state"))
def status_current(spark, sf):
    return _printed(_state(spark, sf))


@query("stream_status", with_views("state", f"SELECT {_STATE} FROM state"))
def stream_status(spark, sf):
    """The same fold over a stream of the event file; what each micro-batch changed is written and read back."""
    schema = t.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    target = shared_folder(spark, "status-changes")
    streams.write_changes(streams.stream_status(t.status_columns(events)), target, shared_folder(spark, "status-checkpoint")).awaitTermination()
    return _printed(streams.latest_state(spark, target))


@query("stream_registrations", with_views("state", f"SELECT {_STATE} FROM state WHERE document_id NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)"))
def stream_registrations(spark, sf):
    """Status events in three shuffled parts and deletions between them, each part a run of one stream whose state lives on between the runs."""
    log = t.status_log(spark, sf).withColumn("deleted", F.lit(False))
    gone = deletions(t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("document_id")), F.lit("2024-01-15").cast("timestamp"))  # in the middle of the events
    arrived, target, checkpoint = (shared_folder(spark, name) for name in ("arrivals", "registrations", "registrations-checkpoint"))
    month = timedelta(days=31)  # events are shuffled over their whole span, and go on after a deletion
    for part in range(3):
        rows = log.filter(F.pmod(F.xxhash64("event_time", "seq"), F.lit(3)) == part)
        (rows.unionByName(gone) if part == 1 else rows).write.mode("append").parquet(arrived)
        changes = stream_registrations_of(spark.readStream.schema(spark.read.parquet(arrived).schema).parquet(arrived), lateness=month, retention=month)
        write_registrations(changes, target, checkpoint).awaitTermination()
    return _printed(registrations(spark, target))


@query("status_by_status_top20", with_views("state", f"SELECT {_STATE} FROM state WHERE status = 'error' ORDER BY state.created_at DESC, document_id LIMIT 20"))
def status_by_status_top20(spark, sf):
    return _printed(R.query_by_status(_state(spark, sf), "error", 20))


@query("status_page", with_views("state", f"SELECT {_STATE} FROM state ORDER BY state.created_at DESC, document_id LIMIT 20 OFFSET 40"))
def status_page(spark, sf):
    return _printed(R.list_documents(_state(spark, sf), limit=20, offset=40))


@query("status_page_after", with_views("state", f"SELECT {_STATE} FROM state ORDER BY state.created_at DESC, document_id LIMIT 20 OFFSET 5"))
def status_page_after(spark, sf):
    """The page behind a first one of five rows, by its last row's key: no row of earlier pages is sorted or held again."""
    state = _state(spark, sf)
    first = R.list_documents(state, limit=5).collect()
    after = (first[-1]["created_at"], first[-1]["document_id"]) if first else None
    return _printed(R.list_documents(state, limit=20, after=after))


@query("status_lookup", with_views("state", f"SELECT {_STATE} FROM state WHERE document_id = '42'"))
def status_lookup(spark, sf):
    return _printed(R.get_document(_state(spark, sf), "42"))


@query("status_delete", with_views("state", f"SELECT {_STATE} FROM state WHERE document_id NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)"))
def status_delete(spark, sf):
    ids = t.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("document_id"))
    return _printed(R.delete_documents(_state(spark, sf), ids))


def _store(spark, sf) -> StatusStore:
    """Events in three batches that are not in their order, the first two compacted, then deletions and a batch that is written twice."""
    events, store = t.status_log(spark, sf), StatusStore(spark, shared_folder(spark, "status-store"), 16)
    batch = F.pmod(F.xxhash64("event_time"), F.lit(3))
    for i in range(2):
        store.write(events.filter(batch == i), i)
    store.compact(1)
    store.delete(t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("document_id")), 2)
    for _ in range(2):
        store.write(events.filter(batch == 2), 3)
    return store


@query("status_store", with_views("state", f"SELECT {_STATE} FROM state WHERE document_id NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)"))
def status_store(spark, sf):
    """The state of a store in files, with a base, later batches, late events and deletions."""
    return _printed(_store(spark, sf).state())


@query("status_store_lookup", with_views("state", f"SELECT {_STATE} FROM state WHERE document_id = '42' AND document_id NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)"))
def status_store_lookup(spark, sf):
    """One document, read from one bucket, after another compaction."""
    store = _store(spark, sf)
    store.compact(3)
    return _printed(store.lookup("42"))


@query("report_file", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def report_file(spark, sf):
    """A report written as a JSON file and read back."""
    path = shared_folder(spark, "report")
    sinks.write_report(t.samples(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("label string, n bigint").json(path)


@query("status_appended", with_views("state", f"SELECT {_STATE} FROM state"))
def status_appended(spark, sf):
    """Events appended in two writes, folded on read."""
    path, events = shared_folder(spark, "status-log"), t.status_log(spark, sf)
    odd = F.pmod(F.xxhash64("event_time"), F.lit(2))
    for i in (1, 0):
        sinks.write_status(events.filter(odd == i), path)
    return _printed(R.current_status(spark.read.schema(events.schema).parquet(path)))


@query("document_detail", with_views("state", """
SELECT document_id, coalesce(filename, '') AS filename, coalesce(s3_key, '') AS s3_key, doc_type, coalesce(status, 'uploaded') AS status,
  TRY_CAST(classification_confidence AS DOUBLE) AS classification_confidence, created_at::VARCHAR AS created_at, updated_at::VARCHAR AS updated_at, error_message
FROM state"""))
def document_detail(spark, sf):
    return R.document_detail(_state(spark, sf))


# --- outcomes ---------------------------------------------------------------------------------------------

_OUTCOMES = f"""
  SELECT *, CASE WHEN error_message IS NULL THEN 'completed' ELSE 'failed' END AS outcome FROM (
    SELECT document_id, doc_type, stage, CASE WHEN doc_type IN ('other', 'unknown') AND exception IS NULL THEN NULL
      WHEN exception IS NOT NULL THEN exception WHEN errors <> '' THEN 'Validation errors: ' || errors END AS error_message
    FROM (SELECT document_id, errors, CASE WHEN document_id % 8 = 0 THEN 'unknown' WHEN document_id % 8 = 1 THEN 'other' ELSE 'invoice' END AS doc_type,
            CASE WHEN document_id % 50 = 3 THEN repeat('timeout ', 90) END AS exception,
            CASE WHEN document_id % 50 = 3 THEN CASE WHEN document_id % 100 = 3 THEN 'classifying' ELSE 'extracting' END END AS stage
          FROM ({INVOICE_RESULT}) JOIN orders ON document_id = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)))"""


def _outcomes(spark, sf):
    """Checked invoices with a type and an exception by key; documents of customers in debt are not registered."""
    k = F.col("document_id")
    late = k % 50 == 3
    results = V.validate_invoice(t.invoices(spark, sf)).select(
        "document_id", F.col("validation.errors").alias("errors"),
        F.when(k % 8 == 0, "unknown").when(k % 8 == 1, "other").otherwise("invoice").alias("doc_type"),
        F.when(late, F.repeat(F.lit("timeout "), F.lit(90))).alias("exception"),
        F.when(late & (k % 100 == 3), "classifying").when(late, "extracting").alias("stage"))
    solvent = t.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    known = t.table(spark, sf, "orders").join(solvent, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("document_id"))
    return R.final_outcome(results, known)


@query("final_outcome", f"""
SELECT document_id, doc_type, outcome, doc_type = 'invoice' AND outcome = 'completed' AS stored FROM ({_OUTCOMES})""")
def final_outcome(spark, sf):
    return _outcomes(spark, sf).select("document_id", "doc_type", "outcome", "stored")


@query("failure_messages", f"SELECT document_id, error_message FROM ({_OUTCOMES}) WHERE outcome = 'failed'")
def failure_messages(spark, sf):
    return _outcomes(spark, sf).filter("outcome = 'failed'").select("document_id", "error_message")


@query("status_trail", f"""
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS seq, status, CASE WHEN status = 'extracting' THEN doc_type END AS doc_type,
  CASE WHEN status = 'failed' THEN error_message END AS error_message FROM (
  SELECT *, 1 AS pos, 'classifying' AS status FROM ({_OUTCOMES})
  UNION ALL SELECT *, 2, 'extracting' FROM ({_OUTCOMES}) WHERE coalesce(stage, '') <> 'classifying'
  UNION ALL SELECT *, 3, 'validating' FROM ({_OUTCOMES}) WHERE stage IS NULL AND doc_type = 'invoice'
  UNION ALL SELECT *, 4, outcome FROM ({_OUTCOMES}))""")
def status_trail(spark, sf):
    return R.status_trail(_outcomes(spark, sf)).withColumn("seq", F.col("seq").cast("bigint"))
