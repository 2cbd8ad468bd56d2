"""Queries on document texts: cleaning, gates, corpus quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import quality as Q
from foliospark.operators import scoring
from foliospark.operators import similarity
from foliospark.plans import tables as t
from foliospark.plans.catalogue import query
from foliospark.plans.sqlviews import clean, token_set, with_views, words


@query("normalize_text", f"SELECT doc_id AS id, md5({clean('text')}) AS text_md5, length({clean('text')}) AS chars FROM documents")
def normalize_text(spark, sf):
    d = t.samples(spark, sf).select("id", T.normalize_text(F.col("text")).alias("text"))
    return d.select("id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


@query("short_gate", f"SELECT doc_id AS id, 'unknown' AS doc_type, 0.0::DOUBLE AS confidence FROM documents WHERE {words('text')} < 10")
def short_gate(spark, sf):
    return scoring.short_text_gate(t.samples(spark, sf))


@query("exact_dups", """
SELECT sum(n)::BIGINT AS total, count(*) AS distinct_texts, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS texts_with_copies FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def exact_dups(spark, sf):
    return Q.exact_duplicates(t.samples(spark, sf))


@query("near_duplicate_rate", f"""
WITH ranked AS (SELECT id, label, text, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) - 1 AS pos,
    least(count(*) OVER (PARTITION BY label), 400) AS m FROM (SELECT doc_id AS id, lang AS label, text FROM documents)),
  sets AS (SELECT label, pos, {token_set('text')} AS s FROM ranked WHERE pos < 400),
  drawn AS (SELECT label, pair, (2 * pair) % m AS a, ((2 * pair) % m + 1 + (2 * pair // m) % (m - 1)) % m AS b
    FROM (SELECT DISTINCT label, m FROM ranked WHERE m > 1) CROSS JOIN (SELECT unnest(range(200)) AS pair)),
  scored AS (SELECT d.label, CASE WHEN len(x.s) > 0 AND len(y.s) > 0 THEN len(list_intersect(x.s, y.s))::DOUBLE
      / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) END AS j
    FROM drawn d JOIN sets x ON x.label = d.label AND x.pos = a JOIN sets y ON y.label = d.label AND y.pos = b)
SELECT label, count(j) AS pairs_checked, count(*) FILTER (j > 0.85) AS near_duplicates, count(*) FILTER (j > 0.85) * 100.0::DOUBLE / greatest(count(j), 1) AS percent
FROM scored GROUP BY label""")
def near_duplicate_rate(spark, sf):
    return Q.near_duplicate_rate(t.samples(spark, sf))


@query("near_copies", with_views("samples", f"""
SELECT label, sum(copies)::BIGINT AS texts, sum(CASE WHEN copies > 1 THEN copies ELSE 0 END)::BIGINT AS with_copy,
  sum(CASE WHEN copies > 1 OR linked.rep IS NOT NULL THEN copies ELSE 0 END)::BIGINT AS near_copies,
  sum(CASE WHEN copies > 1 OR linked.rep IS NOT NULL THEN copies ELSE 0 END) * 100.0::DOUBLE / sum(copies) AS percent
FROM sets LEFT JOIN (SELECT a AS rep FROM pairs UNION SELECT b FROM pairs) linked USING (rep) GROUP BY label""", f"""
sets AS MATERIALIZED (SELECT label, min(id) AS rep, s, len(s) AS size, count(*) AS copies FROM (SELECT id, label, list_sort({token_set('text')}) AS s FROM samples) WHERE len(s) > 0 GROUP BY label, s),
places AS MATERIALIZED (SELECT label, rep, size, unnest(s) AS token FROM sets),
pairs AS (SELECT x.rep AS a, y.rep AS b FROM places x JOIN places y ON x.label = y.label AND x.token = y.token AND x.rep < y.rep AND 100 * least(x.size, y.size) > 85 * greatest(x.size, y.size)
  GROUP BY x.rep, y.rep, x.size, y.size HAVING 100 * count(*) > 85 * (x.size + y.size - count(*)))"""))
def near_copies(spark, sf):
    return similarity.near_copies(t.samples(spark, sf))


_TOKENS = f"SELECT id, label, unnest({token_set('text')}) AS token FROM samples"


@query("token_sets", with_views("samples", f"SELECT id, len({token_set('text')}) AS n_tokens, md5(array_to_string(list_sort({token_set('text')}), ' ')) AS tokens_md5 FROM samples"))
def token_sets(spark, sf):
    sets = t.samples(spark, sf).select("id", T.token_set(F.col("text")).alias("s"))
    return sets.select("id", F.size("s").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.array_sort("s"), " ")).alias("tokens_md5"))


@query("vocab_size", with_views("samples", f"SELECT label, count(DISTINCT token) AS vocabulary FROM ({_TOKENS}) GROUP BY label"))
def vocab_size(spark, sf):
    return Q.vocabulary_size(t.samples(spark, sf))


@query("vocab_growth", with_views("samples", f"""
SELECT label, count(DISTINCT token) FILTER (r <= 100) AS small_vocabulary, count(DISTINCT token) AS large_vocabulary,
  count(DISTINCT token)::DOUBLE / greatest(count(DISTINCT token) FILTER (r <= 100), 1) AS growth
FROM (SELECT label, r, unnest({token_set('text')}) AS token FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM samples) WHERE r <= 500) GROUP BY label"""))
def vocab_growth(spark, sf):
    return Q.vocabulary_growth(t.samples(spark, sf))


@query("vocab_curve", with_views("samples", f"""
SELECT label, size, sum(coalesce(fresh, 0)) OVER (PARTITION BY label ORDER BY size)::BIGINT AS vocabulary
FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS size FROM samples)
LEFT JOIN (SELECT label, id, count(*) AS fresh FROM (SELECT label, token, min(id) AS id FROM ({_TOKENS}) GROUP BY label, token) GROUP BY label, id) USING (label, id)"""))
def vocab_curve(spark, sf):
    return Q.vocabulary_curve(t.samples(spark, sf))


@query("class_overlap", with_views("samples", f"""
SELECT a.label AS class_a, b.label AS class_b, count(*) FILTER (a.token = b.token) AS common, any_value(na + nb) - count(*) FILTER (a.token = b.token) AS combined,
  count(*) FILTER (a.token = b.token)::DOUBLE / greatest(any_value(na + nb) - count(*) FILTER (a.token = b.token), 1) AS jaccard
FROM (SELECT *, count(*) OVER (PARTITION BY label) AS na FROM (SELECT DISTINCT label, token FROM ({_TOKENS}))) a
JOIN (SELECT *, count(*) OVER (PARTITION BY label) AS nb FROM (SELECT DISTINCT label, token FROM ({_TOKENS}))) b ON a.token = b.token AND a.label < b.label
GROUP BY a.label, b.label"""))
def class_overlap(spark, sf):
    return Q.class_overlap(t.samples(spark, sf), t.LANGS)


@query("length_dispersion", with_views("samples", f"""
SELECT label, count(*) AS n, sum(w)::DOUBLE / count(*) AS mean_words,
  round(sqrt(greatest(sum(w * w)::DOUBLE / count(*) - (sum(w)::DOUBLE / count(*)) * (sum(w)::DOUBLE / count(*)), 0)) / greatest(sum(w)::DOUBLE / count(*), 1), 9) AS dispersion
FROM (SELECT label, {words('text')} AS w FROM samples) GROUP BY label"""))
def length_dispersion(spark, sf):
    return Q.length_dispersion(t.samples(spark, sf)).withColumn("dispersion", F.round("dispersion", 9))


@query("short_docs", with_views("samples", f"SELECT label, count(*) FILTER ({words('text')} < 10) AS short, count(*) AS n FROM samples GROUP BY label"))
def short_docs(spark, sf):
    return Q.short_documents(t.samples(spark, sf))


@query("garbled", """
SELECT count(*) FILTER (contains(html, chr(65533)) OR contains(html, '(cid:') OR contains(html, chr(195) || chr(162) || chr(194) || chr(128))) AS garbled, count(*) AS n
FROM (SELECT html FROM pages UNION ALL SELECT text FROM documents)""")
def garbled(spark, sf):
    texts = t.table(spark, sf, "pages").select(F.col("html").alias("text")).unionByName(t.table(spark, sf, "documents").select("text"))
    return Q.garbled_text(texts)


@query("non_printable", with_views("samples", r"""
SELECT label, count(*) FILTER (length(text) - length(regexp_replace(text, '[^\x20-\x7E\t\n\r\x0B\x0C]', '', 'g')) > length(text) * 0.05::DOUBLE) AS flagged, count(*) AS n
FROM samples GROUP BY label"""))
def non_printable(spark, sf):
    return Q.non_printable(t.samples(spark, sf))


@query("term_hits", with_views("contracts", """
SELECT document_id AS id, (lower(t) LIKE '%agreement%')::BIGINT + (lower(t) LIKE '%party%')::BIGINT + (lower(t) LIKE '%shall%')::BIGINT + (lower(t) LIKE '%effective date%')::BIGINT AS hits
FROM (SELECT document_id, concat_ws(' ', summary, array_to_string(key_terms, ' ')) AS t FROM contracts)"""))
def term_hits(spark, sf):
    texts = t.contracts(spark, sf).select(
        F.col("document_id").alias("id"), F.concat_ws(" ", "record.summary", "record.key_terms").alias("text"))
    return Q.term_hits(texts)
