"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import ann, byte_bpe, html_text, language, lexical, licenses, line_dedup, near_dup, packing, pii, spelling, token_counts, vafile
from foliospark.llm.common import table
from foliospark.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


LINE_SQL = r"""
WITH blank AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
keyed AS (SELECT doc_id, line, i,
                 translate(trim(line, b), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines, blank),
repeated AS (SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT doc_id, k FROM keyed WHERE length(k) >= 40)
             GROUP BY k HAVING count(*) >= 5),
marked AS (SELECT doc_id, line, i, coalesce(doc_id <> last, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", LINE_SQL)
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINK_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sets AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM shingled) GROUP BY s HAVING len(s) > 0),
items AS (SELECT rep, n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep
          AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep AS node, rep AS root FROM sets UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM shingled d LEFT JOIN sets ON sets.s = list_sort(d.s) LEFT JOIN roots r ON r.node = sets.rep
"""


@query("op3_near_duplicates", LINK_SQL)
def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"), words=2)


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents")).drop("matches")


SCORE_SQL = """
WITH vectors AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                 FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
           FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op5_exact_top_k", SCORE_SQL)
def op5_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").filter(vafile.usable(F.col("embedding")))
    whole = vectors.select("vec_id", vafile.scaled(F.col("embedding"), 64).alias("vec"))
    return vafile.top_k(whole, F.col("vec_id") % 20 == 0)


@query("op6_pii")
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    base = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    terms = F.transform("terms", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return found.select(
        F.col("id").alias("doc_id"), *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])],
        F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.sort_array(F.concat(base, terms))).alias("spans"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-level sequences of 8,192; copies of a text are a cluster."""
    docs = table(spark, sf, "documents")
    return packing.pack(docs, F.octet_length("text"), 8192, cluster=packing.copies(F.col("text")))


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_nearest")
def op10_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, vec_col="embedding")


# The given pages keep their article in one element of that name, without boilerplate inside.
ARTICLE_SQL = r"""
WITH found AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[a-z/][^>]*>', ' ', 'g') AS body FROM found),
decoded AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(body, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS body FROM bare),
spaced AS (SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM spaced
"""


@query("op11_html_text", ARTICLE_SQL)
def op11_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


RANKED_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r
                 FROM documents WHERE doc_id IS NOT NULL),
words AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM lowered),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
counts AS (SELECT r, doc_id, w, count(*) AS tf FROM words GROUP BY r, doc_id, w),
weighed AS (SELECT w, floor(1000 * ln((2 * (SELECT docs FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM counts GROUP BY w),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
scored AS (SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
           FROM asked JOIN counts USING (w) JOIN weighed USING (w) JOIN lengths USING (r), whole GROUP BY item_id, doc_id, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_ranked_search", RANKED_SQL)
def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.top_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))
