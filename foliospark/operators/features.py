"""TF-IDF features: terms counted inside the row; sums over a corpus and matches with a vocabulary by slices of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.functions.rows import explode_rows
from foliospark.functions.text import bigrams, normalize_text, tokenize
from foliospark.operators import terms as K
from foliospark.session import ship

# Limits of the term table.
MIN_DF = 2
MAX_DF = 0.5
MAX_FEATURES = 5000


def _run_starts(terms: Column) -> Column:
    """Positions in a sorted array where a new value starts."""
    marks = F.transform(terms, lambda t, i: F.when((i == 0) | (t != F.get(terms, i - 1)), i))
    return F.filter(marks, lambda i: i.isNotNull())


def _runs(terms: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda p, j: F.struct(
        F.get(terms, p).alias("term"), F.lit(n).alias("n"),
        (F.coalesce(F.get(starts, j + 1), F.size(terms)) - p).alias("tf")))


def with_term_counts(df: DataFrame, max_n: int = 2, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``terms array<struct<term, n, tf>>``: unigrams, and bigrams when ``max_n`` is 2.

    A document's terms all come from its own row, so they are counted there: sort the array, find where each run
    of equal terms starts, and take the distance to the next start. No shuffle of single tokens is needed. The
    steps are separate columns so that no lambda evaluates the sort again for every element.
    """
    keep = [c for c in df.columns if c != text]
    counted = []
    step = df.select(*keep, tokenize(F.col(text)).alias("_t1"))
    if max_n == 2:
        step = step.withColumn("_t2", bigrams(F.col("_t1")))
    for n in range(1, max_n + 1):
        step = step.withColumn(f"_t{n}", F.sort_array(f"_t{n}"))
        step = step.withColumn(f"_s{n}", _run_starts(F.col(f"_t{n}")))
        counted.append(_runs(F.col(f"_t{n}"), F.col(f"_s{n}"), n))
    return step.select(*keep, F.concat(*counted).alias("terms"))


def term_rows(counted: DataFrame) -> DataFrame:
    """One row per (document, term)."""
    keep = [c for c in counted.columns if c != "terms"]
    return explode_rows(counted, F.col("terms"), "x", *keep).select(*keep, "x.term", "x.n", "x.tf")


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by its ``tokens``, in text order."""
    return df.select(*[c for c in df.columns if c != text], tokenize(F.col(text)).alias("tokens"))


def term_sums(cut: DataFrame, max_n: int = 2, by: str | None = None) -> DataFrame:
    """What ``term_rows`` gives, added up over slices of ``cut`` with its ``tokens``, or its ``text``: ``(term, n, docs, tf)``, and ``by``, a column of small
    whole numbers from 0, whose values are kept apart.

    A slice has a row for each of its distinct terms, however many of its documents have it.
    """
    ship(cut.sparkSession)
    columns = ["term", "n", "docs", "tf", *([by] if by else [])]
    source, cut_slices = K.cut_of(cut)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, tokens in cut_slices(batches, 0):
            group = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for n, terms, owner, place, tf in K.counted(row, tokens, max_n):
                width = max(len(terms), 1)
                if by:
                    key, at = np.unique(group[owner] * width + place, return_inverse=True)
                else:  # every term of the slice, in the order of their numbers
                    key, at = np.arange(len(terms)), place
                out = [terms.take(pa.array(key % width)), pa.array(np.full(len(key), n, np.int32)), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)),
                       pa.array(np.bincount(at, tf, len(key)).astype(np.int64)), pa.array((key // width).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out[:len(columns)], columns)

    group = F.col(by).cast("int") if by else F.lit(0)
    return cut.select(source.alias("_cut"), group.alias("_group")).mapInArrow(summed, "term string, n int, docs bigint, tf bigint" + (f", {by} int" if by else ""))


def pair_sums(cut: DataFrame, words: list[str], by: str) -> DataFrame:
    """The pairs of ``term_sums`` whose words are both in ``words``, by number: ``(pair, docs, tf)``, left x words + right, and ``by``. No text of a pair is made."""
    spark = cut.sparkSession
    ship(spark)
    source, cut_slices = K.cut_of(cut)
    shared = spark.sparkContext.broadcast(words)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for part, row, tokens in cut_slices(batches, 0):
            group, pair, docs, tf = K.pair_sums(row, tokens, known, part.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (pair, docs, tf)] + [pa.array(group.astype(np.int32))], ["pair", "docs", "tf", by])

    return cut.select(source.alias("_cut"), F.col(by).cast("int").alias("_group")).mapInArrow(summed, f"pair bigint, docs bigint, tf bigint, {by} int")


def ngrams(df: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    return term_rows(with_term_counts(df, high)).filter(F.col("n") >= low)


def document_frequency(rows: DataFrame, n_docs: int | Column, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Terms in at least ``min_df`` documents and at most a ``max_df`` share of them: ``(term, n, df, total)``.

    Rows are distinct per (document, term), so a count is the number of documents, or sums of such rows over ``docs`` documents; frequent
    terms are combined before the shuffle.
    """
    docs = F.sum("docs") if "docs" in rows.columns else F.count(F.lit(1))
    counts = rows.groupBy("term", "n").agg(docs.alias("df"), F.sum("tf").alias("total"))
    limit = (F.lit(n_docs) if isinstance(n_docs, int) else n_docs) * max_df
    return counts.filter((F.col("df") >= min_df) & (F.col("df") <= limit))


def top_terms(frequencies: DataFrame, n: int = MAX_FEATURES) -> DataFrame:
    """The ``n`` terms with the highest total count, ties by term."""
    return frequencies.orderBy(F.col("total").desc(), "term").limit(n)


def sublinear_tf(tf: Column) -> Column:
    return 1 + F.ln(tf)


def smooth_idf(df: Column, n_docs: int | Column) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.ln((n + 1) / (df + 1)) + 1


def vocabulary(frequencies: DataFrame, n_docs: int, max_features: int = MAX_FEATURES) -> DataFrame:
    """``(term, idx, idf)``: terms numbered alphabetically from 0. At most ``max_features`` rows by construction."""
    chosen = top_terms(frequencies, max_features)
    listed = chosen.agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("t"))
    return (listed.select(F.posexplode("t").alias("idx", "x"))
            .select("x.term", "idx", smooth_idf(F.col("x.df"), n_docs).alias("idf")))


def known_terms(cut: DataFrame, vocab: DataFrame, max_n: int = 2) -> DataFrame:
    """``tokens``, or ``text``, replaced by ``known array<struct<term, idx, w>>``, a document's terms in ``vocab(term, idx, idf)`` with their weights, by ``idx``.

    The vocabulary goes to the tasks as a broadcast: ``max_features`` bounds it, and so what a document has of it. A term is once in it.
    """
    source, cut_slices = K.cut_of(cut)
    keep = [c for c in cut.columns if c != ("tokens" if "tokens" in cut.columns else "text")]
    listed = sorted((r["idx"], r["term"], r["idf"]) for r in vocab.select("term", "idx", "idf").collect())
    spark = cut.sparkSession
    ship(spark)
    terms = [term for _, term, _ in listed]
    shared = spark.sparkContext.broadcast((K.Vocabulary(terms), terms, np.array([i for i, _, _ in listed], np.int64), np.array([w for _, _, w in listed], float)))
    schema = StructType(cut.select(*keep).schema.fields + StructType.fromDDL("known array<struct<term:string,idx:int,w:double>>").fields)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms, idx, idf = shared.value
        names = pa.array(terms, pa.string())
        for part, row, tokens in cut_slices(batches, len(keep)):
            owner, place, tf = known.found(row, tokens, max_n)
            entries = pa.StructArray.from_arrays(
                [names.take(pa.array(place)), pa.array(idx[place].astype(np.int32)), pa.array((1 + np.log(tf)) * idf[place])], ["term", "idx", "w"])
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), K.listed(owner, entries, part.num_rows)], schema.names)

    return cut.select(*keep, source.alias("_cut")).mapInArrow(matched, schema)


def _squares(known: Column) -> Column:
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x["w"] * x["w"])


def weight_arrays(cut: DataFrame, vocab: DataFrame, max_n: int = 2) -> DataFrame:
    """``features array<struct<idx, w>>`` of unit length per document, empty for a document without known terms."""
    keep = [c for c in cut.columns if c != "tokens"]
    rows = known_terms(cut, vocab, max_n).withColumn("known", F.transform("known", lambda x: F.struct(x["idx"].alias("idx"), x["w"].alias("w"))))
    listed = rows.groupBy(*keep).agg(F.sort_array(F.flatten(F.collect_list("known"))).alias("f"))
    listed = listed.withColumn("norm", F.sqrt(_squares(F.col("f"))))
    return listed.select(*keep, F.transform("f", lambda x: F.struct(
        x["idx"].alias("idx"), (x["w"] / F.col("norm")).alias("w"))).alias("features"))


def tfidf_weights(counted: DataFrame, vocab: DataFrame) -> DataFrame:
    """Long form: one row per document and known term, of documents with ``tokens`` or with counted ``terms``.

    Unknown terms go before anything is shuffled. With ``tokens`` a document's known terms move as one row until its length is known.
    """
    if "tokens" in counted.columns:
        keep = [c for c in counted.columns if c != "tokens"]
        rows = known_terms(counted, vocab).filter(F.size("known") > 0).withColumn("squares", _squares(F.col("known")))
        rows = rows.withColumn("length", F.sqrt(F.sum("squares").over(Window.partitionBy("id"))))
        return rows.select(*keep, "length", F.explode("known").alias("x")).select(
            *keep, "x.idx", (F.col("x.w") / F.col("length")).alias("weight"), "x.term")
    keep = [c for c in counted.columns if c != "terms"]
    rows = explode_rows(counted, F.col("terms"), "x", *keep).select(*keep, "x.term", "x.n", "x.tf")
    known = rows.join(F.broadcast(vocab.select("term", "idx", "idf")), "term")
    weighed = known.select(*keep, "idx", (sublinear_tf(F.col("tf")) * F.col("idf")).alias("w"), "term")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return weighed.select(*keep, "idx", (F.col("w") / length).alias("weight"), "term")


def known_tokens(df: DataFrame, vocab: DataFrame, max_n: int = 2) -> DataFrame:
    """How many known terms each document has; 0 means it cannot be classified."""
    texts = df.select("id", normalize_text(F.col("text")).alias("text"))
    known = known_terms(texts, vocab.select("term", F.lit(0).alias("idx"), F.lit(1.0).alias("idf")), max_n)
    return known.select("id", F.size("known").alias("n")).groupBy("id").agg(F.sum("n").alias("known_terms"))
