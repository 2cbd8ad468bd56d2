"""Document objects, keys and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The object layout, the accepted suffix and the message for everything else.
KEY_PATTERN = r"documents/([^/]+)/([^/]+)$"
PDF_GLOB = "*.[pP][dD][fF]"
PDF_SUFFIX = ".pdf"
REJECTED = "Only PDF files are accepted"
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
PAGES_PER_CHUNK = 64


def scan_documents(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """PDF objects below ``path``; their bytes are read only when ``content`` is asked for."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", PDF_GLOB)
             .option("recursiveFileLookup", "true").load(path))
    return files if content else files.drop("content")


def split_document_key(df: DataFrame, key: str = "path") -> DataFrame:
    return (df.withColumn("document_id", F.regexp_extract(key, KEY_PATTERN, 1))
            .withColumn("filename", F.regexp_extract(key, KEY_PATTERN, 2)))


def _is_pdf():
    return F.coalesce(F.lower("filename").endswith(PDF_SUFFIX), F.lit(False))


def accept_pdf(df: DataFrame) -> DataFrame:
    return df.filter(_is_pdf())


def reject_non_pdf(df: DataFrame) -> DataFrame:
    """Uploads that are turned away, with the message."""
    return df.filter(~_is_pdf()).withColumn("error", F.lit(REJECTED))


def assemble_text(pages: DataFrame) -> DataFrame:
    """``(document_id, page_no, text)`` to one text per document: pages in order, joined by a newline.

    Pages are first joined in runs of neighbours, then the runs of a document, so that the list of pages of one
    long document is never in one task, only its text.
    """
    runs = (pages.withColumn("run", F.floor(F.col("page_no") / PAGES_PER_CHUNK))
            .groupBy("document_id", "run")
            .agg(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))).alias("p"))
            .select("document_id", "run", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("t")))
    return (runs.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("run", "t"))).alias("p"))
            .select("document_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text")))
