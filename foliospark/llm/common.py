"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one step inside a task holds as arrays at once; a single longer text is held alone.
CHUNK_CHARS = 500_000
#: Texts of one step, so that short ones do not make a step wide.
CHUNK_TEXTS = 1_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS, most: int = CHUNK_TEXTS) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``limit`` characters and at most ``most`` texts; a null text becomes the empty one."""
    part: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if part and (size + len(text) > limit or len(part) == most):
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
