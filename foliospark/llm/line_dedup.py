"""Repeated lines of a collection (method: two Bloom filters for hashes seen once and twice, exact confirmation of suspects)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.joins import salted_join
from foliospark.llm.common import fresh, utf8
from foliospark.session import materialize

#: Bits of one slice of a filter; all bits of a line lie in the slice that the head of its hash names.
SLICE_BITS = 1 << 22
HASHES = 4


def keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line: stripped of ASCII white space, A-Z lowered; None where it has fewer than ``min_chars`` characters."""
    out: list[bytes | None] = []
    for line in utf8(text or "").lower().split(b"\n"):  # bytes methods touch ASCII only
        line = line.strip()
        long = len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(line if long else None)
    return out


def places(hashes: np.ndarray, slices: int, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice of every hash and its bits inside that slice."""
    h = hashes.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(20)) | np.uint64(1)
    bits = np.stack([(a + np.uint64(i) * b) % np.uint64(slice_bits) for i in range(HASHES)], axis=1)
    return ((h >> np.uint64(40)) % np.uint64(slices)).astype(np.int64), bits.astype(np.uint32)


def _line_hashes(texts: list[str | None], min_chars: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(k) for text in texts for k in {k for k in keys(text, min_chars) if k is not None}]


def _twice_filter(docs: DataFrame, text_col: str, min_chars: int, slices: int, slice_bits: int) -> np.ndarray:
    """The filter of hashes that occur in two documents or more, packed, ``slices`` rows.

    Each task sends, for each slice, the set bits of its own two filters; a slice's task ors them together and marks as
    seen twice what two tasks have set. Only fixed-size filters meet, in slices, whatever the number of lines.
    """
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, n = np.unique(np.array(_line_hashes(batch["text"].tolist(), min_chars), np.uint64), return_counts=True)
            part, bits = places(h, slices, slice_bits)
            rows = []
            for s in np.unique(part).tolist():
                once, twice = np.unique(bits[part == s]), np.unique(bits[(part == s) & (n > 1)])
                rows.append((s, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)))
            yield pd.DataFrame(rows, columns=["slice", "once", "twice"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, once_bits, twice_bits in zip(batch["slice"].tolist(), batch["once"], batch["twice"]):
                once, twice = held.setdefault(s, (np.zeros(slice_bits, bool), np.zeros(slice_bits, bool)))
                bits = np.frombuffer(zlib.decompress(once_bits), np.uint32)
                twice[bits[once[bits]]] = True
                once[bits] = True
                twice[np.frombuffer(zlib.decompress(twice_bits), np.uint32)] = True
        for s, (_, twice) in held.items():
            yield pd.DataFrame({"slice": [s], "twice": [np.packbits(twice).tobytes()]})

    rows = (docs.select(F.col(text_col).alias("text")).mapInPandas(local, "slice int, once binary, twice binary")
            .repartition("slice").mapInPandas(merged, "slice int, twice binary"))
    out = np.zeros((slices, slice_bits // 8), np.uint8)
    for row in rows.toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["twice"], np.uint8)
    return out


def slices_for(docs: DataFrame, text_col: str, max_filter_bits: int, slice_bits: int) -> int:
    """One bit for every 16 bytes of text, in whole slices, at most ``max_filter_bits``."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, min(-(-(size // 16) // slice_bits), max_filter_bits // slice_bits))


def suspects(docs: DataFrame, id_col: str, text_col: str, min_chars: int, max_filter_bits: int, slice_bits: int) -> DataFrame:
    """``(id, digest)`` of the distinct long lines of each row that the filter has seen twice."""
    slices = slices_for(docs, text_col, max_filter_bits, slice_bits)
    shared = docs.sparkSession.sparkContext.broadcast(_twice_filter(docs, text_col, min_chars, slices, slice_bits))

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch["text"].tolist()):
                own = {k for k in keys(text, min_chars) if k is not None}
                owner += [i] * len(own)
                found += own
            part, bits = places(np.array([xxhash.xxh3_64_intdigest(k) for k in found], np.uint64), slices, slice_bits)
            seen = np.ones(len(found), bool)
            for i in range(HASHES):
                seen &= (bitmap[part, bits[:, i] >> 3] >> (7 - (bits[:, i] & 7)).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(seen)
            ids = batch["id"].tolist()
            yield pd.DataFrame({"id": pd.Series([ids[owner[i]] for i in at], dtype="Int64"),
                                "digest": [digest(found[i]) for i in at]})

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        tested, "id bigint, digest binary")


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
               max_filter_bits: int = 1 << 31, slice_bits: int = SLICE_BITS) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines``, ``n_dropped`` (bigint) beside.

    A line whose key has at least ``min_chars`` characters and is in at least ``min_docs`` rows goes everywhere but in the
    rows of the largest id that hold it (every one of its places there stays). Keys are confirmed by 128-bit digests of
    whole keys; the filters only choose which lines have to be counted, so their size never changes the result. A null or
    empty text is one empty line and comes back empty. A row without id counts as a holder but keeps its lines; rows that
    share an id each count, and keep what either of them keeps. Other columns pass through, and an empty table comes back empty. ``max_filter_bits`` bounds
    what is broadcast (256 MiB); past it more lines are suspected.
    """
    found = materialize(suspects(docs, id_col, text_col, min_chars, max_filter_bits, slice_bits), "line-suspects")
    repeated = materialize(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
                           .filter(F.col("n") >= min_docs), "repeated-lines")
    counts = repeated.select("digest", "n")
    lost_id, lost_lines, result = (fresh(docs, name) for name in ("_lost_id", "_lost", "_kept"))
    lost = (salted_join(found, repeated.drop("n"), ["digest"], F.col("id"), counts=counts).filter(F.col("id") != F.col("last"))
            .groupBy(F.col("id").alias(lost_id)).agg(F.collect_set("digest").alias(lost_lines)))

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, losts in batches:
            rows = []
            for text, lost_digests in zip(texts.tolist(), losts.tolist()):
                text = text or ""
                lines = text.split("\n")
                if lost_digests is None or not len(lost_digests):
                    rows.append((text, len(lines), 0))
                    continue
                gone = set(lost_digests)
                stay = [line for line, key in zip(lines, keys(text, min_chars)) if key is None or digest(key) not in gone]
                rows.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    joined = docs.join(lost, docs[id_col].cast("bigint") == F.col(lost_id), "left")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return (joined.withColumn(result, kept(F.col(text_col), F.col(lost_lines)))
            .select(*others, F.col(f"{result}.text").alias(text_col), f"{result}.n_lines", f"{result}.n_dropped"))
