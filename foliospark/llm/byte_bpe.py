"""Byte-level BPE encoding and decoding (method: vectorised pre-tokenisation, cached pair merging)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bpe import Cache, fill, load_ranks
from foliospark.llm.common import chunks
from foliospark.llm.pretokens import pretokens

_CACHES: dict[str, Cache] = {}


def _pieces(ids: np.ndarray, n: np.ndarray) -> Iterator[bytes]:
    data = ids.astype("<u4").tobytes()
    ends = (np.cumsum(n) * 4).tolist()
    return (data[a:b] for a, b in zip([0, *ends], ends))


def encode_texts(texts: list[str | None], ranks: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    merges = load_ranks(ranks)
    cache = _CACHES.setdefault(ranks, Cache())
    for part in chunks(texts):
        words, of_text = pretokens(part)
        fill(cache, merges, words, _pieces)
        coded = list(map(cache.__getitem__, words))
        ends = np.cumsum(of_text).tolist()
        for a, b in zip([0, *ends], ends):
            yield b"".join(coded[a:b])


@lru_cache(maxsize=4)
def _spelling(ranks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, where each begins, and how long each is."""
    tokens = load_ranks(ranks).tokens
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def offsets_of(ids: np.ndarray, ranks: str) -> np.ndarray:
    """Byte offset at which each token starts, with the end of the text last."""
    return np.concatenate([[0], np.cumsum(_spelling(ranks)[2][ids])])


def decode_ids(ids: np.ndarray, ranks: str) -> bytes:
    """The bytes of a text from its ids: one gather by offsets, no loop over tokens."""
    spelling, begin, size = _spelling(ranks)
    if not len(ids):
        return b""
    starts = offsets_of(ids, ranks)
    return spelling[np.repeat(begin[ids] - starts[:-1], size[ids]) + np.arange(starts[-1])].tobytes()


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, offsets)``: token ids, and the UTF-8 byte offset of each token with the text's length last.

    A null or empty text has no ids and the offsets ``[0]``. Repeated rows and null ids give a row each; no shuffle.
    """
    @F.pandas_udf("ids array<bigint>, offsets array<bigint>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in encode_texts(batch.tolist(), ranks)]
            yield pd.DataFrame({"ids": ids, "offsets": [offsets_of(x, ranks) for x in ids]})

    return docs.select(F.col(id_col), coded(F.col(text_col)).alias("_c")).select(id_col, "_c.ids", "_c.offsets")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, data)``: the bytes of each row's ids; null ids give null."""
    @F.pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else decode_ids(np.asarray(x, np.int64), ranks) for x in batch])

    return encoded.select(F.col(id_col), data(F.col(ids_col)).alias("data"))


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded and its ids decoded in one pass.

    A null text counts as empty. Repeated rows and null ids give a row each; other columns are not carried.
    """
    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for code in encode_texts(batch.tolist(), ranks):
                ids = np.frombuffer(code, "<u4").astype(np.int64)
                rows.append((len(ids), hashlib.sha256(code).hexdigest(), hashlib.sha256(decode_ids(ids, ranks)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(F.col(text_col)).alias("_d")).select(id_col, "_d.*")
