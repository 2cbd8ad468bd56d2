"""Token counts of byte-level BPE without building token lists (method: rank-synchronous array merging)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bpe import Cache, fill, load_json
from foliospark.llm.common import chunks
from foliospark.llm.pretokens import pretokens

_CACHES: dict[str, Cache] = {}


def counts(texts: list[str | None], vocabulary: str) -> np.ndarray:
    """Tokens of each text. A special string inside a text is one token, and splits the text."""
    merges = load_json(vocabulary)
    cache = _CACHES.setdefault(vocabulary, Cache())
    out = []
    for part in chunks(texts):
        pieces, owner, extra = part, np.arange(len(part)), np.zeros(len(part), np.int64)
        for special in merges.specials:
            if any(special in p for p in pieces):
                cut = [p.split(special) for p in pieces]
                many = np.fromiter(map(len, cut), np.int64, len(cut))
                np.add.at(extra, owner, many - 1)
                pieces, owner = [p for c in cut for p in c], np.repeat(owner, many)
        words, of_piece = pretokens(pieces)
        fill(cache, merges, words, lambda _, n: n.tolist())
        total = np.append(0, np.cumsum(np.fromiter(map(cache.__getitem__, words), np.int64, len(words))))
        ends = np.cumsum(of_piece)
        np.add.at(extra, owner, total[ends] - total[ends - of_piece])
        out.append(extra)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row's whole text; no shuffle.

    ``vocabulary`` is the path of a byte-level BPE file with a merge list, readable on every executor. A null text counts
    as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each; other columns are not carried. A text is
    never cut: a very long one is merged alone, in memory proportional to it.
    """
    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(counts(batch.tolist(), vocabulary))

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counted = rows.select(F.col(id_col), F.octet_length("_text").cast("bigint").alias("n_bytes"), tokens("_text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
