"""Language identification (method: hyperdimensional profiles)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import chunks, fresh
from foliospark.llm.pretokens import LETTER, class_table

GRAM_BLOCK = 8192  # distinct n-grams whose vectors are held at once


@lru_cache(maxsize=100_000)
def letter_vector(point: int, dims: int) -> np.ndarray:
    """Random signs that belong to a code point."""
    return np.random.default_rng([11, point]).integers(0, 2, dims, dtype=np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of letter trigrams: the product of the letters' vectors, shifted by their places."""
    out = np.ones((len(codes), dims), np.int8)
    for place in range(3):
        points, at = np.unique((codes >> (21 * (2 - place))) & 0x1FFFFF, return_inverse=True)
        letters = np.stack([letter_vector(int(p), dims) for p in points])
        out *= np.roll(letters, 2 - place, axis=1)[at]
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, code)`` of every trigram that has a letter. Letters are lowered; all else is one blank between words."""
    low = [f" {text.lower()} \n" for text in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, low), np.int64, len(low))
    owner = np.repeat(np.arange(len(texts)), size)
    letter = class_table()[code] == LETTER
    code = np.where(letter, code, 0x20)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank right after a letter
    keep[:-1] |= letter[1:]  # and right before one: doubled between words, so that both words have both edges
    code, owner, letter = code[keep], owner[keep], letter[keep]
    grams = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
    whole = (owner[:-2] == owner[2:]) & letter[1:-1]
    return owner[:-2][whole], grams[whole]


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams and the place of each gram among them; by counting where the letters are few."""
    used = np.zeros(0x110000, bool)
    for shift in (42, 21, 0):
        used[(grams >> shift) & 0x1FFFFF] = True
    points = np.flatnonzero(used)
    if len(points) ** 3 > 1 << 22:
        return np.unique(grams, return_inverse=True)
    small = np.zeros(0x110000, np.int64)
    small[points] = np.arange(len(points))
    a = len(points)
    key = (small[grams >> 42] * a + small[(grams >> 21) & 0x1FFFFF]) * a + small[grams & 0x1FFFFF]
    place = np.bincount(key, minlength=a ** 3) > 0
    codes = np.flatnonzero(place)
    return points[codes // (a * a)] << 42 | points[codes // a % a] << 21 | points[codes % a], (np.cumsum(place) - 1)[key]


def bundles(texts: list[str], dims: int, group: np.ndarray | None = None, groups: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the n-gram vectors of each text, or of each group of texts, and the number of n-grams in it."""
    owner, grams = trigrams(texts)
    owner, n = (owner, len(texts)) if group is None else (group[owner], groups)
    total = np.zeros((n, dims), np.float32)
    if not len(grams):
        return total, np.zeros(n, np.int64)
    distinct, at = _distinct(grams)
    if len(distinct) > GRAM_BLOCK:
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        edges = np.searchsorted(at, np.arange(0, len(distinct) + GRAM_BLOCK, GRAM_BLOCK))
    else:
        edges = np.array([0, len(at)])
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        part = distinct[i * GRAM_BLOCK: (i + 1) * GRAM_BLOCK]
        count = np.bincount(owner[a:b] * len(part) + at[a:b] - i * GRAM_BLOCK, minlength=n * len(part))
        total += count.reshape(n, len(part)).astype(np.float32) @ gram_vectors(part, dims).astype(np.float32)
    return total, np.bincount(owner, minlength=n)


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 512, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """``(languages, unit vectors)`` bundled from all rows with text and language, null rows left out.

    Each task sends one sum for each language; at most ``max_languages`` of ``dims`` numbers come to the driver, more is an error.
    """
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"lang": list(held), "sums": [v.tolist() for v in held.values()]})
            held.clear()
            return out

        for batch in batches:
            langs, at = batch["lang"].tolist(), 0
            for part in chunks(batch["text"].tolist()):
                names, group = np.unique(langs[at: at + len(part)], return_inverse=True)
                at += len(part)
                for name, row in zip(names.tolist(), bundles(part, dims, group, len(names))[0].astype(np.float64)):
                    held[name] = held[name] + row if name in held else row
            if len(held) > max_languages:
                yield flush()
        if held:
            yield flush()

    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sums = (known.mapInPandas(local, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("place", "value"))
            .groupBy("lang", "place").agg(F.sum("value").alias("value")))
    rows = sums.limit(max_languages * dims + 1).toPandas()
    if len(rows) > max_languages * dims:
        raise ValueError(f"more than {max_languages} languages")
    wide = rows.pivot(index="lang", columns="place", values="value").sort_index() if len(rows) else pd.DataFrame()
    vectors = wide.to_numpy(np.float64).reshape(len(wide), -1 if len(wide) else dims)
    return list(wide.index), vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, profiles: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the profile of largest cosine, and that cosine, at least 0.

    Ties go to the language that sorts first. Without a letter, without text or without profiles it is ``und`` with score 0. Only
    the text is looked at; all other columns pass through, but for earlier ones of the two names. No shuffle.
    """
    names, vectors = profiles
    dims = vectors.shape[1] if len(names) else 0
    shared = docs.sparkSession.sparkContext.broadcast(vectors.T.astype(np.float32))

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part in chunks(batch.tolist()):
                if not names:
                    out += [("und", 0.0)] * len(part)
                    continue
                sums, n = bundles(part, dims)
                cosine = (sums @ shared.value) / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
                best = cosine.argmax(axis=1)
                out += [(names[b], float(min(max(c[b], 0.0), 1.0))) if k else ("und", 0.0) for b, c, k in zip(best, cosine, n)]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    judged = judged.asNondeterministic()  # else a filter on the outcome would judge every text twice
    result = fresh(docs, "_judged")
    return docs.withColumn(result, judged(F.col(text_col))).select(*others, f"{result}.lang_pred", f"{result}.score")


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of rows that is never learned from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 512) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; profiles come from the rows that are not held out."""
    rows = docs.withColumn("held_out", held_out(id_col))
    learn = rows.filter(~F.col("held_out") & F.col(id_col).isNotNull())
    return predict(rows, fit_profiles(learn, text_col, lang_col, dims), text_col)
