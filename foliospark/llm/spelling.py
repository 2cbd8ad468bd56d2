"""Spelling variants of a corpus' words (method: one-edit neighbourhoods over a reduced alphabet).

Letters are mapped to a few symbols, so that a word's neighbourhood is small whatever its alphabet. One edit of a word is one edit of its
reduced form or none, so every near pair meets where the neighbourhood of one reduced word holds the other. Candidates are then
compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import materialize

#: Letters are those of Latin-1: A-Z lowered, a-z, and U+00C0 to U+00FF as they are; whatever else parts words.
LETTER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
DAMAGE = 199
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Bits of the filter for each reduced word, and most bits that are broadcast (32 MiB, 16 million words).
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 28
#: Letters whose neighbourhoods are held at once; a single longer word is held alone.
STEP_LETTERS = 16_000
#: Base of the polynomial that names a reduced word, modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def doc_words(doc_id: int, text: str | None, min_chars: int) -> Iterator[tuple[bytes, int]]:
    """The words of one text, in Latin-1, with their counts; one in ``DAMAGE`` (by document and word) loses a letter."""
    own = Counter((text or "").encode("latin-1", "replace").translate(LETTER_BYTES).split())
    start = zlib.crc32(b"%d:" % doc_id)
    for word, n in own.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % DAMAGE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        if len(word) >= min_chars:
            yield word, n


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_count: int, held: int = HELD_WORDS) -> DataFrame:
    """``(word, n)``; counts are added up in the task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        flushed = lambda: pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in doc_words(doc, text.as_py(), min_chars):
                    total[word] += n
                if len(total) >= held:
                    yield flushed()
                    total.clear()
        yield flushed()

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text_col))
    return (rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def symbol_count(words: int) -> int:
    """Symbols so that words of seven letters, dealt evenly, would have a reduced form each."""
    symbols = 4
    while symbols**7 < words:
        symbols += 1
    return symbols


def symbols_of(words: DataFrame, symbols: int) -> dict[str, int]:
    """The symbol of each letter: by frequency, dealt to and fro, so that symbols come about equally often. At most 90 letters are collected."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    ordered = [r["letter"] for r in sorted(letters.collect(), key=lambda r: (-r["n"], r["letter"])) if r["letter"]]
    return {letter: i % symbols if i // symbols % 2 == 0 else symbols - 1 - i % symbols for i, letter in enumerate(ordered)}


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[i + 1] = out[i] * np.uint64(BASE)
    return out


def neighbourhood(reduced: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of reduced words of one length (rows of symbols), and of all words one edit away, with themselves; a name can stand twice.

    A name is the polynomial of the symbols from the front: deleting or inserting moves the rest by one power. Different words may share
    a name, which only makes more candidates.
    """
    rows, length = reduced.shape
    power = _powers(length + 1)
    value = reduced.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        term = value * power[:length]
        head = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)  # first i symbols
        name = head[:, -1]
        tail = name[:, None] - head  # from i on, at their own powers
        up = tail * np.uint64(BASE)
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        parts = [name[:, None], head[:, :-1] + tail[:, 1:] * inverse]
        for symbol in range(1, symbols + 1):
            parts.append(name[:, None] + (np.uint64(symbol) - value) * power[:length])
            parts.append(head + np.uint64(symbol) * power[:length + 1] + up)
    return name, np.concatenate(parts, axis=1)


def _by_length(words: pd.Series, symbol: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and symbol rows of words of one length, a step at a time."""
    lengths = words.str.len().to_numpy()
    table = np.zeros(256, np.int64)
    for letter, s in symbol.items():
        table[ord(letter)] = s
    for length in np.unique(lengths):
        same, rows = np.flatnonzero(lengths == length), max(1, STEP_LETTERS // int(length))
        for first in range(0, len(same), rows):
            at = same[first:first + rows]
            code = np.frombuffer("".join(words.iloc[at]).encode("latin-1"), np.uint8).reshape(len(at), length)
            yield at, table[code]


def _filter(names: DataFrame, bits: int) -> np.ndarray:
    """One bit for each name, folded on the executors: the driver gets 16 bytes for each 64 bits that hold any."""
    place = F.pmod(F.col("name"), F.lit(bits))
    words = names.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(name, {bits}) & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint64)


def near_pairs(words: DataFrame, max_filter_bits: int = MAX_FILTER_BITS, symbols: int | None = None) -> DataFrame:
    """``(word, n, other, other_n)`` of all words one edit apart, both ways. ``words`` is a written table of distinct ``(word, n)``."""
    size = words.count()
    symbols = symbols or symbol_count(size)
    symbol = symbols_of(words, symbols)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            name = np.zeros(len(batch), np.uint64)
            for at, reduced in _by_length(batch["word"], symbol):
                name[at] = neighbourhood(reduced, 0)[0]
            yield batch.assign(name=name.view(np.int64))

    with_names = materialize(words.mapInPandas(named, "word string, n bigint, name bigint"), "reduced-words")
    bits = 64
    while bits < size * FILTER_BITS:
        bits *= 2
    known = words.sparkSession.sparkContext.broadcast(_filter(with_names, bits)) if bits <= max_filter_bits else None

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, reduced in _by_length(batch["word"], symbol):
                keys = np.sort(neighbourhood(reduced, symbols)[1], axis=1)
                wanted = np.ones(keys.shape, bool)
                wanted[:, 1:] = keys[:, 1:] != keys[:, :-1]
                if known is not None:
                    place = (keys.view(np.int64) % bits).astype(np.uint64)
                    wanted &= (known.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                row, column = np.nonzero(wanted)
                own = batch.iloc[at[row]]
                yield pd.DataFrame({"name": keys.view(np.int64)[row, column], "word": own["word"].to_numpy(), "n": own["n"].to_numpy()})

    asked = words.mapInPandas(neighbours, "name bigint, word string, n bigint")
    others = with_names.select("name", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = asked.join(others, "name").filter((F.col("word") != F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1))
    return met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words with a form: forms followed to the last. Each round doubles the way; a form is five times as frequent as
    its word, so rounds grow with the logarithm of the logarithm of the largest count."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "root-links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(links.join(ahead, "root", "left"), "root-step")
        if step.filter(F.col("further").isNotNull()).isEmpty():
            return links
        links = step.select("word", F.coalesce("further", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, ratio: int = 5,
             max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word with ``min_chars`` code points that occurs ``min_count`` times.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that is at least ``ratio`` times as frequent, else
    null; ``form_n`` is its count. Repeated rows count again; rows without id take no part; a null or empty text has no words; an empty
    table gives an empty result. Texts are read whole; other columns are not carried. The filter drops neighbours that no word has; where the
    vocabulary outgrows it all neighbours are joined, with the same result.
    """
    words = materialize(vocabulary(docs, id_col, text_col, min_chars, min_count), "words")
    pairs = near_pairs(words, max_filter_bits)
    best = F.min(F.struct((-F.col("other_n")).alias("order"), "other"))
    near = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.when(-F.col("best.order") >= ratio * F.col("n"), F.col("best.other")).alias("form"), (-F.col("best.order")).alias("form_n"))
    near = materialize(near, "near-words")
    last = roots(near.filter(F.col("form").isNotNull()))
    return words.join(near, "word", "left").join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))
