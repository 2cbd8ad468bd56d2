"""Words and pairs of words of many documents at once: tokens of a slice of rows as numbers, counted by sorting keys.

Strings are made for what is distinct in a slice only, so that no row of (document, term) is built where sums over a corpus or products with
a vocabulary are wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import WORD

#: Tokens that are worked on at once, unless a single text has more.
SLICE_TOKENS = 1 << 20
#: Bytes of text that are cut into tokens at once, unless a single text has more.
SLICE_BYTES = 1 << 23
#: Bytes of the character that a byte starts: 0 inside one.
WIDTH = np.repeat(np.array([1, 0, 2, 3, 4], np.uint8), [128, 64, 32, 16, 16])

Slices = Callable[[Iterator[pa.RecordBatch], int], Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_TOKENS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """``(rows, row of each token, tokens)`` of batches whose ``column`` has lists of strings; a null list is empty."""
    for batch in batches:
        many = pc.fill_null(batch.column(column).value_lengths(), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(many, dtype=np.int64), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            part = batch.slice(first, last - first)
            yield part, np.repeat(np.arange(last - first), many[first:last]), part.column(column).flatten().cast(pa.string())
            first = last


def word_points(spark: SparkSession) -> np.ndarray:
    """For every code point whether it is a word character, as the JVM's patterns see it: asked once for each context."""
    context = spark.sparkContext
    if getattr(context, "_foliospark_words", None) is None:
        points = spark.range(0x110000).filter(~F.col("id").between(0xD800, 0xDFFF))  # halves of a pair are no characters
        text = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        word = np.zeros(0x110000, bool)
        word[[r["id"] for r in points.filter(text.rlike(f"[{WORD}]")).collect()]] = True
        context._foliospark_words = word
    return context._foliospark_words


def _word_bytes(data: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to word characters."""
    out = np.concatenate([word[:128], np.zeros(128, bool)])[data]
    lead = np.flatnonzero(data >= 0xC0)
    width = WIDTH[data[lead]]
    for n in (2, 3, 4):
        at = lead[width == n]
        at = at[at + n <= len(data)]
        point = (data[at] & (0x7F >> n)).astype(np.int64)
        for i in range(1, n):
            point = (point << 6) | (data[at + i] & 0x3F)
        at = at[word[np.minimum(point, len(word) - 1)]]
        for i in range(n):
            out[at + i] = True
    return out


def _cut(texts: pa.Array, word: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """``(row of each token, tokens)`` of lower-case texts: runs of two and more word characters, in text order."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]: offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _word_bytes(data, word)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[offsets < len(data)]
    first[edges] = inside[edges]  # a text's last word and the next one's first are two
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    width = WIDTH[data[start]]
    several = stop - start > width
    for n in (1, 2, 3, 4):  # a single character is no token
        alone = start[~several & (width == n)]
        for i in range(n):
            inside[alone + i] = False
    start, size = start[several], (stop - start)[several]
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return np.searchsorted(offsets, start, "right") - 1, tokens


def text_slices(batches: Iterator[pa.RecordBatch], column: int, word: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """``(rows, row of each token, tokens)`` of batches whose ``column`` has lower-case texts; a null text has no token."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes, dtype=np.int64), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            part = batch.slice(first, last - first)
            yield part, *_cut(pc.fill_null(part.column(column).cast(pa.string()), ""), word)
            first = last


def cut_of(df: DataFrame) -> tuple[Column, Slices]:
    """The column tasks cut slices of, ``tokens`` or else ``text``, and how: texts are cut in the task, so that no list of tokens is moved to it."""
    if "tokens" in df.columns:
        return F.col("tokens"), slices
    word = df.sparkSession.sparkContext.broadcast(word_points(df.sparkSession))
    return F.lower("text"), lambda batches, column: text_slices(batches, column, word.value)


def runs(row: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, times)`` of the distinct pairs, in their order."""
    key, times = np.unique(row * np.int64(max(width, 1)) + place, return_counts=True)
    return key // max(width, 1), key % max(width, 1), times


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _pairs(row: np.ndarray) -> np.ndarray:
    """Places of tokens that another one of the same row follows."""
    return np.flatnonzero(row[1:] == row[:-1])


def counted(row: np.ndarray, tokens: pa.Array, max_n: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For words and, with ``max_n`` of 2, pairs: ``(n, terms, row, place in terms, times)``."""
    code, words = _coded(tokens)
    yield 1, words, *runs(row, code, len(words))
    at = _pairs(row)
    if max_n > 1 and len(at):
        pair, keys = _coded(pa.array(code[at] * len(words) + code[at + 1]))
        keys = keys.to_numpy(zero_copy_only=False)
        left, right = (words.take(pa.array(part)) for part in (keys // len(words), keys % len(words)))
        yield 2, pc.binary_join_element_wise(left, right, " "), *runs(row[at], pair, len(keys))


def pair_sums(row: np.ndarray, tokens: pa.Array, words: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(group, pair, rows, times)`` of neighbours that are both among ``words``, a pair as left x words + right; ``group`` is each row's, small and whole."""
    code, distinct = _coded(tokens)
    number = pc.fill_null(pc.index_in(distinct, words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
    at = _pairs(row)
    at = at[(number[at] >= 0) & (number[at + 1] >= 0)]
    squared, many = len(words)**2, len(group)
    # Sorted once by group, pair and row.
    key, times = np.unique(((group[row[at]] * squared + number[at] * len(words) + number[at + 1]) * many) + row[at], return_counts=True)
    key //= max(many, 1)
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    found = key[starts]
    return found // max(squared, 1), found % max(squared, 1), np.diff(starts, append=len(key)), np.add.reduceat(times, starts) if len(starts) else times


class Vocabulary:
    """Distinct terms, words or pairs of words, that are found in tokens by number."""

    def __init__(self, terms: list[str]):
        self.size = len(terms)
        split = [(t.split(" ", 1), place) for place, t in enumerate(terms)]
        words = [(parts[0], place) for parts, place in split if len(parts) == 1]
        pairs = [(*parts, place) for parts, place in split if len(parts) == 2]
        self.words, self.word_places = [w for w, _ in words], np.array([p for _, p in words] + [-1], np.int64)
        self.parts = sorted({w for left, right, _ in pairs for w in (left, right)})
        number = {w: i for i, w in enumerate(self.parts)}
        keys = np.array([number[left] * len(number) + number[right] for left, right, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.pair_places = keys[order], np.array([p for _, _, p in pairs], np.int64)[order]

    def found(self, row: np.ndarray, tokens: pa.Array, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, place, times)`` of the known terms, by row and place."""
        code, words = _coded(tokens)
        place = self.word_places[pc.fill_null(pc.index_in(words, pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False)][code]
        known = np.flatnonzero(place >= 0)
        rows, places = [row[known]], [place[known]]
        if max_n > 1 and len(self.keys):
            part = pc.fill_null(pc.index_in(words, pa.array(self.parts, pa.string())), -1).to_numpy(zero_copy_only=False)[code].astype(np.int64)
            at = _pairs(row)
            at = at[(part[at] >= 0) & (part[at + 1] >= 0)]
            key = part[at] * len(self.parts) + part[at + 1]
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[near] == key
            rows.append(row[at[hit]])
            places.append(self.pair_places[near[hit]])
        return runs(np.concatenate(rows), np.concatenate(places), self.size)


def listed(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    """One list for each row; ``values`` are in the order of ``row``."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))), pa.int32()), values)
