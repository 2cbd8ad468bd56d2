"""Ranked lexical search (method: dense blocked BLAS products of document impacts and item vocabularies).

Items are taken in blocks of bounded size. For a block, the corpus is cut into terms once and only the counts of the block's terms are
written; then tiles of documents (rows) by terms (columns) are multiplied with tiles of terms by items in float64. All factors are whole
numbers and every product's sums stay below 2^53, so float64 is exact; the tiles' results are added up as 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import utf8
from foliospark.session import materialize

#: Bytes of a term: digits, letters (A-Z lowered) and whatever UTF-8 uses past ASCII; every other byte parts terms.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Documents and terms of one dense tile, and items of one product.
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 256, 1024, 256
#: Items and distinct terms that one block is closed at; an item with more terms than that is a block of its own.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 65_536
#: An impact is below this: the scale of the contract over the least denominator.
IMPACT_LIMIT = 1_000_000
#: First-level groups that the tasks' best are merged in, so that no task meets every task's rows for an item.
MERGE_GROUPS = 64


def terms(text: str | None) -> list[bytes]:
    return utf8(text or "").translate(TERM_BYTES).split()


class Block:
    """A block of items: its terms, numbered, and which items have which."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.columns: dict[bytes, int] = {}
        self.pairs: list[tuple[int, int]] = []  # column, item's place

    def add(self, item: int, words: set[bytes]) -> None:
        self.items.append(item)
        self.pairs += [(self.columns.setdefault(w, len(self.columns)), len(self.items) - 1) for w in sorted(words)]


def blocks(items: DataFrame, id_col: str, text_col: str, most_items: int, most_terms: int) -> Iterator[Block]:
    """Items by id, in blocks; the driver holds one block. Rows of one id are one item with the terms of all of them."""
    block, item, words = Block(), None, set()
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).alias("text"))
    for row in rows.distinct().orderBy("item").toLocalIterator():
        if row["item"] != item:
            if words:
                block.add(item, words)
            if len(block.items) >= most_items or len(block.columns) >= most_terms:
                yield block
                block = Block()
            item, words = row["item"], set()
        words.update(terms(row["text"]))
    if words:
        block.add(item, words)
    if block.items:
        yield block


def counted(docs: DataFrame, columns: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, cols, tfs)``: the length of every document that has a term, and its counts of the terms in ``columns``."""
    shared = docs.sparkSession.sparkContext.broadcast(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, lengths, found = [], [], ([], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Counter(terms(text.as_py()))
                if own:
                    ids.append(doc)
                    lengths.append(own.total())
                    hit = own.keys() & known.keys()
                    found[0].append([known[w] for w in hit])
                    found[1].append([own[w] for w in hit])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found[0], pa.list_(pa.int32())),
                pa.array(found[1], pa.list_(pa.int64()))], ["doc_id", "n", "cols", "tfs"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n bigint, cols array<int>, tfs array<bigint>")


def weights(frequencies: dict[int, int], columns: int, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of each column, in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequencies.get(c, 0) + 1))) for c in range(columns)], np.float64)


def tile_width(weight: np.ndarray, most: int = TILE_TERMS) -> int:
    """Terms whose weighted impacts can be added up in a float64 without rounding."""
    top = float(weight.max(initial=1.0)) or 1.0
    width = min(most, int((2**53 - 1) // (top * IMPACT_LIMIT)))
    if width < 1:
        raise ValueError("a single weighted impact can pass 2^53")
    return width


class ItemTiles:
    """Weights as dense tiles: items in groups, each with its own compact vocabulary."""

    def __init__(self, pairs: np.ndarray, n_items: int, weight: np.ndarray, tile_items: int = TILE_ITEMS, tile_terms: int = TILE_TERMS):
        width = tile_width(weight, tile_terms)
        self.groups = []
        for first in range(0, n_items, tile_items):
            own = pairs[(pairs[:, 1] >= first) & (pairs[:, 1] < first + tile_items)]
            vocabulary, place = np.unique(own[:, 0], return_inverse=True)
            places = np.full(len(weight), -1, np.int64)
            places[vocabulary] = np.arange(len(vocabulary))
            size = min(tile_items, n_items - first)
            tiles = []
            for start in range(0, len(vocabulary), width):
                inside = (place >= start) & (place < start + width)
                tile = np.zeros((min(width, len(vocabulary) - start), size))
                tile[place[inside] - start, own[inside, 1] - first] = weight[own[inside, 0]]
                tiles.append((start, tile))
            self.groups.append((first, size, places, tiles))

    def scores(self, owner: np.ndarray, cols: np.ndarray, impacts: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each group of items its first place and the whole scores, documents by items."""
        for first, size, places, tiles in self.groups:
            place = places[cols]
            total = np.zeros((n_docs, size), np.int64)
            for start, tile in tiles:
                at = np.flatnonzero((place >= start) & (place < start + len(tile)))
                used, column = np.unique(place[at] - start, return_inverse=True)  # the terms that these documents have at all
                if len(used):
                    dense = np.zeros((n_docs, len(used)))
                    dense[owner[at], column] = impacts[at]
                    total += (dense @ tile[used]).astype(np.int64)
            yield first, total


class Best:
    """The best ``k`` documents of each item so far: highest score, then smallest id. A tile's ties with the kth are kept until ids decide."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.zeros(n_items, np.int64)  # kth best score so far; 0 while there are fewer
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def take(self, first: int, ids: np.ndarray, scores: np.ndarray) -> None:
        row, column = np.nonzero((scores > 0) & (scores >= self.least[first:first + scores.shape[1]]))
        if not len(row):
            return
        item = np.append(self.item, column + first)
        doc, score = np.append(self.doc, ids[row]), np.append(self.score, scores[row, column])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.k - 1
        self.least[item[full]] = score[full]
        stay = rank < self.k
        self.item, self.doc, self.score = item[stay], doc[stay], score[stay]


def best_of_block(counts: DataFrame, block: Block, weight: np.ndarray, n_docs: int, n_terms: int, k: int,
                  tile_docs: int = TILE_DOCS, tile_items: int = TILE_ITEMS, tile_terms: int = TILE_TERMS) -> DataFrame:
    """``(item_id, doc_id, score)``: each task's best ``k`` documents of every item of the block."""
    shared = counts.sparkSession.sparkContext.broadcast((np.array(block.pairs, np.int64).reshape(-1, 2), np.array(block.items, np.int64), weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, items, weight = shared.value
        tiles, best = ItemTiles(pairs, len(items), weight, tile_items, tile_terms), Best(len(items), k)
        for batch in batches:
            for at in range(0, batch.num_rows, tile_docs):
                part = batch.slice(at, tile_docs)
                ids, length = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                many = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                cols, tfs = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                owner = np.repeat(np.arange(len(ids)), many)
                norm = np.array([10 + (90 * int(n) * n_docs) // n_terms for n in length], np.int64)
                impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * norm[owner])
                for first, scores in tiles.scores(owner, cols, impacts, len(ids)):
                    best.take(first, ids, scores)
        yield pa.RecordBatch.from_arrays([pa.array(items[best.item]), pa.array(best.doc), pa.array(best.score)], ["item_id", "doc_id", "score"])

    return counts.filter(F.size("cols") > 0).mapInArrow(search, "item_id bigint, doc_id bigint, score bigint")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` documents of highest score above 0, ties to the smaller id.

    Every row with an id is a document of its own, so repeated rows each count and each can be listed; rows without id take no part, neither as
    documents nor as items. Null and empty texts have no terms: such a document counts nowhere, such an item has no row. Item rows of one id
    are one item. Empty tables give an empty result. Texts are read whole; other columns are not carried. Documents are read and cut into
    terms once for each block of items.
    """
    parts = []
    for block in blocks(items, item_col, item_text_col, block_items, block_terms):
        counts = materialize(counted(docs, block.columns, id_col, text_col), "lexical-counts")
        whole = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not whole["docs"]:
            break
        df = counts.select(F.explode("cols").alias("col")).groupBy("col").agg(F.count(F.lit(1)).alias("df"))
        frequencies = {r["col"]: r["df"] for r in df.toLocalIterator()}  # at most the block's terms
        weight = weights(frequencies, len(block.columns), whole["docs"])
        parts.append(best_of_block(counts, block, weight, whole["docs"], whole["terms"], k))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = reduce(DataFrame.unionByName, parts).withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
    order = [F.col("score").desc(), "doc_id"]
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_group").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
