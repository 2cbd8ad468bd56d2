"""Packing of documents into sequences of fixed size (method: conflict-constrained best fit)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows packed together at most; a shard that gets more of them is packed in several blocks.
BLOCK_ROWS = 16_384
_LOW = 20  # bits of a key in the residual order that number the bin


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each item, in order: the tightest bin with room that holds neither its source nor its cluster.

    Open bins are kept in order of residual, then age. The search starts at the successor of the item's size and goes on
    until a bin is compatible; each bin carries a bitmap of its sources and one of its clusters. A null source or
    cluster conflicts with nothing, and a cluster of one item needs no bit.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    often = Counter(c for c in clusters if c is not None)
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if n > 1)}
    order: list[int] = []
    residual, held_sources, held_clusters, placed = [], [], [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        for i in range(bisect_left(order, size << _LOW), len(order)):
            b = order[i] & ((1 << _LOW) - 1)
            if not (held_sources[b] & s or held_clusters[b] & c):
                del order[i]
                break
        else:
            b = len(residual)
            residual.append(capacity)
            held_sources.append(0)
            held_clusters.append(0)
        placed.append((b, capacity - residual[b]))
        residual[b] -= size
        held_sources[b] |= s
        held_clusters[b] |= c
        insort(order, residual[b] << _LOW | b)
    return placed


def copies(text: Column) -> Column:
    """The cluster of a text's plain copies; null and empty texts are in none."""
    return F.when(F.octet_length(text) > 0, F.xxhash64(text))


def pack(docs: DataFrame, size: Column, capacity: int, id_col: str = "doc_id", source_col: str | None = "source",
         cluster: Column | None = None, shard_rows: int = 8192, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(bin_id, id, piece, start, size, bin_offset)``: every row in bins of ``capacity``, none cut off or dropped.

    A row larger than a bin becomes pieces of full bins and a rest (``piece`` from 0, ``start`` in units of ``size``). A bin
    holds at most one piece of any source and one of any cluster, and items are taken largest first, ties by id. Rows are
    dealt by hash of id and piece to as many shards as keep about ``shard_rows`` in each, so a hot source or a large cluster of copies
    spreads over all shards; conflicts and fit are within a shard, and a bin never spans two. Rows with one id, or without,
    share a shard, which is then packed in blocks of bounded size. A null or negative size is 0 and still gets a place; null sources and
    clusters conflict with nothing; an empty table gives no bins. Other columns are not carried.
    """
    amount = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint")
    items = docs.select(
        F.col(id_col).cast("bigint").alias("id"), amount.alias("total"),
        (F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")).alias("source"),
        (cluster if cluster is not None else F.lit(None)).cast("string").alias("cluster"))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("bigint"))
    shards = max(1, -(-docs.count() // shard_rows))
    items = (items.select("*", F.explode(pieces).alias("piece"))
             .withColumn("size", F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity)))
             .withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
             .select("shard", "id", "piece", "size", "source", "cluster")
             .repartition("shard").sortWithinPartitions("shard", F.desc("size"), "id", "piece", "source", "cluster"))

    def block(rows: pd.DataFrame, first_bin: int) -> pd.DataFrame:
        lists = [[None if pd.isna(x) else x for x in rows[c]] for c in ("source", "cluster")]
        placed = best_fit(rows["size"].tolist(), *lists, capacity)
        shard = int(rows["shard"].iloc[0])
        return pd.DataFrame({
            "bin_id": [(shard << 32) + first_bin + b for b, _ in placed], id_col: rows["id"].to_numpy(), "piece": rows["piece"].to_numpy(),
            "start": rows["piece"].to_numpy() * capacity, "size": rows["size"].to_numpy(), "bin_offset": [o for _, o in placed]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, shard, used = [], None, 0

        def close() -> pd.DataFrame:
            nonlocal used
            out = block(pd.concat(held, ignore_index=True), used)
            used = int(out["bin_id"].max() & 0xFFFFFFFF) + 1
            held.clear()
            return out

        for batch in batches:
            batch["id"] = batch["id"].astype("Int64")
            for s, rows in batch.groupby("shard", sort=False):
                if s != shard:
                    if held:
                        yield close()
                    shard, used = s, 0
                while len(rows):
                    room = block_rows - sum(map(len, held))
                    held.append(rows.iloc[:room])
                    rows = rows.iloc[room:]
                    if room <= len(held[-1]):
                        yield close()
        if held:
            yield close()

    return items.mapInPandas(packed, f"bin_id bigint, `{id_col}` bigint, piece bigint, start bigint, size bigint, bin_offset bigint")
