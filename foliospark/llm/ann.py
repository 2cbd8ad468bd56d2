"""Approximate nearest neighbours by inner product (method: balanced posting lists under a graph of centroids)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.vafile import usable
from foliospark.session import materialize

FILING_BEAM = 32  # lists looked at to file a row
WIDTH = 8  # centroids that a search expands at once
REGION = 128  # neighbouring lists that are searched by one task
SAMPLE_BYTES = 64 << 20  # of the vectors that the driver fits centroids on


class Index(NamedTuple):
    centroids: np.ndarray  # lists x dimensions, in an order that keeps near lists near
    graph: np.ndarray  # neighbours of each centroid
    entry: np.ndarray  # centroids a search starts from
    limit: float  # largest squared length of a vector


def balanced_leaves(points: np.ndarray, leaf: int, seed: int = 5) -> list[np.ndarray]:
    """Rows of ``points`` in leaves of about ``leaf`` rows each: two-means, cut at the median of the difference, again and again."""
    rng = np.random.default_rng(seed)
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        x = points[rows]
        pair = x[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            side = x @ (pair[1] - pair[0])
            order = np.argsort(side, kind="stable")
            half = len(rows) // 2
            pair = np.stack([x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)])
        todo += [rows[order[half:]], rows[order[:half]]]
    return leaves


def settle(points: np.ndarray, centroids: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The centroids after some rounds of moving each to the mean of the points nearest to it."""
    for _ in range(rounds):
        square, sums, count = (centroids ** 2).sum(axis=1), np.zeros_like(centroids), np.zeros(len(centroids))
        for a in range(0, len(points), 4096):
            part = points[a: a + 4096]
            nearest_one = (square[None, :] - 2 * part @ centroids.T).argmin(axis=1)
            np.add.at(sums, nearest_one, part)
            count += np.bincount(nearest_one, minlength=len(centroids))
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def build_graph(centroids: np.ndarray, degree: int) -> np.ndarray:
    """Nearest other centroids of each one, and a few far ones by fixed steps, so that every centroid can be reached."""
    n = len(centroids)
    near = min(degree, n - 1)
    square = (centroids ** 2).sum(axis=1)
    links = np.empty((n, near), np.int64)
    for a in range(0, n, 1024):
        distance = square[None, :] - 2 * centroids[a: a + 1024] @ centroids.T
        distance[np.arange(len(distance)), np.arange(a, a + len(distance))] = np.inf
        links[a: a + 1024] = np.argsort(distance, axis=1, kind="stable")[:, :near]
    steps = [1 << i for i in range(n.bit_length()) if 1 << i < n]
    far = np.stack([(np.arange(n) + s) % n for s in steps], axis=1) if steps else np.zeros((n, 0), np.int64)
    return np.concatenate([links, far], axis=1) if n > 1 else np.zeros((1, 1), np.int64)


def search_graph(index: Index, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """``(lists, squared distances)`` of the ``beam`` nearest centroids found for each row of ``x``, nearest first.

    All rows walk at once: each expands its nearest centroids not yet expanded, until those of its whole beam are. A beam
    that is not full (the graph is connected, so that is a beam of all lists) leaves none out.
    """
    n, rows = len(index.centroids), np.arange(len(x))
    beam = min(beam, n)
    square, own = (index.centroids ** 2).sum(axis=1), (x ** 2).sum(axis=1)
    seen = np.zeros((len(x), n), bool)
    start = np.broadcast_to(index.entry, (len(x), len(index.entry)))
    seen[:, index.entry] = True
    found = start.copy()
    distance = square[found] - 2 * x @ index.centroids[index.entry].T
    done = np.zeros(found.shape, bool)
    while True:
        if found.shape[1] > beam:
            best = np.argpartition(distance, beam - 1, axis=1)[:, :beam]
            found, distance, done = (np.take_along_axis(a, best, 1) for a in (found, distance, done))
        waiting = np.where(done, np.inf, distance)
        many = min(WIDTH, waiting.shape[1])
        at = np.argpartition(waiting, many - 1, axis=1)[:, :many]
        active = np.isfinite(np.take_along_axis(waiting, at, 1))
        if not active.any():
            break
        np.put_along_axis(done, at, True, 1)
        links = index.graph[np.take_along_axis(found, at, 1)].reshape(len(x), -1)
        fresh = ~np.take_along_axis(seen, links, 1) & np.repeat(active, index.graph.shape[1], axis=1)
        order = np.argsort(np.where(fresh, links, n), axis=1, kind="stable")  # one link may be there several times
        links, fresh = np.take_along_axis(links, order, 1), np.take_along_axis(fresh, order, 1)
        fresh[:, 1:] &= (links[:, 1:] != links[:, :-1]) | ~fresh[:, :-1]
        most = max(int(fresh.sum(axis=1).max()), 1)
        front = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        links, fresh = np.take_along_axis(links, front, 1), np.take_along_axis(fresh, front, 1)
        seen[rows[:, None].repeat(links.shape[1], 1)[fresh], links[fresh]] = True
        gap = square[links] - 2 * np.einsum("rd,rld->rl", x, index.centroids[links])
        gap[~fresh] = np.inf
        found, distance = np.concatenate([found, links], axis=1), np.concatenate([distance, gap], axis=1)
        done = np.concatenate([done, ~fresh], axis=1)
    order = np.argsort(distance, axis=1, kind="stable")
    return np.take_along_axis(found, order, 1), np.maximum(np.take_along_axis(distance, order, 1) + own[:, None], 0)


def lengthened(vectors: np.ndarray, limit: float | None) -> np.ndarray:
    """One more component that makes all vectors equally long, 0 for queries: nearest is then largest inner product."""
    if limit is None:
        return np.pad(vectors, ((0, 0), (0, 1)))
    return np.concatenate([vectors, np.sqrt(np.maximum(limit - (vectors ** 2).sum(axis=1), 0))[:, None]], axis=1)


def fit(points: DataFrame, rows: int, limit: float, sample_rows: int, leaf: int, degree: int, seed: int = 5) -> Index:
    """Index over a sample of about ``sample_rows`` rows chosen by hash, all rows if there are no more; at most twice as many reach the driver."""
    share = min(1.0, sample_rows / max(rows, 1))
    chosen = points.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else points
    vectors = np.stack(chosen.select("vec").limit(2 * sample_rows).toPandas()["vec"].to_numpy()).astype(np.float64)
    x = lengthened(vectors[np.lexsort(vectors.T)], limit)
    centroids = settle(x, np.stack([x[r].mean(axis=0) for r in balanced_leaves(x, leaf)]))
    entry = np.unique(np.linspace(0, len(centroids) - 1, min(16, len(centroids))).astype(np.int64))
    return Index(centroids, build_graph(centroids, degree), entry, limit)


def choose_lists(index: Index, x: np.ndarray, beam: int, ratio: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, list)``: the nearest list and those within ``ratio`` of its distance, up to ``replicas``."""
    out_rows, out_lists = [], []
    for a in range(0, len(x), 1024):
        lists, distance = search_graph(index, x[a: a + 1024], beam)
        lists, distance = lists[:, :replicas], distance[:, :replicas]
        chosen = (distance <= ratio ** 2 * distance[:, :1]) | (np.arange(lists.shape[1]) == 0)
        row, at = np.nonzero(chosen)
        out_rows.append(row + a)
        out_lists.append(lists[row, at])
    return np.concatenate(out_rows), np.concatenate(out_lists)


def probe_lists(index: Index, x: np.ndarray, sizes: np.ndarray, beam: int, ratio: float, least: int, rows_wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, list)``: lists within ``ratio`` of the nearest one's distance, ``least`` at least, and on until they hold ``rows_wanted`` rows."""
    out_rows, out_lists = [], []
    for a in range(0, len(x), 1024):
        part = x[a: a + 1024]
        lists, distance = search_graph(index, part, beam)
        held = np.cumsum(sizes[lists], axis=1)
        take = (distance <= ratio ** 2 * distance[:, :1]) | (np.arange(lists.shape[1]) < least)
        take |= np.pad(held, ((0, 0), (1, 0)))[:, :-1] < rows_wanted
        for i in np.flatnonzero(held[:, -1] < rows_wanted):  # the beam's lists are too small: take every list
            out_rows.append(np.full(len(sizes), a + i))
            out_lists.append(np.arange(len(sizes)))
            take[i] = False
        row, at = np.nonzero(take)
        out_rows.append(row + a)
        out_lists.append(lists[row, at])
    return np.concatenate(out_rows), np.concatenate(out_lists)


def best_distinct(at: np.ndarray, ids: np.ndarray, score: np.ndarray, points: np.ndarray, query: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best different ids among the places ``at``, and their scores, ties to the smaller one; looks at the ``first`` best places, then at more.

    ``score`` comes from one product for many queries, where equal vectors may differ in the last bit. So places within rounding of the
    last one looked at are looked at too, and each of them is summed alone.
    """
    while True:
        near = at
        if len(at) > first:
            least = np.partition(score[at], len(at) - first)[len(at) - first]
            near = at[score[at] >= least - 1e-9 * abs(least)]
        value = (points[near] * query).sum(axis=1)
        order = np.lexsort((ids[near], -value))
        _, front = np.unique(ids[near][order], return_index=True)
        if len(front) >= k or len(near) == len(at):
            best = order[np.sort(front)[:k]]
            return ids[near][best], value[best]
        first *= 4


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "vec", sample_rows: int = 32_768,
            leaf: int = 64, degree: int = 16, replicas: int = 2, closure: float = 1.01, ratio: float = 1.23, least: int = 16,
            beam: int = 1024, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query, the k largest inner products found among all rows but its own.

    Vectors of different lengths have no product together, so there is an index for each length (a thousand at most) and a query is
    answered by those of its own. Centroids come from a sample of at most ``sample_rows`` rows and ``SAMPLE_BYTES``, split evenly down to
    ``leaf`` rows; every row of the table is then filed
    under its nearest centroid and, near a boundary, under up to ``replicas`` ones within ``closure`` of that distance. A graph over the
    centroids, held by every task (at most ``2 * sample_rows / leaf`` of them), finds the lists of rows and queries. A query
    reads lists up to ``ratio`` times the distance of its nearest one, ``least`` at least, and goes on while its lists could hold fewer than k
    other rows; the walk finds ``beam`` lists at most. Large lists are searched in blocks, so none has to fit a task. Scores are inner products of the original vectors
    in double precision.

    Rows with a null id or a vector that is null, zero, or has a null or non-finite component take no part. Ties go to the smaller id. Rows
    that share an id are not each other's candidates, and an id is found once, by its best row; a query whose id has rows of several lengths
    is asked by all of them. Fewer candidates than k give them all. An empty table gives no rows; other columns are not carried.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec"))).filter(F.exists("vec", lambda c: c != 0))
    square = F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c)
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(square).alias("limit"), F.count_if("asks").alias("asking"))
    lengths = lengths.orderBy("n").limit(1001).collect()
    if len(lengths) > 1000:
        raise ValueError("vectors of more than 1000 lengths")
    parts = [found_of_length(rows.filter(F.size("vec") == of["n"]), of["n"], of["rows"], of["limit"], k, sample_rows, leaf, degree, replicas, closure, ratio, least,
                             beam, block_rows, query_rows) for of in lengths if of["asking"]]
    if not parts:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    best = reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(F.col("qid").alias("query_id"), "rank", F.col("id").alias(id_col), "score"))


def found_of_length(rows: DataFrame, dimensions: int, n_rows: int, limit: float, k: int, sample_rows: int, leaf: int, degree: int, replicas: int, closure: float,
                    ratio: float, least: int, beam: int, block_rows: int, query_rows: int) -> DataFrame:
    """``(qid, id, score)`` among rows ``(id, vec, asks)`` of one length: of every query the best of each block that it reads."""
    spark = rows.sparkSession
    index = fit(rows, n_rows, limit, max(leaf, min(sample_rows, SAMPLE_BYTES // (8 * dimensions))), leaf, degree)
    shared = spark.sparkContext.broadcast(index)

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["vec"].to_numpy())
            row, at = choose_lists(shared.value, lengthened(x, shared.value.limit), FILING_BEAM, closure, replicas)
            yield pd.DataFrame({"list": at, "id": batch["id"].to_numpy()[row], "vec": batch["vec"].to_numpy()[row]})

    lists = materialize(rows.select("id", "vec").mapInPandas(filed, "list int, id bigint, vec array<double>"), "ann-lists")
    stored_rows, sizes = np.zeros((2, len(index.centroids)), np.int64)
    for r in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).collect():  # a row for each centroid at most
        stored_rows[r["list"]], sizes[r["list"]] = r["n"], r["ids"]

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["vec"].to_numpy())
            row, at = probe_lists(shared.value, lengthened(x, None), sizes, beam, ratio, least, (k + 1) * replicas)
            probes = pd.DataFrame({"row": row, "region": at // REGION, "list": at}).groupby(["row", "region"])["list"].agg(list).reset_index()
            yield pd.DataFrame({"region": probes["region"], "qid": batch["id"].to_numpy()[probes["row"]],
                                "vec": batch["vec"].to_numpy()[probes["row"]], "lists": probes["list"]})

    probes = materialize(rows.filter("asks").select("id", "vec").mapInPandas(
        asking, "region int, qid bigint, vec array<double>, lists array<int>"), "ann-probes")
    held = np.bincount(np.arange(len(stored_rows)) // REGION, weights=stored_rows).astype(np.int64)
    asked = {r["region"]: r["count"] for r in probes.groupBy("region").count().collect()}  # one row for each region at most
    split = spark.createDataFrame([(i, int(max(1, -(-n // block_rows))), int(max(1, -(-asked.get(i, 0) // query_rows)))) for i, n in enumerate(held.tolist())],
                                  "region int, blocks int, askers int")
    split = F.broadcast(split)  # one row for each region
    stored = (lists.withColumn("region", (F.col("list") / REGION).cast("int")).join(split, "region")
              .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"))
              .select("region", "block", "asker", "list", "id", "vec"))
    wanted = (probes.join(split, "region").withColumn("asker", F.pmod(F.xxhash64("qid"), "askers").cast("int"))
              .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("region", "block", "asker", "qid", "vec", "lists"))

    def meet(key: tuple, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found_q, found_id, found_score = [], [], []
        if len(points) and len(queries):
            ids, local = points["id"].to_numpy(), points["list"].to_numpy() - int(key[0]) * REGION
            p = np.stack(points["vec"].to_numpy())
            for a in range(0, len(queries), 256):
                part = queries.iloc[a: a + 256]
                q, own = np.stack(part["vec"].to_numpy()), part["qid"].to_numpy()
                reads = np.zeros((len(part), REGION), bool)
                for i, chosen in enumerate(part["lists"]):
                    reads[i, np.asarray(chosen) - int(key[0]) * REGION] = True
                score = np.where(reads[:, local] & (ids[None, :] != own[:, None]), q @ p.T, -np.inf)
                for i, qid in enumerate(own):
                    at = np.flatnonzero(score[i] > -np.inf)
                    best, value = best_distinct(at, ids, score[i], p, q[i], k, k * replicas)
                    found_q.append(np.full(len(best), qid))
                    found_id.append(best)
                    found_score.append(value)
        empty = [np.zeros(0, np.int64)]
        return pd.DataFrame({"qid": np.concatenate(found_q or empty), "id": np.concatenate(found_id or empty),
                             "score": np.concatenate(found_score or empty).astype(np.float64)})

    keys = ["region", "block", "asker"]
    return stored.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(meet, "qid bigint, id bigint, score double")
