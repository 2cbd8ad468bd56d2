"""Exact top-k search by inner product (method: vector-approximation file)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import materialize

LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor with a component that is null or not finite."""
    x = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def scaled(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, inside the range of a long."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(
        F.lit(float(scale)) * c.cast("double"), F.lit(-9.2e18)), F.lit(9.2e18))).cast("bigint"))


def inner(a: np.ndarray, b: np.ndarray) -> int:
    """Exact inner product of integers; the nearest long where it fits in none."""
    if max(np.abs(a).max(), np.abs(b).max()) < 1 << 27:
        return int(a @ b)
    return min(max(sum(x * y for x, y in zip(a.tolist(), b.tolist())), LONG[0]), LONG[1])


def scan_block(points: pd.DataFrame, queries: pd.DataFrame, k: int, low: int, width: int) -> pd.DataFrame:
    """Candidates of every query among the cells of one block, with bounds on their scores.

    A component in cell c lies in ``low + c * width`` and the ``width - 1`` integers above it, so one product with the cells' lower
    ends gives both bounds. A point is left out when k others are surely before it. Of points with one vector only the k + 1
    smallest ids can be wanted by any query.
    """
    points = points.sort_values(["same", "id"], kind="stable")
    points = points[points.groupby("same").cumcount() <= k].sort_values("id", kind="stable")
    ids = points["id"].to_numpy()
    cells = np.stack([np.frombuffer(c, np.uint8) for c in points["cells"]]).astype(np.float64)
    q = np.stack(queries["vec"].to_numpy()).astype(np.float64)
    floor = (q @ (cells.T * width)) + (q.sum(axis=1) * low)[:, None]
    up, down = (width - 1) * np.maximum(q, 0).sum(axis=1), (width - 1) * np.minimum(q, 0).sum(axis=1)
    slack = np.abs(floor).max(axis=1, initial=0.0) * 1e-12 if np.abs(floor).max(initial=0.0) > 2.0 ** 52 else np.zeros(len(q))
    out = []
    for row, (qid, qkey) in enumerate(zip(queries["qid"], queries["qkey"])):
        at = np.flatnonzero(ids != qid)
        value = floor[row, at]
        gap = up[row] - down[row] + 2 * slack[row]
        if len(at) > k:
            kth = np.partition(value, len(at) - k)[len(at) - k]
            keep = np.flatnonzero(value >= kth - gap)
            if gap == 0:  # bounds are scores: ties go to smaller ids, and ids ascend
                keep = keep[np.argsort(-value[keep], kind="stable")[:k]]
            at, value = at[keep], value[keep]
        out.append(pd.DataFrame({"qid": qid, "qkey": qkey, "id": ids[at], "pkey": points["pkey"].to_numpy()[at],
                                 "lower": value + down[row] - slack[row], "upper": value + up[row] + slack[row]}))
    return pd.concat(out, ignore_index=True)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "vec", cells: int = 256,
          block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """``(query_id, rank, id, score)``: the k largest inner products of every query with all rows but its own, ties to the smaller id.

    ``vec_col`` holds integers (``array<bigint>``). The approximation file has one byte a component: its cell of ``cells`` equal ones
    between the smallest and the largest component. Blocks of queries meet blocks of cells, and each pair keeps what its bounds cannot
    rule out; then exact vectors are read in order of upper bound: the first k of a query, and after them only those whose bound
    reaches the kth exact score. The result does not depend on ``cells``, which only sets how many exact vectors are read.

    Rows with a null id or an unusable vector take no part; vectors of different lengths have no score together; rows alike in id and vector
    count once, and rows that share only the id are never each other's candidates. Fewer candidates than k give them all.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec"))).withColumns({"n": F.size("vec"), "pkey": F.xxhash64("id", "vec")})
    ranges = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("asks").cast("int")).alias("asking"),
                                   F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high")).limit(1001).collect()
    if len(ranges) > 1000:
        raise ValueError("vectors of more than 1000 lengths")
    # Copies of a row would fill the places of other candidates.
    rows = rows.groupBy("id", "pkey").agg(F.first("vec").alias("vec"), F.max("asks").alias("asks")).withColumns(
        {"n": F.size("vec"), "same": F.xxhash64("vec")})
    shape = {r["n"]: (r["low"], -(-(r["high"] - r["low"] + 1) // cells)) for r in ranges}
    blocks = {r["n"]: -(-r["rows"] // block_rows) for r in ranges}
    askers = {r["n"]: max(1, -(-r["asking"] // query_rows)) for r in ranges}
    pick = lambda table: F.coalesce(*[F.when(F.col("n") == n, F.lit(v)) for n, v in table.items()], F.lit(1))

    @F.pandas_udf("binary")
    def cell_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([bytes(((int(x) - shape[len(v)][0]) // shape[len(v)][1] for x in v)) for v in batch], dtype=object)

    every = lambda table: F.explode(F.sequence(F.lit(0), pick(table) - 1))
    approximations = rows.select("n", "id", "pkey", "same", cell_bytes("vec").alias("cells"), F.pmod("pkey", pick(blocks)).cast("int").alias("block"))
    approximations = approximations.select("*", every(askers).alias("askers"))
    asked = rows.filter("asks").select("n", F.col("id").alias("qid"), F.col("pkey").alias("qkey"), "vec")
    dealt = asked.withColumn("askers", F.pmod("qkey", pick(askers)).cast("int")).select("*", every(blocks).alias("block"))

    def meet(key: tuple, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"qid": [], "qkey": [], "id": [], "pkey": [], "lower": [], "upper": []})
        return scan_block(points, queries, k, *shape[int(key[0])])

    keys = ["n", "block", "askers"]
    candidates = approximations.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
        meet, "qid bigint, qkey bigint, id bigint, pkey bigint, lower double, upper double")
    candidates = materialize(candidates, "va-candidates")
    each = Window.partitionBy("qid", "qkey")
    bound = (candidates.withColumn("r", F.row_number().over(each.orderBy(F.desc("lower"), "id", "pkey"))).filter(F.col("r") == k)
             .select("qid", "qkey", F.col("lower").alias("sure")))
    ordered = (candidates.join(bound, ["qid", "qkey"], "left").filter(F.col("sure").isNull() | (F.col("upper") >= F.col("sure")))
               .withColumn("r", F.row_number().over(each.orderBy(F.desc("upper"), "id", "pkey"))).drop("sure", "lower"))
    ordered = materialize(ordered, "va-order")

    @F.pandas_udf("bigint")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([inner(np.asarray(x), np.asarray(y)) for x, y in zip(a, b)], dtype="int64")

    def exact(pairs: DataFrame) -> DataFrame:
        read = pairs.join(rows.select("id", "pkey", "vec"), ["id", "pkey"])
        return (read.join(asked.select("qid", "qkey", F.col("vec").alias("asked")), ["qid", "qkey"])
                .select("qid", "qkey", "id", "pkey", product("asked", "vec").alias("score")))

    first = materialize(exact(ordered.filter(F.col("r") <= k)), "va-first")
    kth = first.groupBy("qid", "qkey").agg(F.min("score").alias("kth"))
    rest = ordered.filter(F.col("r") > k).join(kth, ["qid", "qkey"]).filter(F.col("upper") >= F.col("kth")).select("qid", "qkey", "id", "pkey")
    scores = first.unionByName(exact(rest))
    ranked = scores.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), "id", "pkey"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
