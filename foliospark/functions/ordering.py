"""Ranks and running sums inside groups of any size.

A plain ``Window.partitionBy(group)`` puts a whole group into one task, and one label may hold a third of the
table. The helpers here cut a group into buckets that keep the wanted order, add up the buckets, and leave to the
window only one bucket at a time. The bucket is a function of the row's values, so a recomputed task agrees with
the first run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_DIGITS = 3  # 16^3 buckets
SPLIT_DEPTH = 10  # 2^10 - 1 splits


def seeded_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle order: the md5 of key and seed, the same in every engine."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, group: list[str], order: str, ties: list[str], name: str = "rank",
              at_most: Column | None = None, digits: int = HASH_BUCKET_DIGITS) -> DataFrame:
    """1-based rank inside ``group`` by the md5 column ``order``, ties broken by ``ties``.

    The leading digits of a hash cut every group into even buckets. ``at_most`` (an expression over the group size
    ``_n``) keeps only ranks up to it; buckets wholly beyond it are dropped before the sort. The bucket table has
    at most (number of groups x 16^digits) rows: meant for labels and categories, not for millions of groups.
    """
    keyed = df.withColumn("_b", F.substring(order, 1, digits))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    over_group = Window.partitionBy(*group)
    offsets = counts.select(
        *group, "_b",
        (F.sum("_c").over(over_group.orderBy("_b")) - F.col("_c")).alias("_before"),
        F.sum("_c").over(over_group).alias("_n"),
    )
    if at_most is not None:
        offsets = offsets.withColumn("_limit", at_most).filter("_before < _limit")
    local = Window.partitionBy(*group, "_b").orderBy(order, *ties)
    ranked = (
        keyed.join(offsets, [*group, "_b"])
        .withColumn(name, F.row_number().over(local) + F.col("_before"))
    )
    if at_most is not None:
        ranked = ranked.filter(F.col(name) <= F.col("_limit"))
    return ranked.drop("_b", "_before", "_limit")


def with_value_bucket(df: DataFrame, group: list[str], value: str, depth: int = SPLIT_DEPTH) -> DataFrame:
    """Add ``_bucket``: the position of ``value`` among 2^depth - 1 quantiles of its group.

    Quantiles follow the data, so a crowd of values in a narrow range is split like any other. A group's splits are
    one short array; groups must be few (classes).
    """
    points = 2 ** depth
    shares = F.array(*[F.lit(i / points) for i in range(1, points)])
    splits = df.groupBy(*group).agg(F.percentile_approx(value, shares, F.lit(4 * points)).alias("_splits"))
    # binary search: the largest k with splits[k-1] <= value
    position = F.aggregate(
        F.array(*[F.lit(2 ** k) for k in reversed(range(depth))]), F.lit(0),
        lambda at, step: F.when(F.get("_splits", at + step - 1) <= F.col(value), at + step).otherwise(at),
    )
    return df.join(F.broadcast(splits), group).withColumn("_bucket", position).drop("_splits")


def with_even_bucket(df: DataFrame, group: list[str], value: str, depth: int = 6) -> DataFrame:
    """Add ``_bucket``, which rises with the time ``value``: its place among quantiles of the whole table, then of its own group there.

    For groups that are many, such as accounts. Each pass cuts by at most 2^depth - 1 points: the first by
    one short array for the table, the second by one for each group and span that has more than 2^depth rows. A crowd of rows of one group in one span is so cut 2^depth ways.
    """
    cuts = [i / 2 ** depth for i in range(1, 2 ** depth)]
    numbered = df.withColumn("_v", F.col(value).cast("timestamp").cast("double"))
    points = numbered.agg(F.percentile_approx("_v", cuts, 4 * 2 ** depth)).first()[0] or []
    place = lambda array: F.size(F.filter(array, lambda p: p <= F.col("_v")))
    coarse = numbered.withColumn("_a", place(F.array(*[F.lit(x) for x in points])) if points else F.lit(0))
    busy = (coarse.groupBy(*group, "_a").agg(F.count(F.lit(1)).alias("_c"), F.percentile_approx("_v", cuts, 4 * 2 ** depth).alias("_own"))
            .filter(F.col("_c") > 2 ** depth).drop("_c"))
    cut = coarse.join(busy, [*group, "_a"], "left")
    fine = F.when(F.col("_own").isNull(), F.lit(0)).otherwise(place(F.col("_own")))
    return cut.withColumn("_bucket", F.col("_a").cast("bigint") * 2 ** (depth + 1) + fine).drop("_v", "_a", "_own")


def first_ranks(keys: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """The rows of ``keys`` among the first ``n`` of their group by ``order``; whole buckets beyond ``n`` are dropped unsorted.

    Groups are few (classes); each is cut at its own quantiles.
    """
    cut = with_value_bucket(keys, group, order)
    counts = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    near = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).filter(F.col("_before") < n).drop("_c")
    local = Window.partitionBy(*group, "_bucket").orderBy(order)
    ranked = cut.join(near, [*group, "_bucket"]).withColumn("_rank", F.row_number().over(local) + F.col("_before"))
    return ranked.filter(F.col("_rank") <= n).select(*group, order)


def global_rank(keys: DataFrame, group: list[str], order: str, name: str = "rank") -> DataFrame:
    """1-based rank of every row inside its group by ``order``; only one bucket between two quantiles is sorted at a time. Groups are few."""
    cut = with_value_bucket(keys, group, order)
    counts = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*group, "_bucket").orderBy(order)
    ranked = cut.join(offsets, [*group, "_bucket"]).withColumn(name, F.row_number().over(local) + F.col("_before"))
    return ranked.drop("_bucket", "_before")


def running_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], sums: dict[str, str],
                 descending: bool = False) -> DataFrame:
    """Running sums inside ``group``: ``sums`` maps a value column to the name of its running total.

    ``bucket`` must rise with ``order`` (or fall with it when ``descending``): bucket totals are summed over the
    buckets of a group, rows only inside their bucket.
    """
    totals = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    edge = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*group).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *group, bucket,
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    local = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(totals, [*group, bucket])
    for c, name in sums.items():
        joined = joined.withColumn(name, F.sum(c).over(local) + F.col(f"_o_{c}"))
    return joined.drop(*[f"_o_{c}" for c in sums])
