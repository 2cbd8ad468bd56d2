"""Joins in which some keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there are fewer such keys than its inverse.
HOT_SHARE = 2048
#: Keys of no more rows than this are never hot.
TASK_ROWS = 8192


def salted_join(rows: DataFrame, rules: DataFrame, on: list[str], spread: Column, how: str = "inner",
                counts: DataFrame | None = None, share: int = HOT_SHARE, least: int = TASK_ROWS) -> DataFrame:
    """``rows`` joined with ``rules`` on the columns ``on``, so that no task gets more than about one in ``share`` of the rows by one key.

    Keys above that share, and of more than ``least`` rows, are dealt over salts by a hash of ``spread`` (any columns of ``rows`` that differ inside a key), and their rules
    are repeated once for each salt: at most ``2 * share`` rows in all, whatever the data. ``counts (*on, n)`` saves counting the keys
    of ``rows``. Both inputs are read twice, so they should be written tables. Keys should not be null.
    """
    counts = counts if counts is not None else rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter((F.col("n") > least) & (F.col("n") * share > total)).select(*on, F.ceil(F.col("n") * share / F.lit(max(total, 1))).cast("int").alias("_salts"))
    listed = hot.collect()
    if not listed:
        return rows.join(rules, on, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(listed, hot.schema))
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(few, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    copies = rules.join(few, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
