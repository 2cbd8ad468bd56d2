"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, items: Column, name: str, *keep: Column | str, position: str | None = None) -> DataFrame:
    """``keep`` and one row per array element.

    A plain ``explode`` makes the optimizer put ``size(array) > 0`` below it and push that down to the scan, which
    computes a costly array twice and copies its steps into its lambdas. The outer form with a test on the
    element afterwards gives the same rows without that. Elements must not be NULL.
    """
    outer = F.posexplode_outer(items).alias(position, name) if position else F.explode_outer(items).alias(name)
    return df.select(*keep, outer).filter(F.col(name).isNotNull())
