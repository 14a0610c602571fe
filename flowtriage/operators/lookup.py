"""Dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def lookup_with_default(df: DataFrame, dimension: DataFrame, on: list[str], value: str, default: Column) -> DataFrame:
    """Left lookup of ``value``; keys without an entry get ``default``.

    No broadcast hint: the measured size of the dimension decides, and a
    dimension that outgrows the threshold still joins by shuffle.
    """
    return df.join(dimension.select(*on, value), on, "left").withColumn(value, F.coalesce(F.col(value), default))


def members(df: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in ``allowed``."""
    return df.join(allowed.select(*on), on, "left_semi")
