"""Distinct, union and difference."""

from __future__ import annotations

from pyspark.sql import DataFrame


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """By column name, duplicates kept."""
    return a.unionByName(b)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` not in ``b``; Catalyst plans it as an anti join."""
    return a.subtract(b)
