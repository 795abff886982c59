"""Data checks: row counts, key uniqueness, unreadable timestamps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse_iso


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``(table, rows)`` per table."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their number; empty if the key is unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def unparsed_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many non-null texts of each column are not ISO timestamps, as one row."""
    return df.agg(
        *(F.count_if(F.col(c).isNotNull() & parse_iso(F.col(c)).isNull()).alias(c) for c in columns)
    )
