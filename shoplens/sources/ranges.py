"""Tables stored in ranges of their key.

Each range is a folder of its own, ordered by key inside, and the lower bounds of all ranges lie beside them.  So a
reader that wants the first rows opens the first ranges only, a key prefix opens the ranges it can lie in, and a load
rewrites only the ranges it touches.  The bounds never change after the table was made.  Their number is that of the
ranges, chosen by whoever makes the table; they are all that passes through the driver.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import latest_by_key
from .scratch import stored

RANGE = "key_range"
BOUNDS = "_bounds"
MOST_RANGES = 8192


class Bounds(NamedTuple):
    """The least key of each range, ascending, and the ranges' numbers."""

    least: list[str]
    numbers: list[int]

    def number_of(self, key: Column) -> Column:
        """The range of a key: the last one whose least key is not above it, else the first.  A binary search."""
        least = F.lit(self.least)
        low, high = F.lit(0), F.lit(len(self.least))

        def halve(state: Column, _: Column) -> Column:
            middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
            above = F.element_at(least, middle + 1) > key
            lower = F.when(above, state["low"]).otherwise(middle)
            upper = F.when(above, middle).otherwise(state["high"])
            done = state["high"] - state["low"] <= 1
            return F.when(done, state).otherwise(F.struct(lower.alias("low"), upper.alias("high")))

        steps = F.sequence(F.lit(1), F.lit(max(1, len(self.least).bit_length())))
        found = F.reduce(steps, F.struct(low.alias("low"), high.alias("high")), halve)
        return F.element_at(F.lit(self.numbers), found["low"] + 1)

    def with_prefix(self, prefix: str) -> list[int]:
        """The ranges that may hold keys that begin with a text; the first one also holds what is below all bounds."""
        first = max(bisect_left(self.least, prefix) - 1, 0)
        last = bisect_right(self.least, prefix + chr(0x10FFFF))
        return self.numbers[first : max(last, first + 1)]


def write_ranges(df: DataFrame, path: str, ranges: int, key: str = "row_key", tie: str = "session_id") -> Bounds:
    """Store rows in at most ``ranges`` ranges of (key, tie), replacing what lies at ``path``.

    Keys are text.  One that is on very many rows is cut at ``tie`` and then begins several ranges.
    """
    if not 1 <= ranges <= MOST_RANGES:
        raise ValueError(f"between 1 and {MOST_RANGES} ranges")
    dealt = df.repartitionByRange(ranges, key, tie).withColumn(RANGE, F.spark_partition_id())
    ordered = dealt.sortWithinPartitions(RANGE, key, tie)
    ordered.write.mode("overwrite").partitionBy(RANGE).parquet(path)
    spark = df.sparkSession
    fields = T.StructType([*df.schema.fields, T.StructField(RANGE, T.IntegerType())])
    least = spark.read.schema(fields).parquet(path).groupBy(RANGE).agg(F.min(key).alias("least"))
    rows = sorted((row[RANGE], row["least"] or "") for row in least.collect()) or [(0, "")]
    found = Bounds([least for _, least in rows], [number for number, _ in rows])
    spark.createDataFrame([(*found, fields.json())], _BESIDE).coalesce(1).write.mode("overwrite").json(f"{path}/{BOUNDS}")
    return found


_BESIDE = "least array<string>, numbers array<int>, fields string"


def bounds_of(spark: SparkSession, path: str) -> Bounds:
    row = spark.read.schema(_BESIDE).json(f"{path}/{BOUNDS}").first()
    return Bounds(list(row.least), list(row.numbers))


def _table(spark: SparkSession, path: str) -> DataFrame:
    """The table with the schema it was made with, so that no file is opened for it."""
    row = spark.read.schema(_BESIDE).json(f"{path}/{BOUNDS}").first()
    return spark.read.schema(T.StructType.fromJson(json.loads(row.fields))).parquet(path)


def read_ranges(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """The whole table with its ``key_range``, or only the ranges that may hold keys with a prefix."""
    table = _table(spark, path)
    if prefix is None:
        return table
    return table.where(F.col(RANGE).isin(bounds_of(spark, path).with_prefix(prefix)))


def first_ranges(spark: SparkSession, path: str, wanted: Column, limit: int) -> DataFrame:
    """The table cut after the first ranges that together hold ``limit`` wanted rows.

    Ranges are opened in order, each time twice as many, until the limit is met; a scan of the whole table is the
    worst case.  Sorting and limiting what this returns gives the same rows as sorting and limiting the table.
    """
    table = _table(spark, path)
    numbers = bounds_of(spark, path).numbers
    opened, found, step = 0, 0, 1
    while opened < len(numbers) and found < limit:
        some = numbers[opened : opened + step]
        found += table.where(F.col(RANGE).isin(some)).where(wanted).limit(limit - found).count()
        opened, step = opened + len(some), step * 2
    return table.where(F.col(RANGE).isin(numbers[:opened]))


def merge_ranges(
    spark: SparkSession,
    path: str,
    load: DataFrame,
    key: str = "row_key",
    tie: str = "session_id",
    load_order: str = "load_order",
    unkeyed: Column | None = None,
) -> list[int]:
    """Put a load into the table: its newest row of each key replaces the stored one; the ranges rewritten.

    ``unkeyed`` tells rows whose key is none (never null): all of them stay, once for each ``tie``.  Ranges the
    load does not touch are neither read nor written.  Spark replaces the touched folders when all of their
    rows are written; running the same load again changes nothing.
    """
    unkeyed = F.lit(False) if unkeyed is None else unkeyed
    number = bounds_of(spark, path).number_of(F.col(key))
    newest = latest_by_key(load, [key], F.col(load_order), always=unkeyed).drop(load_order)
    arriving = stored(newest.withColumn(RANGE, number), "arriving")
    touched = sorted(row[0] for row in arriving.select(RANGE).distinct().collect())
    if not touched:
        return []
    table = _table(spark, path)
    old = table.where(F.col(RANGE).isin(touched))
    keyed = arriving.where(~unkeyed).select(F.col(key).alias("_key"))
    others = arriving.where(unkeyed).select(F.col(key).alias("_key"), F.col(tie).alias("_tie"))
    kept = old.join(keyed, F.col(key) == F.col("_key"), "left_anti").join(
        others, (F.col(key) == F.col("_key")) & F.col(tie).eqNullSafe(F.col("_tie")), "left_anti"
    )
    merged = kept.unionByName(arriving.select(*table.columns))
    # Ranges over (range, key, tie) cut a range with very many rows into several files.
    dealt = merged.repartitionByRange(RANGE, key, tie).sortWithinPartitions(RANGE, key, tie)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(RANGE).parquet(path)
    return touched
