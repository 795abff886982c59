"""Rows of differing keys as one table: the union of their keys, in order of first appearance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .sinks import write_ordered

PLACE = "place"


def _placed(rows: DataFrame, record: str, order_by: Sequence[str | Column]) -> DataFrame:
    """``place``, which grows in the order asked for, and the record; computed once and stored.

    Ranges over the order spread the sort; without an order the rows are numbered as they lie.  Each task leaves
    one file in order, and the files by number of their task are in order.
    """
    if order_by:
        rows = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return stored(
        rows.select(F.monotonically_increasing_id().alias(PLACE), F.col(f"`{record}`").alias("record")), "ragged-rows"
    )


def _file_by_file(placed: DataFrame) -> DataFrame:
    """The stored rows in one partition that reads one file after the other: nothing is sorted or held there."""

    def place(name: str) -> tuple[int, ...]:
        """Number of the task, and of the file where the session splits a task's rows."""
        task, *_, count = name.rsplit("/part-", 1)[-1].split(".")[0].split("-")
        return int(task), int(count.removeprefix("c"))

    names = sorted(map(unquote, placed.inputFiles()), key=place)
    runs = [placed.sparkSession.read.schema(placed.schema).parquet(name) for name in names]
    while len(runs) > 1:
        runs = [reduce(DataFrame.union, runs[i : i + 2]) for i in range(0, len(runs), 2)]
    # Without a shuffle, and all files in one file system, the partitions stay in the order of the union.
    return runs[0].coalesce(1)


def _keys_in_order(placed: DataFrame) -> list[str]:
    """The union of all records' keys, first those of the first row, then what later rows add.

    Rows of the same keys in the same order are one shape.  The first place of each shape is found by a hash
    aggregate, combined before the shuffle; what then remains is a row per shape and key.
    """
    shapes = (
        placed.where(F.size("record") > 0)
        .groupBy(F.map_keys("record").alias("keys"))
        .agg(F.min(PLACE).alias(PLACE))
    )
    keys = shapes.select(PLACE, F.posexplode("keys").alias("at", "key"))
    firsts = keys.groupBy("key").agg(F.min(F.struct(PLACE, "at")).alias("first"))
    # One row per column of the table to be written.
    return [row.key for row in firsts.orderBy("first").collect()]


def _columns(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return placed.select(PLACE, *(F.col("record")[F.lit(key)].alias(key) for key in keys))


def union_of_rows(rows: DataFrame, record: str, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """A column for every key that occurs in the map ``record``; a row without it has a null.

    Columns stand in the order in which the keys first appear when the rows are read in the order asked for.  A
    null record or one without keys is a row of nulls.  Keys that differ in case only are columns of their own
    where ``spark.sql.caseSensitive`` is on, and an error where it is off.
    """
    placed = _placed(rows, record, order_by)
    return _columns(placed, _keys_in_order(placed)).drop(PLACE)


def write_ragged(
    rows: DataFrame,
    path: str,
    record: str,
    order_by: Sequence[str | Column] = (),
    single_file: bool = False,
) -> list[str]:
    """Write rows of differing keys as CSV with one header; the names of its columns.

    ``record`` is a map from text to text.  Rows are written in the order asked for; a key a row lacks is empty
    in its line.  Without any row or key nothing is written and the target is left alone.  ``single_file`` is as
    in `write_result`.
    """
    placed = _placed(rows, record, order_by)
    keys = _keys_in_order(placed)
    if keys:
        columns = [F.col("record")[F.lit(key)].alias(key) for key in keys]
        if single_file:
            write_ordered(_file_by_file(placed), path, [], False, columns)
        else:
            # The place stays behind as the order of the rows; its name cannot be one of the keys.
            ordered = placed.select(F.col(PLACE).alias("_place"), "record")
            write_ordered(ordered, path, ["_place"], False, columns)
    return keys
