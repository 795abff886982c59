"""Writing results and session tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..functions import month_text
from .scratch import stored


def write_result(
    df: DataFrame,
    path: str,
    order_by: Sequence[str | Column] = (),
    single_file: bool = False,
    skip_empty: bool = False,
) -> bool:
    """Write a result as CSV with a header, replacing the target; says whether it wrote.

    ``single_file`` sends the result through one task and is meant for reports of bounded size, such
    as a top-k.  The sort then happens inside that one partition, so the file is ordered for certain.
    Otherwise a global sort spreads the ordered rows over many files.  ``skip_empty`` leaves the
    target alone when there are no rows; the result is then computed into scratch space, looked at and copied.
    """
    if skip_empty:
        df = stored(df, "result")
        if df.isEmpty():
            return False
    write_ordered(df, path, order_by, single_file)
    return True


def write_ordered(
    df: DataFrame,
    path: str,
    order_by: Sequence[str | Column],
    single_file: bool,
    columns: Sequence[str | Column] = ("*",),
) -> None:
    """Write ``columns`` as CSV, ordered by what need not be among them."""
    if single_file:
        df = df.repartition(1)
        if order_by:
            df = df.sortWithinPartitions(*order_by)
    elif order_by:
        df = df.orderBy(*order_by)
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def write_sessions(sessions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store flat sessions ordered by row key, so that a key prefix touches few row groups.

    Ranges over key and session id split a user with very many sessions, and even a key loaded very
    many times.
    """
    keys = ["row_key", "session_id"]
    ordered = sessions.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode(mode).parquet(path)


def write_line_items(line_items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store line items in one folder per month, so that a time range reads only its months.

    `in_time_range` knows the ``order_month`` column this adds.  Ranges over month, transaction and
    product give each task few months to write and split a month or an order with very many lines.
    """
    monthly = line_items.withColumn("order_month", month_text(line_items))
    ranged = monthly.repartitionByRange("order_month", "transaction_id", "product_id")
    ranged.write.mode(mode).partitionBy("order_month").parquet(path)
