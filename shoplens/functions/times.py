"""Timestamps without a zone, months, and time bounds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_SECONDS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"


def parse_iso(text: Column) -> Column:
    """ISO text, fraction optional, to ``timestamp_ntz``; null if unreadable."""
    return text.try_cast("timestamp_ntz")


def parse_iso_seconds(text: Column) -> Column:
    """Exactly ``yyyy-MM-ddTHH:mm:ss`` to ``timestamp_ntz``; null for anything else."""
    return F.when(text.rlike(ISO_SECONDS), text.try_cast("timestamp_ntz"))


def timestamp_storage(df: DataFrame, column: str = "timestamp") -> str:
    """``'date'`` for a timestamp or date column, ``'string'`` for text; a schema check only."""
    stored = df.schema[column].dataType
    if isinstance(stored, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(stored, T.StringType):
        return "string"
    raise TypeError(f"column {column} holds {stored.simpleString()}, not a time")


def as_timestamp(df: DataFrame, column: str = "timestamp") -> Column:
    """The column as ``timestamp_ntz``, parsed if it is stored as text."""
    if timestamp_storage(df, column) == "string":
        return parse_iso(F.col(column))
    return F.col(column).cast("timestamp_ntz")


def month_text(df: DataFrame, column: str = "timestamp") -> Column:
    """``yyyy-MM``."""
    if timestamp_storage(df, column) == "string":
        return F.substring(column, 1, 7)
    return F.date_format(column, "yyyy-MM")


def month_key(df: DataFrame, column: str = "timestamp") -> Column:
    """What groups by month: months since year 0 as a number, or the month's text if time is text."""
    if timestamp_storage(df, column) == "string":
        return F.substring(column, 1, 7)
    return F.year(column) * 12 + F.month(column) - 1


def month_of_key(key: Column, as_text: bool) -> Column:
    """``yyyy-MM`` of a month key of either kind."""
    if as_text:
        return key
    label = F.format_string("%04d-%02d", F.floor(key / 12).cast("int"), key % 12 + 1)
    return F.when(key.isNotNull(), label)


def month_start(moment: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(moment, "month")


def month_index(month: Column, origin: Column) -> Column:
    """Whole months from one first-of-month date to another."""
    return F.floor(F.months_between(month, origin)).cast("bigint")


def parse_bound(text: str | None) -> datetime | None:
    """A time bound: ``yyyy-MM-dd`` is that day's midnight, otherwise ISO text.

    A bound that cannot be read is an error, never silently dropped.
    """
    if not text:
        return None
    bound = datetime.strptime(text, "%Y-%m-%d") if len(text) == 10 else datetime.fromisoformat(text)
    if bound.tzinfo is not None:
        raise ValueError(f"time bound {text!r} has a zone; the data has none")
    return bound
