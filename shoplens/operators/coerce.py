"""Numeric coercion of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import to_number


def coerce_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Turn the columns into doubles and drop the rows where one of them is not a number.

    Columns that already are numbers keep their type, so a typed frame pays only the null filter.
    """
    texts = {
        c: to_number(F.col(c)) for c in columns if isinstance(df.schema[c].dataType, T.StringType)
    }
    return df.withColumns(texts).na.drop(subset=list(columns))


def top_values(df: DataFrame, label: str, value: str, n: int = 10) -> DataFrame:
    """The ``n`` rows with the greatest numeric ``value``, smallest first, as a bar chart wants them."""
    best = coerce_numeric(df, value).orderBy(F.col(value).desc(), label).limit(n)
    return best.orderBy(value, F.col(label).desc())
