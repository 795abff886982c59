"""Reading result files back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.coerce import coerce_numeric


def read_result_csv(
    spark: SparkSession, path: str, columns: Sequence[str], numeric: Sequence[str] = ()
) -> DataFrame:
    """A CSV result with a header; rows whose ``numeric`` columns are not numbers are dropped.

    The named columns are picked by header and read as text, so there is no inference pass.
    """
    text = spark.read.csv(path, header=True, escape='"').select(*columns)
    return coerce_numeric(text, *numeric) if numeric else text
