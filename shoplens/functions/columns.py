"""Access to fields a data set may or may not carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_or_null(df: DataFrame, name: str, data_type: str) -> Column:
    """``df[name]``, or a typed null where the schema has no such column."""
    if name in df.columns:
        return F.col(name)
    return F.lit(None).cast(data_type)


def nested_or_null(df: DataFrame, name: str, field: str, data_type: str) -> Column:
    """``name.field``, or a typed null where the struct or the field is missing.

    A column that is not a struct counts as missing.
    """
    if name in df.columns:
        struct = df.schema[name].dataType
        if isinstance(struct, T.StructType) and field in struct.fieldNames():
            return F.col(name)[field]
    return F.lit(None).cast(data_type)
