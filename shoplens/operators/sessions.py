"""Flattening of nested web sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import column_or_null, nested_or_null, row_key


def _part(df: DataFrame, flat: str, field: str, structs: tuple[str, str]) -> Column:
    """A flat column if there is one, else the field of the first struct present."""
    first, second = (nested_or_null(df, s, field, "string") for s in structs)
    if structs[0] in df.columns:
        nested = F.when(F.col(structs[0]).isNotNull(), first).otherwise(second)
    else:
        nested = second
    return F.coalesce(column_or_null(df, flat, "string"), nested)


def _json(df: DataFrame, name: str, kind: str, empty: str) -> Column:
    text = F.to_json(column_or_null(df, name, kind), {"ignoreNullFields": "false"})
    return F.coalesce(text, F.lit(empty))


def flatten_sessions(sessions: DataFrame) -> DataFrame:
    """Row key, user and the 16 stored columns of each session, typed, one row per session.

    Takes the nested form (``device_profile``/``device`` and ``geo_data``/``geo`` structs), flat
    columns, or a mix; a flat value wins.  ``load_order``, if present, is passed through.
    """
    df = sessions
    start = F.coalesce(
        column_or_null(df, "start_time", "string"), column_or_null(df, "timestamp", "string")
    )
    if "page_views" in df.columns and isinstance(df.schema["page_views"].dataType, T.ArrayType):
        viewed = F.when(F.col("page_views").isNotNull(), F.size("page_views"))
    else:
        viewed = F.lit(None).cast("int")
    device = ("device_profile", "device")
    geo = ("geo_data", "geo")
    columns = {
        "row_key": row_key(column_or_null(df, "user_id", "string"), start),
        "user_id": column_or_null(df, "user_id", "string"),
        "session_id": column_or_null(df, "session_id", "string"),
        "start_time": start,
        "end_time": column_or_null(df, "end_time", "string"),
        "duration": F.coalesce(
            column_or_null(df, "duration_seconds", "int"), column_or_null(df, "duration", "int")
        ),
        "conversion_status": column_or_null(df, "conversion_status", "string"),
        "referrer": column_or_null(df, "referrer", "string"),
        "device_type": _part(df, "device_type", "type", device),
        "device_os": _part(df, "device_os", "os", device),
        "browser": _part(df, "browser", "browser", device),
        "city": _part(df, "city", "city", geo),
        "state": _part(df, "state", "state", geo),
        "country": _part(df, "country", "country", geo),
        "ip_address": _part(df, "ip_address", "ip_address", geo),
        "viewed_products": _json(df, "viewed_products", "array<string>", "[]"),
        "cart_contents": _json(df, "cart_contents", "map<string,int>", "{}"),
        "page_views_count": F.coalesce(
            viewed, column_or_null(df, "page_views_count", "int"), F.lit(0)
        ),
    }
    kept = ["load_order"] if "load_order" in df.columns else []
    return df.select(*(value.alias(name) for name, value in columns.items()), *kept)
