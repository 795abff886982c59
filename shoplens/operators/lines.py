"""Order lines: unnesting, line totals, time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import column_or_null, decimals, exact_amount, parse_bound, parse_iso, timestamp_storage

HEADER_FIELDS = {"transaction_id": "string", "user_id": "string", "timestamp": "timestamp_ntz"}
LINE_FIELDS = {
    "product_id": "string",
    "quantity": "int",
    "unit_price": "double",
    "price": "double",
    "subtotal": "double",
    "line_total": "double",
}


def order_lines(transactions: DataFrame) -> DataFrame:
    """One row per order line, with its transaction's id, user and time.

    Documents with an ``items`` array are unnested; a null or empty array gives no row.  A frame
    without ``items`` is taken to hold lines already.  Fields the data lacks become typed nulls,
    which the optimizer removes again where nothing reads them.
    """
    if "items" not in transactions.columns:
        return transactions.select(
            *(
                column_or_null(transactions, name, kind).alias(name)
                for name, kind in (HEADER_FIELDS | LINE_FIELDS).items()
            )
        )
    header = [
        column_or_null(transactions, name, kind).alias(name) for name, kind in HEADER_FIELDS.items()
    ]
    element = transactions.schema["items"].dataType.elementType
    assert isinstance(element, T.StructType), "items must be an array of structs"
    fields = [
        (F.col("item")[name] if name in element.fieldNames() else F.lit(None).cast(kind)).alias(name)
        for name, kind in LINE_FIELDS.items()
    ]
    return transactions.select(*header, F.explode("items").alias("item")).select(
        *HEADER_FIELDS, *fields
    )


def line_quantity() -> Column:
    """Quantity of a line; 0 when missing."""
    return F.coalesce(F.col("quantity").cast("bigint"), F.lit(0).cast("bigint"))


def line_total_parts(lines: DataFrame | None = None) -> Column:
    """``line_total ?? quantity * (unit_price ?? price ?? 0)``, in parts of a cent.

    Given the ``lines``, whose prices are decimals of more than four places, the total is a decimal of that
    scale instead; other prices among them are rounded to it.
    """
    scale = None if lines is None else decimals(lines, ("unit_price", "price", "line_total"))
    known = [exact_amount(F.col(name), scale) for name in ("unit_price", "price")]
    nothing = F.lit(0).cast("bigint") if scale is None else exact_amount(F.lit(0), scale)
    quantity = line_quantity() if scale is None else line_quantity().cast("decimal(10,0)")
    return F.coalesce(exact_amount(F.col("line_total"), scale), quantity * F.coalesce(*known, nothing))


def in_time_range(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    column: str = "timestamp",
    storage: str = "auto",
) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive, either optional.

    A ten character bound means midnight, so ``end='2025-12-31'`` leaves out that day's later hours.
    Text columns are compared as text, which for ISO text gives the same order.  The comparison is
    with a literal and reaches the Parquet scan.  A frame with an ``order_month`` column next to
    ``timestamp`` is limited by month as well, which prunes the folders of a stored table.  ``storage``
    overrides the kind of comparison: ``date`` parses text, ``string`` compares a time as ISO text.
    """
    if storage not in ("auto", "date", "string"):
        raise ValueError("storage must be auto, date or string")
    bounds = {"start": (start, parse_bound(start)), "end": (end, parse_bound(end))}
    kind = timestamp_storage(df, column)
    as_text = storage == "string" or (storage == "auto" and kind == "string")
    moments = F.col(column)
    if as_text and kind != "string":
        moments = F.date_format(moments, "yyyy-MM-dd'T'HH:mm:ss")
    elif not as_text and kind == "string":
        moments = parse_iso(moments)
    for side, (text, moment) in bounds.items():
        if moment is None:
            continue
        bound = F.lit(text) if as_text else F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
        month = F.lit(moment.strftime("%Y-%m"))
        by_month = column == "timestamp" and "order_month" in df.columns
        if side == "start":
            df = df.where(moments >= bound)
            df = df.where(F.col("order_month") >= month) if by_month else df
        else:
            df = df.where(moments <= bound)
            df = df.where(F.col("order_month") <= month) if by_month else df
    return df
