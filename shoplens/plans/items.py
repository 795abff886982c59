"""Normalised line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_timestamp
from ..operators import join_hot, order_lines


def line_items(transactions: DataFrame, products: DataFrame, salts: int = 0) -> DataFrame:
    """One row per order line with product name and category.

    ``transaction_id, user_id, timestamp, product_id, quantity, unit_price, subtotal, product_name,
    category_id``.  Lines of an unknown product are kept with null name and category.  Nothing is
    hinted: Spark broadcasts the products while they are below its threshold and otherwise shuffles,
    splitting a product that holds too many lines.  With ``salts`` the products that hold more than a hundredth
    of the lines are looked for first and dealt out over so many parts: see `join_hot`.
    """
    lines = order_lines(transactions)
    typed = lines.select(
        "transaction_id",
        "user_id",
        as_timestamp(lines).alias("timestamp"),
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("unit_price").cast("double").alias("unit_price"),
        F.col("subtotal").cast("double").alias("subtotal"),
    )
    names = products.select("product_id", F.col("name").alias("product_name"), "category_id")
    joined = join_hot(typed, names, "product_id", salts) if salts else typed.join(names, "product_id", "left")
    return joined.select(
        *typed.columns, "product_name", "category_id"
    )
