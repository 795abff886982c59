"""Product and category revenue (quantity times unit price)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import month_key, month_of_key, timestamp_storage, total
from ..operators import coerce_numeric, in_time_range, line_total_parts, order_lines
from ..operators.lines import line_quantity
from .lookup import BROADCAST_ROWS


def top_products(
    transactions: DataFrame,
    products: DataFrame,
    start: str | None = None,
    end: str | None = None,
    limit: int = 20,
    storage: str = "auto",
) -> DataFrame:
    """The products with most revenue, then most units.

    ``product_id, product_name, category_id, total_qty, total_revenue, orders``.  Lines are added up
    by product, already in the map tasks, and only the lines of the ``limit`` winners are shuffled to
    count their distinct orders; up to BROADCAST_ROWS winners are sent to the lines.  Counting
    distinct orders makes Spark aggregate by product and order first, which spreads a product found
    in every other line over all tasks.
    """
    if start or end:
        transactions = in_time_range(transactions, start, end, storage=storage)
    lines = order_lines(transactions)
    totals = (
        lines.select(
            "product_id", line_quantity().alias("qty"), line_total_parts(lines).alias("revenue")
        )
        .groupBy("product_id")
        .agg(F.sum("qty").alias("total_qty"), F.sum("revenue").alias("revenue"))
    )
    ranking = [F.col("revenue").desc(), F.col("total_qty").desc(), F.col("product_id")]
    best = totals.orderBy(*ranking).limit(limit).withColumnRenamed("product_id", "winner")
    if limit <= BROADCAST_ROWS:
        best = F.broadcast(best)
    orders = (
        lines.select("product_id", "transaction_id")
        .join(best, F.col("product_id").eqNullSafe(F.col("winner")))
        .groupBy("product_id", "total_qty", "revenue")
        .agg(F.count_distinct("transaction_id").alias("orders"))
    )
    names = products.select("product_id", F.col("name").alias("product_name"), "category_id")
    return (
        orders.join(names, "product_id", "left")
        .orderBy(*ranking)
        .select(
            "product_id",
            "product_name",
            "category_id",
            "total_qty",
            total(totals, "revenue").alias("total_revenue"),
            "orders",
        )
    )


def revenue_by_category(
    transactions: DataFrame,
    products: DataFrame,
    start: str | None = None,
    end: str | None = None,
    categories: DataFrame | None = None,
    headers: DataFrame | None = None,
    storage: str = "auto",
) -> DataFrame:
    """Revenue per category and month: ``category_id, year_month, revenue[, category_name]``.

    Revenue is added up per product and month before products are joined, so the join sees no
    popular product twice in a month.  Unknown products form the null category.  Category names are
    added when ``categories`` is given.  Lines without a time take it from ``headers``; what then
    meets them is the order, the product and one amount of each line, and a number for the month.
    """
    if headers is None:
        chosen = in_time_range(transactions, start, end, storage=storage)
        lines = order_lines(chosen)
        lines = lines.select(
            "product_id", month_key(chosen).alias("month"), line_total_parts(lines).alias("revenue")
        )
    else:
        chosen = in_time_range(headers, start, end, storage=storage)
        months = chosen.select("transaction_id", month_key(chosen).alias("month"))
        lines = order_lines(transactions)
        lines = lines.select("transaction_id", "product_id", line_total_parts(lines).alias("revenue"))
        lines = lines.join(months, "transaction_id")
    as_text = timestamp_storage(chosen) == "string"
    monthly = lines.groupBy("product_id", "month").agg(F.sum("revenue").alias("revenue"))
    revenue = (
        monthly.join(products.select("product_id", "category_id"), "product_id", "left")
        .groupBy("category_id", "month")
        .agg(F.sum("revenue").alias("revenue"))
        .select(
            "category_id",
            month_of_key(F.col("month"), as_text).alias("year_month"),
            total(monthly, "revenue").alias("revenue"),
        )
    )
    columns = ["category_id", "year_month", "revenue"]
    if categories is not None:
        names = categories.select("category_id", F.col("name").alias("category_name"))
        revenue = revenue.join(names, "category_id", "left")
        columns.append("category_name")
    return revenue.select(*columns).orderBy("category_id", "year_month")


def category_timeline(revenue: DataFrame) -> DataFrame:
    """Revenue over time for a chart: ``category_name, month, revenue``, ordered by month.

    The category id stands in where there is no name; rows without a revenue number are dropped.
    """
    label = F.col("category_id").cast("string")
    if "category_name" in revenue.columns:
        label = F.coalesce("category_name", label)
    return (
        coerce_numeric(revenue, "revenue")
        .select(
            label.alias("category_name"),
            F.to_date(F.concat("year_month", F.lit("-01"))).alias("month"),
            "revenue",
        )
        .orderBy("month", "category_name")
    )
