"""What customers are worth and how they split into groups.

Three revenues exist side by side and are not interchangeable: `customer_value` adds order totals
after discount, `customer_value_from_items` adds line subtotals before discount, and
`user_segmentation` (like the product reports) adds quantity times unit price.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import amount, as_timestamp, cents, decimals, dollars, exact_amount, timestamp_storage, total
from ..operators import coerce_numeric, exact_quantiles, in_time_range, line_total_parts, order_lines

# The default boundaries and the names of the levels.
DEFAULT_BOUNDARIES = (0, 1, 3, 5, 10, 1000)
SPENDING_LEVELS = ("Low", "Medium", "High", "Premium")
FREQUENCY_LEVELS = ("Occasional", "Regular", "Frequent", "VIP")


def customer_value(transactions: DataFrame, ordered: bool = True) -> DataFrame:
    """Revenue, orders and active span per user, by revenue descending.

    ``user_id, total_revenue, num_orders, first_purchase, last_purchase, active_days``.  Pass
    ``ordered=False`` when the result feeds another query.
    """
    moments = transactions.select(
        "user_id",
        "transaction_id",
        cents(F.col("total")).alias("total"),
        as_timestamp(transactions).alias("ts"),
    )
    value = (
        moments.groupBy("user_id")
        .agg(
            F.sum("total").alias("total"),
            F.count_distinct("transaction_id").alias("num_orders"),
            F.min("ts").alias("first_purchase"),
            F.max("ts").alias("last_purchase"),
        )
        .select(
            "user_id",
            dollars(F.col("total")).alias("total_revenue"),
            "num_orders",
            "first_purchase",
            "last_purchase",
            F.datediff("last_purchase", "first_purchase").alias("active_days"),
        )
    )
    return value.orderBy(F.col("total_revenue").desc(), "user_id") if ordered else value


def customer_value_from_items(
    line_items: DataFrame, headers: DataFrame | None = None
) -> DataFrame:
    """Sum of line subtotals and number of orders per user: ``user_id, clv, num_orders``.

    Lines that do not carry ``user_id`` themselves take it from ``headers`` (``transaction_id,
    user_id``); they are then added up per order before the join.
    """
    scale = decimals(line_items, ["subtotal"])
    lines = line_items.withColumn("subtotal", exact_amount(F.col("subtotal"), scale))
    orders = F.count_distinct("transaction_id")
    if headers is not None:
        per_order = lines.groupBy("transaction_id").agg(F.sum("subtotal").alias("subtotal"))
        lines = per_order.join(headers.select("transaction_id", "user_id"), "transaction_id")
        orders = F.count("*")  # one row per order by now
    value = lines.groupBy("user_id").agg(F.sum("subtotal").alias("clv"), orders.alias("num_orders"))
    return value.select("user_id", total(value, "clv").alias("clv"), "num_orders").orderBy(
        F.col("clv").desc(), "user_id"
    )


def transaction_totals(
    transactions: DataFrame,
    start: str | None = None,
    end: str | None = None,
    headers: DataFrame | None = None,
    storage: str = "auto",
) -> DataFrame:
    """Money per order: ``transaction_id, user_id, created_at, tx_total`` (in parts of a cent, or a finer decimal).

    Takes order documents, or lines.  Lines without user and time take them from ``headers``; their
    sums are then formed before the join, so a huge order is one row when it meets its header.
    """
    if headers is None:
        lines = order_lines(in_time_range(transactions, start, end, storage=storage))
        # An order has one user; as a key, unlike as a minimum of text, it keeps the aggregate hashed.
        return lines.groupBy("transaction_id", "user_id").agg(
            F.min(as_timestamp(lines)).alias("created_at"),
            F.sum(line_total_parts(lines)).alias("tx_total"),
        )
    lines = order_lines(transactions)
    sums = lines.groupBy("transaction_id").agg(F.sum(line_total_parts(lines)).alias("tx_total"))
    chosen = in_time_range(headers, start, end, storage=storage)
    return sums.join(
        chosen.select("transaction_id", "user_id", as_timestamp(chosen).alias("created_at")),
        "transaction_id",
    ).select("transaction_id", "user_id", "created_at", "tx_total")


def _bucket(count: Column, boundaries: Sequence[int]) -> Column:
    """Lower bound of the bucket a count falls in; null outside all of them."""
    lowers = F.lit(None).cast("int")
    for low, high in pairwise(boundaries):
        lowers = F.when((count >= low) & (count < high), F.lit(low)).otherwise(lowers)
    return lowers


def segment_users(
    totals: DataFrame, boundaries: Sequence[int] = DEFAULT_BOUNDARIES
) -> DataFrame:
    """Users grouped by number of orders; buckets are closed below and open above.

    ``bucket, customers, avg_orders, avg_spend, max_last_order_at``, ordered by bucket.  Counts outside
    the boundaries go to ``other``, which comes last; empty buckets do not appear.
    """
    boundaries = list(boundaries)
    if len(boundaries) < 2 or any(a >= b for a, b in pairwise(boundaries)):
        raise ValueError("boundaries must be at least two ascending numbers")
    users = totals.groupBy("user_id").agg(
        F.count("*").alias("orders"),
        F.sum("tx_total").alias("spend"),
        F.max("created_at").alias("last_order_at"),
    )
    customers = F.count("*")
    exact = isinstance(totals.schema["tx_total"].dataType, T.DecimalType)
    spend = F.sum("spend").cast("double") if exact else amount(F.sum("spend"))
    return (
        users.groupBy(_bucket(F.col("orders"), boundaries).alias("lower"))
        .agg(
            customers.alias("customers"),
            (F.sum("orders") / customers).alias("avg_orders"),
            (spend / customers).alias("avg_spend"),
            F.max("last_order_at").alias("max_last_order_at"),
        )
        .orderBy(F.col("lower").asc_nulls_last())
        .select(
            F.coalesce(F.col("lower").cast("string"), F.lit("other")).alias("bucket"),
            "customers",
            "avg_orders",
            "avg_spend",
            "max_last_order_at",
        )
    )


def user_segmentation(
    transactions: DataFrame,
    start: str | None = None,
    end: str | None = None,
    boundaries: Sequence[int] = DEFAULT_BOUNDARIES,
    headers: DataFrame | None = None,
    storage: str = "auto",
) -> DataFrame:
    """`segment_users` over the orders of a time range."""
    segments = segment_users(transaction_totals(transactions, start, end, headers, storage), boundaries)
    if timestamp_storage(transactions if headers is None else headers) == "string":
        # Times are aggregated as such, and given back as the ISO text they came as.
        text = F.replace(F.col("max_last_order_at").cast("string"), F.lit(" "), F.lit("T"))
        segments = segments.withColumn("max_last_order_at", text)
    return segments


def avg_transaction(value: DataFrame) -> DataFrame:
    """Adds ``avg_transaction``, revenue per order, after dropping rows without numbers."""
    clean = coerce_numeric(value, "total_revenue", "num_orders")
    return clean.withColumn("avg_transaction", F.col("total_revenue") / F.col("num_orders"))


def customer_scatter(value: DataFrame) -> DataFrame:
    """``num_orders, total_revenue, active_days`` of every customer with numbers."""
    clean = coerce_numeric(value, "total_revenue", "num_orders")
    return clean.select("num_orders", "total_revenue", "active_days")


def customer_segments(value: DataFrame) -> DataFrame:
    """Customers by spending quartile (rows) and order count quartile (columns).

    Quartile edges are interpolated and closed on the right.  Equal edges make the quartiles
    meaningless and raise.  All sixteen counts come from one aggregate, so every level has its row.
    """
    measures = ("total_revenue", "num_orders")
    clean = coerce_numeric(value, *measures).select(*measures)
    edges = exact_quantiles(clean, measures, (0.0, 0.25, 0.5, 0.75, 1.0))
    edges = edges.select(F.struct(*measures).alias("edges"))
    data = clean.select(*measures, edges.scalar().alias("edges"))

    def level(measure: str) -> str:
        e, x = f"edges.{measure}", measure
        return f"""case
            when size(array_distinct({e})) < 5
                then cast(raise_error('quartile edges of {measure} are not unique') as int)
            when {x} <= {e}[1] then 0 when {x} <= {e}[2] then 1 when {x} <= {e}[3] then 2 else 3 end"""

    levelled = data.selectExpr(f"{level(measures[0])} as s", f"{level(measures[1])} as f")

    def row(i: int, spending: str) -> str:
        counts = (
            f"count_if(s = {i} and f = {j}) as {frequency}"
            for j, frequency in enumerate(FREQUENCY_LEVELS)
        )
        return f"struct('{spending}' as spending, {', '.join(counts)})"

    rows = ", ".join(row(i, spending) for i, spending in enumerate(SPENDING_LEVELS))
    return levelled.agg(F.expr(f"array({rows}) as rows")).selectExpr("inline(rows)")
