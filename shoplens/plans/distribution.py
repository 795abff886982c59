"""Distributions of customer value, the data behind the sales charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import box_stats, histogram
from .customers import avg_transaction

# Number of bins of each chart.
BINS = {"total_revenue": 50, "num_orders": 30, "avg_transaction": 50}


def value_histogram(value: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Histogram of ``total_revenue``, ``num_orders`` or ``avg_transaction``."""
    return histogram(avg_transaction(value), column, bins or BINS[column])


def value_distribution_box(value: DataFrame) -> DataFrame:
    """Box statistics of revenue, orders times 1000, and average transaction side by side."""
    wide = avg_transaction(value).select(
        "total_revenue",
        (F.col("num_orders") * 1000).alias("orders_x1000"),
        "avg_transaction",
    )
    return box_stats(wide, wide.columns)
