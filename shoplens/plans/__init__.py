"""The analytic queries: DataFrames in, one DataFrame out."""

from .baskets import also_bought, copurchase_totals
from .cohorts import cohort_retention
from .customers import (
    avg_transaction,
    customer_scatter,
    customer_segments,
    customer_value,
    customer_value_from_items,
    segment_users,
    transaction_totals,
    user_segmentation,
)
from .distribution import value_distribution_box, value_histogram
from .items import line_items
from .products import category_timeline, revenue_by_category, top_products
from .sessions import (
    converted_sessions,
    current_sessions,
    device_distribution,
    has_key,
    keyless_sessions,
    user_sessions,
)

__all__ = [
    "also_bought",
    "avg_transaction",
    "category_timeline",
    "cohort_retention",
    "converted_sessions",
    "copurchase_totals",
    "current_sessions",
    "customer_scatter",
    "customer_segments",
    "customer_value",
    "customer_value_from_items",
    "device_distribution",
    "has_key",
    "keyless_sessions",
    "line_items",
    "revenue_by_category",
    "segment_users",
    "top_products",
    "transaction_totals",
    "user_segmentation",
    "user_sessions",
    "value_distribution_box",
    "value_histogram",
]
