"""Reusable DataFrame operators the plans are made of."""

from .checks import duplicate_keys, table_counts, unparsed_timestamps
from .coerce import coerce_numeric, top_values
from .dedupe import basket_items, latest_by_key
from .distribution import box_stats, exact_quantiles, histogram
from .lines import in_time_range, line_total_parts, order_lines
from .sessions import flatten_sessions
from .skew import hot_keys, join_hot

__all__ = [
    "basket_items",
    "box_stats",
    "coerce_numeric",
    "duplicate_keys",
    "exact_quantiles",
    "flatten_sessions",
    "histogram",
    "hot_keys",
    "in_time_range",
    "join_hot",
    "latest_by_key",
    "line_total_parts",
    "order_lines",
    "table_counts",
    "top_values",
    "unparsed_timestamps",
]
