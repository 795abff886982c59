"""Column helpers shared by the operators: money, time, text and optional fields."""

from .columns import column_or_null, nested_or_null
from .money import amount, cents, decimals, dollars, exact_amount, parts, total
from .text import row_key, row_key_part, row_key_user, to_number
from .times import (
    as_timestamp,
    month_index,
    month_key,
    month_of_key,
    month_start,
    month_text,
    parse_bound,
    parse_iso,
    parse_iso_seconds,
    timestamp_storage,
)

__all__ = [
    "amount",
    "as_timestamp",
    "cents",
    "column_or_null",
    "decimals",
    "dollars",
    "exact_amount",
    "month_index",
    "month_key",
    "month_of_key",
    "month_start",
    "month_text",
    "nested_or_null",
    "parse_bound",
    "parse_iso",
    "parse_iso_seconds",
    "parts",
    "row_key",
    "row_key_part",
    "row_key_user",
    "timestamp_storage",
    "to_number",
    "total",
]
