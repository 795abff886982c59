"""Text helpers: session row keys and numeric coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of a row key and the spellings read as a number.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"
ROW_KEY_DROPPED = r"[^0-9A-Za-z_\-:.T]"
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+|inf|infinity)(e[+-]?\d+)?\s*$"


def row_key_part(text: Column) -> Column:
    """White space runs, of any script, become ``_``; other unsafe characters go; null becomes ''."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    cleaned = F.regexp_replace(F.regexp_replace(text, WHITE_SPACE, "_"), ROW_KEY_DROPPED, "")
    # Nearly all parts are clean already; one search finds that out.
    return F.when(text.rlike(ROW_KEY_DROPPED), cleaned).otherwise(text)


def row_key(user_id: Column, start_time: Column) -> Column:
    """``<user>_<start>``, the key under which a session is stored."""
    return F.concat_ws("_", row_key_part(user_id), row_key_part(start_time))


def row_key_user(key: Column) -> Column:
    """The user part of a row key: its first two ``_`` separated pieces."""
    return F.substring_index(key, "_", 2)


def to_number(text: Column) -> Column:
    """Text to double; null for whatever is not a plain number.

    The pattern comes first because a cast alone accepts a type suffix such as ``5d``.
    """
    text = text.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
