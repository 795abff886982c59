"""Session reports over flat sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import row_key_user
from ..operators import latest_by_key

ORDER = ("row_key", "session_id")


def current_sessions(loaded: DataFrame) -> DataFrame:
    """The last loaded session of each row key, from a table that only ever grew.

    Two sessions of one user that start in the same second share a key; the later load replaces the
    earlier one.  Sessions without a user or a start have no key of their own: all of them are kept, and
    `keyless_sessions` counts them.
    """
    return latest_by_key(loaded, ["row_key"], F.col("load_order"), always=~has_key()).drop("load_order")


def has_key() -> Column:
    """Whether a row key names both a user and a start."""
    key = F.col("row_key")
    return F.coalesce(~(key.startswith("_") | key.endswith("_")), F.lit(False))


def keyless_sessions(loaded: DataFrame) -> DataFrame:
    """How many sessions lack a user or a start: one row, ``sessions``."""
    return loaded.where(~has_key()).agg(F.count("*").alias("sessions"))


def user_sessions(sessions: DataFrame, user_id: str, limit: int = 10) -> DataFrame:
    """The first sessions of one user in start order, found by row key prefix.

    On a table stored by `write_sessions` the prefix is pushed into the Parquet scan.
    """
    return (
        sessions.where(F.col("row_key").startswith(f"{user_id}_"))
        .orderBy(*ORDER)
        .limit(limit)
        .select(
            "row_key",
            "session_id",
            "start_time",
            "duration",
            "conversion_status",
            "device_type",
            "browser",
            "city",
            "state",
            F.col("page_views_count").alias("page_views"),
        )
    )


def converted_sessions(
    sessions: DataFrame, limit: int = 10, scan_limit: int | None = None
) -> DataFrame:
    """The first converted sessions of all, or among the first ``scan_limit`` row keys only."""
    seen = sessions.select(
        "row_key",
        "session_id",
        "start_time",
        "duration",
        "device_type",
        "referrer",
        "conversion_status",
    )
    if scan_limit is not None:
        seen = seen.orderBy(*ORDER).limit(scan_limit)
    return (
        seen.where(F.col("conversion_status") == "converted")
        .orderBy(*ORDER)
        .limit(limit)
        .select(
            "row_key",
            row_key_user(F.col("row_key")).alias("user_id"),
            "session_id",
            "start_time",
            "duration",
            "device_type",
            "referrer",
        )
    )


def device_distribution(
    sessions: DataFrame, sample_size: int | None = None, missing_label: str = ""
) -> DataFrame:
    """Sessions per device type with their share in percent: ``device_type, sessions, pct``.

    All sessions count unless ``sample_size`` asks for the first so many row keys.  The total is a
    scalar subquery over the per-device counts, whose shuffle both uses share.
    """
    if sample_size is not None:
        sessions = sessions.orderBy(*ORDER).limit(sample_size)
    device = F.coalesce("device_type", F.lit(missing_label)).alias("device_type")
    counts = sessions.select(device).groupBy("device_type").agg(F.count("*").alias("sessions"))
    total = counts.agg(F.sum("sessions")).scalar()
    return counts.select(
        "device_type", "sessions", (F.col("sessions") / total * 100).alias("pct")
    ).orderBy(F.col("sessions").desc(), "device_type")
