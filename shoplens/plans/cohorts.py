"""Monthly cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_timestamp, month_index, month_start


def cohort_retention(transactions: DataFrame) -> DataFrame:
    """Share of each first-purchase month's users who buy again in each later month.

    ``cohort_month, cohort_index, active_users, cohort_size, retention_rate``.

    A user's orders become the set of months they fall in, already in the map tasks, so a user with
    a third of all orders weighs no more than the number of months there are.  The earliest of the set
    is the cohort: neither a join back to the orders nor a distinct count is left to do.
    """
    month = month_start(as_timestamp(transactions)).alias("month")
    ordered = transactions.select("user_id", month).na.drop()
    users = ordered.groupBy("user_id").agg(F.collect_set("month").alias("months"))
    active = (
        users.select(F.array_min("months").alias("cohort_month"), F.explode("months").alias("month"))
        .groupBy(
            "cohort_month",
            month_index(F.col("month"), F.col("cohort_month")).alias("cohort_index"),
        )
        .agg(F.count("*").alias("active_users"))
    )
    # At most one row per pair of months from here on.
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("active_users"))).over(
        Window.partitionBy("cohort_month")
    )
    return (
        active.withColumn("cohort_size", size)
        .withColumn("retention_rate", F.col("active_users") / F.col("cohort_size"))
        .orderBy("cohort_month", "cohort_index")
    )
