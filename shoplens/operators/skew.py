"""Joins whose hot keys are known before the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = 1000  # keys the sketch follows; what it calls hot is among them
MOST_HOT = 64


def hot_keys(df: DataFrame, key: str, share: float) -> Column:
    """The keys on more than ``share`` of the rows, as an array: a scalar subquery with at most MOST_HOT of them.

    A sketch of heavy hitters, combined before its one row is shuffled.  It may leave out a key near the limit or
    name one that is just below it; a key on several times that many rows is never left out.
    """
    if not 1 / TRACKED < share <= 1:
        raise ValueError(f"a share above {1 / TRACKED}")
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k({key}, {MOST_HOT}, {TRACKED})").alias("top"), F.count("*").alias("n")
    )
    hot = F.transform(F.filter("top", lambda one: one["count"] > share * F.col("n")), lambda one: one["item"])
    return sketch.select(F.coalesce(hot, F.array()).alias("hot")).scalar()


def join_hot(left: DataFrame, right: DataFrame, key: str, salts: int = 32, share: float = 0.01) -> DataFrame:
    """``left`` with the columns of ``right`` of the same ``key``, null where there is none.

    Rows of a hot key are dealt out over ``salts`` parts, and its rows on the right are repeated for each of them;
    other keys have one part.  So no task joins more than a part of a hot key, whatever adaptive execution does,
    and the right side grows by at most MOST_HOT times ``salts`` times the rows of a key there.  Rows without a key
    match nothing and are dealt out as well.  ``left`` is read twice, the first time for its key only.
    """
    hot = hot_keys(left, key, share)
    spread = F.col(key).isNull() | F.array_contains(hot, F.col(key))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    parts = F.when(F.array_contains(hot, F.col(key)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.withColumn("_salt", F.when(spread, part).otherwise(0))
    repeated = right.where(F.col(key).isNotNull()).withColumn("_salt", F.explode(parts))
    return dealt.join(repeated, [key, "_salt"], "left").drop("_salt")
