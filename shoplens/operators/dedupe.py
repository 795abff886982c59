"""Keeping one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def basket_items(line_items: DataFrame) -> DataFrame:
    """The distinct ``(transaction_id, product_id)`` pairs; rows with a null in either are dropped."""
    keys = ["transaction_id", "product_id"]
    return line_items.select(*keys).na.drop(subset=keys).dropDuplicates(keys)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(field.dataType) for field in kind.fields)
    return not isinstance(kind, T.MapType)


def latest_by_key(
    df: DataFrame, keys: Sequence[str], load_order: Column, always: Column | None = None
) -> DataFrame:
    """The row with the greatest ``load_order`` of each key: what repeated puts leave behind.

    Rows are dealt out once by key, load order and a hash of their content, so no task gets all versions of a
    hot key.  From that shuffle a narrow aggregate, combined before its own small shuffle, finds each key's
    newest version, and the same shuffle is read again for the rows that carry it.  With a load order of a
    fixed width (a number or a time) both aggregates are hash aggregates.  Of several rows with the greatest
    load order those of one content stay; a null key is a key, a null load order never the newest.

    Rows for which ``always`` holds (never null) are kept in the same pass, whatever their key.
    """
    hashed = [f.name for f in df.schema.fields if _hashable(f.dataType)]
    content = F.xxhash64(*(F.col(f"`{name}`") for name in hashed))

    def version(at: Column, of: Column) -> Column:
        return F.struct(F.struct(*keys).alias("key"), at.alias("at"), of.alias("content"))

    mine = version(load_order, content)
    dealt = df.repartition(mine)
    # Within the aggregates, not before them: a filter would move below the shuffle, which then had to be made twice.
    order = load_order if always is None else F.when(~always, load_order)
    newest = (
        dealt.groupBy(*keys)
        .agg(F.max(order).alias("_at"), F.max_by(content, order).alias("_content"))
        .select(version(F.col("_at"), F.col("_content")).alias("_newest"))
    )
    if always is None:
        return dealt.join(newest, mine == F.col("_newest"), "left_semi")
    found = dealt.join(newest, mine == F.col("_newest"), "left")
    return found.where(always | F.col("_newest").isNotNull()).drop("_newest")
