"""Collections whose key is unique: what a load brings twice, or again, is set aside and counted.

Beside the rows lies an index of the keys taken so far, in folders by hash of the key.  A load looks its keys up there;
only keys are joined, the rows themselves are neither sorted nor sent to the index.  Rows, what was set aside and new
keys are written as one batch, the keys last: a batch counts once they are there, and a load that was lost half way is
done over under the same number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import finished_batches
from .scratch import stored

BATCH = "load"
KEYS = "_keys"
ASIDE = "_set_aside"
BUCKETS = 256


class Load(NamedTuple):
    """What became of the rows of a load."""

    taken: int
    repeated: int  # in the load itself
    known: int  # from an earlier load
    without_key: int


def _numbers(spark: SparkSession, path: str) -> int:
    return len(finished_batches(spark, f"{path}/{KEYS}", BATCH))


def load_unique(df: DataFrame, path: str, key: str, order_by: str | None = None) -> Load:
    """Add rows whose ``key`` is new to the collection at ``path``.

    Of the rows of one key in the load the first stays: by ``order_by`` (a number or time that is never null), or as
    they lie.  A key on very many rows is combined before the shuffle and sends one row per task.
    """
    spark = df.sparkSession
    number = _numbers(spark, path)
    placed = stored(df.withColumn("_row", F.monotonically_increasing_id()), "arriving-rows")
    keyed = placed.where(F.col(key).isNotNull())
    first = F.min("_row") if order_by is None else F.min_by("_row", order_by)
    bucket = F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    firsts = keyed.groupBy(F.col(key).alias("_key")).agg(first.alias("_first")).select("*", bucket)
    if number:
        kind = df.schema[key].dataType.simpleString()
        index = _read(spark, f"{path}/{KEYS}", number, f"_key {kind}, {BATCH} int, bucket int")
        taken_before = index.select("bucket", "_key", F.lit(True).alias("known"))
        firsts = firsts.join(taken_before, ["bucket", "_key"], "left")
    else:
        firsts = firsts.withColumn("known", F.lit(None).cast("boolean"))
    firsts = stored(firsts.select("_key", "_first", "bucket", F.coalesce("known", F.lit(False)).alias("known")), "keys")

    new = firsts.where(~F.col("known"))
    winners = new.select(F.col("_first").alias("_row"))
    placed.join(winners, "_row", "left_semi").drop("_row").write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
    others = placed.join(winners, "_row", "left_anti")
    # A row that is no winner is the first of a known key, or comes after the first of its key.
    of_known = firsts.where("known").select(F.col("_key").alias("_known_key"))
    why = F.when(F.col(key).isNull(), "without key").when(F.col("_known_key").isNotNull(), "known").otherwise("repeated")
    aside = others.join(of_known, F.col(key) == F.col("_known_key"), "left").withColumn("reason", why)
    aside.drop("_row", "_known_key").write.mode("overwrite").parquet(f"{path}/{ASIDE}/{BATCH}={number}")
    new.select("_key", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/{KEYS}/{BATCH}={number}"
    )
    counts = spark.read.schema(aside.drop("_row", "_known_key").schema).parquet(f"{path}/{ASIDE}/{BATCH}={number}")
    by_reason = {row.reason: row["count"] for row in counts.groupBy("reason").count().collect()}
    return Load(new.count(), *(by_reason.get(reason, 0) for reason in ("repeated", "known", "without key")))


def _read(spark: SparkSession, root: str, number: int, schema: str | None = None) -> DataFrame:
    """The first ``number`` batches under a folder."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("basePath", root).parquet(*(f"{root}/{BATCH}={k}" for k in range(number)))


def read_unique(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished loads."""
    return _read(spark, path, _numbers(spark, path)).drop(BATCH)


def set_aside(spark: SparkSession, path: str) -> DataFrame:
    """The rows that were not taken: with ``reason`` and the number of their ``load``."""
    return _read(spark, f"{path}/{ASIDE}", _numbers(spark, path))
