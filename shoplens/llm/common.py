"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.sources import stored

__all__ = ["WORD", "arrow_column", "document_key", "held", "map_batches", "packed", "stored", "table", "word_count"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch.  Texts are handed to Python whole, so a batch stays small.
BATCH_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that columns added beside it cannot clash."""
    return F.struct(*[docs[f"`{name}`"] for name in docs.columns])


def document_key(text: str = "text") -> Column:
    """With doc_id, what tells two rows apart: equal ids with different texts stay different."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small; tell workers of a local session where this package lies.

    A cluster gets the package with the job (``--py-files``).
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[2])
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with small batches."""
    _prepare(df.sparkSession)
    return df.mapInArrow(function, schema)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """An object that a worker keeps from task to task, until it works for another operator.

    One at a time, so a worker that runs a whole pipeline does not gather what every stage remembered.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def arrow_column(
    spark: SparkSession, function: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], kind: str
) -> Callable[..., Column]:
    """A column function over batches of values; the other columns of a row stay in the JVM."""
    _prepare(spark)
    return F.arrow_udf(function, kind)
