"""Incremental file loading with Structured Streaming.

Each run takes the files that arrived since the last one and stops.  The stream's checkpoint
remembers what is done, so a restart neither skips nor repeats a file, and a task or executor lost
half way leaves no partial output behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import flatten_sessions
from ..sources import schemas
from ..sources.collections import CHUNKS, UNREAD, session_elements, with_unread

FILE = "_file"
BATCH = "load_batch"


def ingest_files(
    spark: SparkSession,
    folder: str,
    schema: str | T.StructType,
    target: str,
    checkpoint: str,
    file_format: str = "json",
    pattern: str = "*",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    max_files_per_batch: int | None = None,
    **options,
) -> None:
    """Append the new files of ``folder`` that match ``pattern`` to the Parquet table ``target``."""
    reader = spark.readStream.format(file_format).schema(schema)
    reader = reader.option("pathGlobFilter", pattern).options(**options)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    arriving = reader.load(folder)
    if transform is not None:
        arriving = transform(arriving)
    query = (
        arriving.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_sessions(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    schema: str | T.StructType = schemas.SESSIONS_ANY,
    pattern: str = CHUNKS,
) -> DataFrame:
    """Load new ``sessions_*.json`` chunks as flat sessions and return the table so far.

    A chunk is one JSON array, which the JSON source parses as it reads it; one task per chunk.  The default
    schema has every spelling of the fields that flattening accepts.  A chunk that holds elements other than
    objects is parsed once more, element by element.  A chunk that is no JSON array adds nothing to the table;
    `broken_chunks` lists it.  Each batch replaces its own folder of the table, so a replayed batch leaves its
    rows once; progress and table belong together.  ``load_order`` is the number of the batch, the file name
    and the place in the file.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    chunks = (
        spark.readStream.schema(with_unread(fields))
        .options(multiLine=True, columnNameOfCorruptRecord=UNREAD, pathGlobFilter=pattern)
        .json(folder)
        .select("*", F.col("_metadata.file_name").alias(FILE))
    )

    def store(batch: DataFrame, number: int) -> None:
        elements = session_elements(batch, F.col(FILE), fields)
        order = F.struct(F.lit(number).cast("bigint").alias("batch"), "load_order.*", "element")
        flat = flatten_sessions(elements.select("record.*", order.alias("load_order")))
        flat.write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")

    query = (
        chunks.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target).drop(BATCH)


def broken_chunks(spark: SparkSession, folder: str, pattern: str = CHUNKS) -> DataFrame:
    """The chunks of a folder that are no JSON arrays: ``file`` and how their text begins."""
    chunks = (
        spark.read.schema(with_unread(T.StructType.fromDDL("session_id string")))
        .options(multiLine=True, columnNameOfCorruptRecord=UNREAD, pathGlobFilter=pattern)
        .json(folder)
    )
    # The source wants a field of its own to be asked for beside the text it gave up on.
    chunks = chunks.where(F.col("session_id").isNull())
    unread = chunks.select(F.col("_metadata.file_name").alias("file"), F.col(UNREAD).alias("text"))
    return unread.where(F.col("text").isNotNull() & F.from_json("text", "array<string>").isNull()).select(
        "file", F.substring("text", 1, 80).alias("begins")
    )
