"""Loading of session chunks that may grow or be sent again.

A file stream knows a file by its name and never looks at it again.  Here progress goes by file and place in the
file: a chunk whose length or time has changed is read once more, and only the elements beyond the places taken
before are added.  So a chunk sent again adds nothing, and one that grew adds its new tail.

Each run is a batch with a number.  Its rows replace the folder of that number, then its progress is written; a run
that was lost half way is done over under the same number, so its rows are there once.  Progress has a row per file
and stays in Spark; only the names of the files to be read pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import flatten_sessions
from ..sources import schemas, stored
from ..sources.batches import finished_batches
from ..sources.collections import CHUNKS, UNREAD, session_elements, with_unread

BATCH = "load_batch"
PROGRESS = "_progress"
LOOKUPS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LOOKUPS_PER_CORE = 3
PROGRESS_FIELDS = "file string, length long, time timestamp, places long"


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _progress(spark: SparkSession, target: str, batches: list[str]) -> DataFrame:
    """What is known of each file after the last batch that looked at it."""
    if not batches:
        return spark.createDataFrame([], PROGRESS_FIELDS)
    schema = f"{PROGRESS_FIELDS}, {BATCH} int"
    written = spark.read.schema(schema).option("basePath", f"{target}/{PROGRESS}").parquet(*batches)
    # Times and places of a file never go back, so each column's value is that of its newest batch.
    newest = [F.max_by(name, BATCH).alias(name) for name in ("length", "time", "places")]
    return written.groupBy("file").agg(*newest)


def _changed(spark: SparkSession, folder: str, pattern: str, known: DataFrame) -> DataFrame:
    """Files not seen before, or with another length or time: their state now, and the places taken of them."""
    # Without the content column this source only lists.
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    now = listed.select(
        "path", _name(F.col("path")).alias("file"), "length", F.col("modificationTime").alias("time")
    )
    old = known.select("file", F.col("length").alias("old_length"), F.col("time").alias("old_time"), "places")
    both = now.join(old, "file", "left")
    same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("time").eqNullSafe(F.col("old_time"))
    taken = F.coalesce("places", F.lit(0).cast("long")).alias("places")
    return both.where(~same).select("path", "file", "length", "time", taken)


def ingest_growing_sessions(
    spark: SparkSession,
    folder: str,
    target: str,
    schema: str | T.StructType = schemas.SESSIONS_ANY,
    pattern: str = CHUNKS,
    max_files: int = 10_000,
) -> DataFrame:
    """Add what is new in the chunks of ``folder`` to the table ``target``; the table so far.

    Chunks and layouts are those of `ingest_sessions`; ``load_order`` is the batch, the file name and the place
    in the file.  A chunk is known by its name: what counts is how many of its elements were taken.  One that
    shrank adds nothing until it is longer than before.  A chunk that is no JSON array adds nothing; once it is
    mended it is read from its start.  A batch takes at most ``max_files`` files; a run makes as many as it needs.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    while True:
        batches = finished_batches(spark, f"{target}/{PROGRESS}", BATCH)
        number = len(batches)
        changed = stored(_changed(spark, folder, pattern, _progress(spark, target, batches)), "changed-chunks")
        # The folder is listed once for all these batches, which take its files in order of their names.
        last = None
        while True:
            left = changed if last is None else changed.where(F.col("file") > last)
            some = left.orderBy("file", "path").limit(max_files).select("path", "file").collect()
            if not some:
                break
            paths, last = [row.path for row in some], some[-1].file
            files = spark.createDataFrame([(path,) for path in paths], "path string")
            _load(spark, changed.join(files, "path", "left_semi"), paths, fields, target, number)
            number += 1
        if last is None:
            break
    if not batches:
        rows = _fresh(spark.createDataFrame([], with_unread(fields)).withColumn("_file", F.lit("")), fields, 0)
        return spark.createDataFrame([], rows.schema)
    return spark.read.option("basePath", target).parquet(*(f"{target}/{BATCH}={k}" for k in range(number))).drop(BATCH)


def _fresh(chunks: DataFrame, fields: T.StructType, number: int) -> DataFrame:
    """Flat sessions with their place in the file, which starts at 0."""
    elements = session_elements(chunks, F.col("_file"), fields)
    in_file = Window.partitionBy("load_order.file").orderBy("load_order.row", "element")
    placed = elements.withColumn("place", F.row_number().over(in_file).cast("long") - 1)
    order = F.struct(F.lit(number).cast("long").alias("batch"), F.col("load_order.file").alias("file"), "place")
    return flatten_sessions(placed.select("record.*", order.alias("load_order")))


def _read(spark: SparkSession, paths: list[str], fields: T.StructType) -> DataFrame:
    """The records of some files; they are looked up by a few tasks a core, where Spark takes a task per file."""
    reader = spark.read.schema(with_unread(fields)).options(multiLine=True, columnNameOfCorruptRecord=UNREAD)
    before = spark.conf.get(LOOKUPS, None)
    spark.conf.set(LOOKUPS, str(LOOKUPS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        return reader.json(paths)
    finally:
        if before is None:
            spark.conf.unset(LOOKUPS)
        else:
            spark.conf.set(LOOKUPS, before)


def _load(
    spark: SparkSession, changed: DataFrame, paths: list[str], fields: T.StructType, target: str, number: int
) -> None:
    chunks = _read(spark, paths, fields).select("*", F.col("_metadata.file_name").alias("_file"))
    taken = changed.select(F.col("file").alias("_taken_file"), F.col("places").alias("_taken"))
    rows = _fresh(chunks, fields, number)
    new = rows.join(taken, F.col("load_order.file") == F.col("_taken_file")).where("load_order.place >= _taken")
    folder = f"{target}/{BATCH}={number}"
    new.drop("_taken_file", "_taken").write.mode("overwrite").parquet(folder)
    added = (
        spark.read.schema(rows.schema)
        .parquet(folder)
        .groupBy("load_order.file")
        .agg((F.max("load_order.place") + 1).alias("reached"))
    )
    progress = changed.join(added, "file", "left").select(
        "file", "length", "time", F.coalesce("reached", "places").alias("places")
    )
    progress.coalesce(1).write.mode("overwrite").parquet(f"{target}/{PROGRESS}/{BATCH}={number}")
