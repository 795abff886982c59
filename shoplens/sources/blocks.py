"""Large JSON arrays read by many tasks, on however few lines they stand.

A file is cut at every ``}``, which Spark's text source does at any offset of the file, so a single line of many
gigabytes becomes as many splits as its size asks for.  Which of these pieces end an element of the array is then
worked out with two prefix sums over the pieces: quotes, whose parity tells what lies inside a string, and brackets
outside strings, whose sum is the nesting level.  An element that is an object ends where a ``}`` leads back to level
one.  Each prefix sum is taken within the splits and over the sums of the splits, so no task sees a whole file; a
piece that begins in one split and ends in another belongs to whoever the sums say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collections import array_elements

#: Escaped characters, a string or what is left of one, the rest of a string a piece begins in.
ESCAPED = r"(?s)\\."
STRING = r'(?s)"[^"]*("|$)'
BEGUN_STRING = r'(?s)^[^"]*("|$)'
_SPLIT = ("file", "split")


def _running(value: str) -> Column:
    """The sum of the pieces before, over a file: those of the split, on top of the splits before."""
    inside = Window.partitionBy(*_SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.coalesce("before", F.lit(0))


def _with_sums(pieces: DataFrame, value: str, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over all earlier pieces of the file."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.groupBy(*_SPLIT).agg(F.sum(value).alias("sum"))
    before = splits.withColumn("before", F.sum("sum").over(earlier)).drop("sum")
    return pieces.join(before, list(_SPLIT)).withColumn(into, _running(value)).drop("before")


def _pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every piece of text that a ``}`` ends (the last one ends with the file), with its place."""
    lines = spark.read.options(lineSep="}", **options).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def _levelled(pieces: DataFrame) -> DataFrame:
    """Pieces with the level behind their ``}``, and whether that bracket stands outside strings."""
    bare = F.regexp_replace("value", ESCAPED, "")
    quotes = F.regexp_count(bare, F.lit('"')).cast("long")
    counted = _with_sums(pieces.withColumn("quotes", quotes), "quotes", "quotes_before")
    inside = F.col("quotes_before") % 2 == 1
    begun = F.when(inside, F.regexp_replace(bare, BEGUN_STRING, "")).otherwise(bare)
    outside = F.regexp_replace(begun, STRING, "")
    structural = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    opens = F.regexp_count(outside, F.lit(r"[\[{]")) - F.regexp_count(outside, F.lit(r"\]"))
    change = (opens - structural.cast("int")).cast("long")
    changed = counted.select(*_SPLIT, "row", "value", structural.alias("structural"), change.alias("change"))
    summed = _with_sums(changed, "change", "level_before")
    return summed.withColumn("level", F.col("level_before") + F.col("change"))


def read_array_blocks(spark: SparkSession, path: str, schema: str | T.StructType, **options) -> DataFrame:
    """The objects in array files, with ``file`` and ``place``, which grows along each file.

    Other elements are skipped.  A file that is no array, or ends before its array does, raises.  What Spark
    splits can be split: a compressed file is one split, and still right.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    levelled = _levelled(_pieces(spark, path, **options))
    # The last piece of a sound file ends without a bracket, which was counted all the same.
    files = levelled.groupBy("file").agg((F.sum("change") == -1).alias("balanced"))
    ends = levelled.withColumn("ends", (F.col("structural") & (F.col("level") == 1)).cast("long"))
    grouped = _with_sums(ends, "ends", "place")
    piece = F.struct("split", "row", F.concat("value", F.lit("}")).alias("text"))
    elements = grouped.groupBy("file", "place").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("ends").alias("ended")
    )
    elements = elements.join(files, "file")
    whole = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    text = F.regexp_replace(whole, r"^\s*[\[,]\s*", "")
    plain = F.from_json(text, fields, {"mode": "FAILFAST"})
    # What stands before an object, or between two, is looked at only where there is something.
    alone = text.startswith("{")
    among = F.element_at(array_elements(F.concat(F.lit("["), text, F.lit("]")), fields), -1)
    begun = (F.col("place") > 0) | whole.rlike(r"^\s*\[")
    ended = (F.col("ended") == 1) | whole.rlike(r"\]\s*\}$")
    sound = F.col("balanced") & begun & ended
    problem = F.concat(F.lit("not a JSON array: "), F.col("file"))
    checked = elements.select(
        "file",
        "place",
        "ended",
        F.when(~sound, F.raise_error(problem).cast(fields))
        .when(F.col("ended") == 0, F.lit(None).cast(fields))
        .when(alone, plain)
        .otherwise(among)
        .alias("record"),
    )
    # The condition on the record keeps the check of a file's end from being left out.
    return checked.where((F.col("ended") == 1) | F.col("record").isNotNull()).select("file", "place", "record.*")
