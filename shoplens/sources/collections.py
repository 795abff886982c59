"""JSON collections: arrays of objects or JSON lines.

An array file is read by one task, however large, since only its parser knows where an object ends.
JSON lines split at any size.  For repeated use load a collection into Parquet once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

LAYOUTS = ("auto", "array", "lines")
CHUNKS = "sessions_*.json"
UNREAD = "_unread"


def _struct(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _find(spark: SparkSession, pattern: str):
    """The file system a path or pattern names, and what matches there; nothing is an error."""
    location = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(location)
    if not found:
        raise FileNotFoundError(f"nothing to read at {pattern}")
    return fs, found


def _starts_with_bracket(spark: SparkSession, path: str) -> bool:
    """Look at the first byte of the (first) file."""
    fs, (first, *_) = _find(spark, path)
    target = first.getPath()
    if first.isDirectory():
        inside = [s.getPath() for s in fs.listStatus(target) if s.isFile()]
        data = [p for p in inside if not p.getName().startswith(("_", "."))]
        if not data:
            raise FileNotFoundError(f"no files in {path}")
        target = min(data, key=lambda p: p.getName())
    stream = fs.open(target)
    try:
        return stream.read() == ord("[")
    finally:
        stream.close()


def _read_lines(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    return spark.read.schema(schema).options(mode="FAILFAST", **options).json(path)


def array_elements(text: Column, schema: T.StructType) -> Column:
    """The objects in the text of a JSON array, in order; other elements are skipped.

    Text that is no array raises, and so does an object that does not fit the schema.
    """
    elements = F.from_json(text, "array<string>")
    objects = F.transform(
        F.filter(elements, lambda e: F.ltrim(e).startswith("{")),
        lambda e: F.from_json(e, schema, {"mode": "FAILFAST"}),
    )
    problem = F.concat(F.lit("not a JSON array: "), F.substring(text, 1, 80))
    return F.when(elements.isNotNull(), objects).otherwise(
        F.raise_error(problem).cast(T.ArrayType(schema))
    )


def with_unread(schema: T.StructType) -> T.StructType:
    """The schema with a column for the text of a file the JSON source gave up on."""
    return T.StructType([*schema.fields, T.StructField(UNREAD, T.StringType())])


def _records(schema: T.StructType, elements: Column) -> Column:
    """The records of a row of the JSON source: itself, or the elements of a file it gave up on."""
    names = [f"`{name}`" for name in schema.fieldNames()]
    return F.when(F.col(UNREAD).isNull(), F.array(F.struct(*names))).otherwise(elements)


def session_elements(chunks: DataFrame, file: Column, schema: T.StructType) -> DataFrame:
    """``load_order`` (file and row), ``element`` and ``record`` of chunks read with `with_unread`.

    A chunk that is no JSON array gives nothing.
    """
    readable = F.from_json(UNREAD, "array<string>").isNotNull()
    elements = F.when(readable, array_elements(F.col(UNREAD), schema))
    order = F.struct(file.alias("file"), F.monotonically_increasing_id().alias("row"))
    return chunks.select(
        order.alias("load_order"), F.posexplode(_records(schema, elements)).alias("element", "record")
    )


def _read_arrays(
    spark: SparkSession, path: str, schema: T.StructType, position: bool = False, **options
) -> DataFrame:
    """Array files.  Elements that are not objects are skipped; text that is no array raises.

    The reader gives up on a whole file when one element is not an object and hands back its text;
    only such files take the second, element by element parse.
    """
    raw = (
        spark.read.schema(with_unread(schema))
        .options(multiLine=True, columnNameOfCorruptRecord=UNREAD, **options)
        .json(path)
    )
    rows = _records(schema, array_elements(F.col(UNREAD), schema))
    extra = []
    if position:
        extra = [
            F.struct(
                F.col("_metadata.file_name").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("load_order")
        ]
    spread = raw.select(*extra, F.posexplode(rows).alias("element", "record"))
    if not position:
        return spread.select("record.*")
    order = F.struct("load_order.*", "element").alias("load_order")
    return spread.select("record.*", order)


def read_collection(
    spark: SparkSession, path: str, schema: str | T.StructType, layout: str = "auto"
) -> DataFrame:
    """A collection as a typed frame.

    ``layout`` is ``array`` (one JSON array per file, on one line or many), ``lines`` (an object per
    line, blank lines skipped) or ``auto``, which looks at the first character.  A missing path is an
    error, and so is text that is not JSON.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    if layout == "auto":
        layout = "array" if _starts_with_bracket(spark, path) else "lines"
    read = _read_arrays if layout == "array" else _read_lines
    return read(spark, path, _struct(schema))


def read_sessions(
    spark: SparkSession,
    folder: str,
    schema: str | T.StructType = schemas.SESSIONS_ANY,
    pattern: str = CHUNKS,
) -> DataFrame:
    """All ``sessions_*.json`` chunks of a folder, with ``load_order`` (file name, then position).

    The default schema has every spelling of the fields that flattening accepts.  A folder without any
    chunk is an error.
    """
    _find(spark, f"{folder.rstrip('/')}/{pattern}")
    return _read_arrays(
        spark, folder, _struct(schema), position=True, pathGlobFilter=pattern
    )


def load_collection(
    spark: SparkSession,
    name: str,
    path: str,
    target: str,
    drop_first: bool = True,
    layout: str = "auto",
) -> DataFrame:
    """Load one of the four collections into Parquet, replacing what is there or adding to it."""
    source = read_collection(spark, path, schemas.COLLECTIONS[name], layout)
    source.write.mode("overwrite" if drop_first else "append").parquet(target)
    return spark.read.schema(_struct(schemas.COLLECTIONS[name])).parquet(target)
