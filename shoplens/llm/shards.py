"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded random order within their source; a row's rank over its source's rows is its
fractional rank.  In the order of fractional ranks every stretch holds each source in its share of the whole,
and so does every shard when that order is cut into shards of equal counts (at most one row apart).

Neither ranking gathers a source or the table in one task: random numbers and fractional ranks are cut into
cells of about ``CELL`` rows, cells are counted and their running sums give offsets, and rows are numbered
within their cell only.

* null or empty text: size 1, checksum 0.  null source: a source of its own.
* null doc_id and repeated rows: ordinary rows; rows equal in all of doc_id, source and text are
  interchangeable, so the result is the same in every run.
* an empty table gives an empty result; fewer rows than shards leave some shards empty.
* other columns are neither read nor needed, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CELL = 16384
SEED = 20


def _numbered(df: DataFrame, group: list[str], cell: str, order: list, name: str) -> DataFrame:
    """``df`` with a running number from 0 within ``group``; cells must follow the order."""
    counts = df.groupBy(*group, cell).agg(F.count("*").alias("in_cell"))
    running = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(
        *[F.col(g).alias(f"of_{g}") for g in group],
        F.col(cell).alias("of_cell"),
        (F.sum("in_cell").over(running) - F.col("in_cell")).alias("offset"),
    )
    same = F.col(cell) == F.col("of_cell")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    number = F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)) - 1
    rows = df.withColumn("in_cell", number).join(offsets, same)
    return rows.withColumn(name, F.col("offset") + F.col("in_cell")).drop(
        "in_cell", "offset", "of_cell", *[f"of_{g}" for g in group]
    )


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size (UTF-8 bytes and 1), text_crc32, shard, slot (from 0 in its shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.xxhash64(F.lit(seed), "doc_id", "crc", "size")
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    ).withColumn("draw", F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53)))
    rows = stored(rows, "shards-rows")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    sizes = stored(counts.select(F.col("source").alias("sized"), "n", total.alias("total")), "shards-sources")
    cells = F.ceil(F.col("n") / CELL)
    rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("sized"))).drop("sized")
    rows = rows.withColumn("cell", F.least(F.floor(F.col("draw") * cells), cells - 1))
    ranked = _numbered(rows, ["source"], "cell", ["draw", "doc_id", "crc", "size"], "rank")
    stretches = F.ceil(F.col("total") / CELL)
    ranked = stored(
        ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("n")).withColumn(
            "cell", F.least(F.floor(F.col("fraction") * stretches), stretches - 1)
        ),
        "shards-ranked",
    )
    ordered = _numbered(ranked, [], "cell", ["fraction", "source", "doc_id", "crc", "size"], "place")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        ordered.withColumn("shard", F.expr(f"(place * {shards}) div total"))
        .withColumn("slot", F.col("place") - start)
        .select("doc_id", "source", "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int"), "slot")
    )
