"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words.  A target of ``r`` times the source's words gives every document
``floor(r)`` certain copies.  The rest of the target is an order sample of fixed size: a document draws a
uniform ``u`` from its id, its random odds ``u / (1 - u)`` are divided by its inclusion odds, and documents
are taken in ascending order of that quotient until the words are there.  Inclusion odds grow with the root
of the document's words, so the cut tends to fall among short documents; the factor that all documents of a
source share does not change the order and is fixed by the cut itself.

The order is never sorted in one place: quotients are squeezed into (0, 1) and counted in buckets of about
``BUCKET`` documents, the running sums find the bucket of the cut, and only that bucket is ranked.  The last
place of a sample goes to the document outside it whose size comes nearest to the words still missing.

* null or empty text, or text without words: size 0, taken 0 (copies are still decided).
* null source: a source of its own, last in the order of sources.  Sources are ordered by code point.
* null doc_id: draws like any other id; such rows share their draw.
* repeated rows (same doc_id and size) share their draw and their decision, so that reruns agree.
* a source without words: target 0.  An empty table gives an empty result.
* other columns are neither read nor needed, and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored, word_count

BUCKET = 16384
SEED = "mix-1"


def _draws(docs: DataFrame, seed: str, *kept: str) -> DataFrame:
    """doc_id, source, size and the uniform draw of each document, beside the columns to keep."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    draw = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return docs.select(*kept, "doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("u"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words of each source from (source, n, source_size); there is one row per source.

    Sources share ``share`` times all words by weight.  None gets more than ``most`` times its own words;
    what is over goes to the others by weight.  Taking sources by the ratio of their limit to their weight,
    the level is the first at which the next source is not full: no loop is needed.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("below", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.col("below")) / F.col("open"))
        .withColumn("at", F.row_number().over(by_ratio))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    # Of sources with equal ratios the first place counts, whose limit is not yet taken off the budget.
    first = F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(everything)
    level = F.coalesce(first["level"], F.lit(float("inf")))
    return ranked.select(
        "source", "n", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target")
    )


def _order() -> Column:
    """Random odds over inclusion odds, as q / (1 + q)."""
    mean = F.col("source_size") / F.col("n")
    lean = F.when(mean > 0, F.sqrt(F.greatest(F.col("size"), F.lit(1)) / mean)).otherwise(F.lit(1.0))
    return F.col("u") / (F.col("u") + lean * (1 - F.col("u")))


def _placed(draws: DataFrame, sources: DataFrame) -> DataFrame:
    """Draws with their source's figures, quotient ``y`` and bucket ``b``."""
    named = sources.withColumnRenamed("source", "of_source")
    joined = draws.join(named, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    buckets = F.ceil(F.col("n") / BUCKET)
    return joined.withColumn("y", _order()).withColumn(
        "b", F.least(F.floor(F.col("y") * buckets), buckets - 1)
    )


def cuts(draws: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: its words, target, certain copies, and where its order sample ends."""
    sizes = draws.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = stored(
        source_targets(sizes, weights, share, most)
        .withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-sources",
    )
    placed = _placed(draws, sources)
    running = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("source", "b", "rest").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(running) - F.col("words"))
    crossing = (
        sums.where((F.col("rest") > 0) & (F.col("before") + F.col("words") >= F.col("rest")))
        .groupBy("source")
        .agg(F.min_by(F.struct("b", "before"), "b").alias("cut"))
        .select(F.col("source").alias("cut_source"), "cut.*")
        .withColumnRenamed("b", "cut_b")
    )
    near = placed.join(
        crossing, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("b") == F.col("cut_b"))
    )
    order = Window.partitionBy("source").orderBy("y", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sample = near.withColumn("sum", F.col("before") + F.sum("size").over(order)).where("sum <= rest")
    last = sample.groupBy("source").agg(F.max(F.struct("y", "doc_id")).alias("last"), F.max("sum").alias("sum"))
    last = last.withColumnRenamed("source", "last_source")
    ends = stored(
        sources.join(crossing, F.col("source").eqNullSafe(F.col("cut_source")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("last_source")), "left")
        .withColumn("missing", F.col("rest") - F.coalesce("sum", "before", F.lit(0)))
        .select("source", "n", "source_size", "target", "whole", "rest", "missing", "cut_b", "last"),
        "mix-ends",
    )
    off = F.abs(F.col("size") - F.col("missing"))
    outside = _placed(draws, ends).where(~_sampled() & F.col("cut_b").isNotNull() & (off < F.col("missing")))
    fill = outside.groupBy("source").agg(F.min(F.struct(off, "y", "doc_id")).alias("fill"))
    fill = fill.select(F.col("source").alias("fill_source"), F.struct("fill.y", "fill.doc_id").alias("fill"))
    return stored(
        ends.join(fill, F.col("source").eqNullSafe(F.col("fill_source")), "left").drop("fill_source"), "mix-cuts"
    )


def _sampled() -> Column:
    within = (F.col("b") == F.col("cut_b")) & (F.struct("y", "doc_id") <= F.col("last"))
    return F.coalesce((F.col("b") < F.col("cut_b")) | within, F.lit(False))


def _copies(placed: DataFrame) -> DataFrame:
    filled = F.coalesce(F.struct("y", "doc_id") == F.col("fill"), F.lit(False))
    return placed.withColumn("copies", F.col("whole") + (_sampled() | filled).cast("long"))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = SEED,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), copies, taken words."""
    draws = stored(_draws(docs, seed), "mix-draws")
    placed = _copies(_placed(draws, cuts(draws, weights, share, most)))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", taken)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns stay as they are.

    The texts are not shuffled: only the cut of each source is joined to them.
    """
    draws = stored(_draws(docs, seed), "mix-draws")
    limits = cuts(draws, weights, share, most)
    rows = docs.select(packed(docs).alias("row"))
    rows = rows.select("row", *[F.col(f"row.{name}").alias(name) for name in ("doc_id", "source", "text")])
    drawn = _draws(rows, seed, "row")
    copies = _copies(_placed(drawn, limits)).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
