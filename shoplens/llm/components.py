"""Connected components of a table of links, by alternating large and small stars.

Each round hangs the neighbours of a vertex on the smallest of them; rounds are written to the shared folder, so the
plan stays short and a lost executor costs one round.  A vertex of very many links is reduced by minima that combine
before the shuffle, and joined back on the side that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _links(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links of a larger and a smaller vertex."""
    found = df.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
    return found.where("high > low").distinct()


def _round(links: DataFrame) -> DataFrame:
    both = links.select(F.col("high").alias("u"), F.col("low").alias("v")).union(links.select("low", "high"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = _links(large, "u", "v")
    least = large.groupBy("high").agg(F.min("low").alias("m"))
    small = large.join(least, "high")
    return _links(small.select("low", "m").union(small.select("high", "m")), "low", "m")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """vertex, component: the smallest vertex reachable.  Vertices that are the smallest themselves are left out."""
    current = stored(_links(links, a, b), "components")
    mark = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("sum")
    before = None
    while True:
        now = current.agg(F.count("*").alias("n"), mark).first()
        if now == before or not now["n"]:
            return current.select(F.col("high").alias("vertex"), F.col("low").alias("component"))
        before = now
        current = stored(_round(current), "components")
