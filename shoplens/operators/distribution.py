"""Exact quantiles, histograms and box statistics of large columns.

Bounds found in one pass over the data enter the next as a scalar subquery: no collect, no cross
join, and the shuffle that produced the input is reused by both passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APPROXIMATION = 10_000  # rank error of the first pass is at most rows / APPROXIMATION


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, with NaN made null."""
    return df.selectExpr(*(f"nullif(cast(`{c}` as double), double('nan')) as `{c}`" for c in columns))


def _inline(structs: Iterable[str]) -> str:
    return f"inline(array({', '.join(structs)}))"


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    approximation: int = APPROXIMATION,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row, one ``array<double>`` per column.

    The first pass sketches a narrow bracket of values around each wanted rank.  The second folds
    everything below a bracket into one counter, drops what lies above, and ranks only the distinct
    values inside: no more than about ``4 * rows / approximation`` of them.  Neither pass gathers a
    column in one task, and repeated values cost nothing because they are counted before the
    shuffle.  A bracket that missed its rank, which the sketch's guarantee rules out, raises.
    """
    numbers = _numbers(df, columns)
    margin = 2.0 / approximation
    edges = [min(max(p + side, 0.0), 1.0) for p in probabilities for side in (-margin, margin)]
    ranks = ", ".join(f"{e}d" for e in edges)
    sketch = numbers.selectExpr(
        *(
            f"struct(count(`{c}`) as n, min(`{c}`) as lo, max(`{c}`) as hi, "
            f"percentile_approx(`{c}`, array({ranks}), {approximation}) as edges) as `{c}`"
            for c in columns
        )
    )

    def bracket(c: str, i: int, p: float) -> str:
        # A small column is ranked whole; so is the side of a bracket that runs off an end.
        small = f"`{c}`.n < {10 * approximation}"
        low = f"if({small} or {p <= margin}, `{c}`.lo, `{c}`.edges[{2 * i}])"
        high = f"if({small} or {p >= 1 - margin}, `{c}`.hi, `{c}`.edges[{2 * i + 1}])"
        return (
            f"struct('{c}' as metric, {i} as slot, {low} as low, {high} as high, "
            f"{p}d * (`{c}`.n - 1) as position)"
        )

    brackets = sketch.selectExpr(
        _inline(bracket(c, i, p) for c in columns for i, p in enumerate(probabilities))
    )
    values = numbers.selectExpr(_inline(f"struct('{c}' as metric, `{c}` as value)" for c in columns))
    # The broadcast side has len(columns) * len(probabilities) rows.
    inside = (
        values.where("value is not null")
        .join(F.broadcast(brackets), "metric")
        .where("value <= high")
        .groupBy("metric", "slot", "position", F.expr("if(value >= low, value, null) as value"))
        .agg(F.expr("count(*) as copies"))
    )
    ranked = inside.selectExpr(
        "*",
        """sum(copies) over (partition by metric, slot order by value nulls first
           rows between unbounded preceding and current row) as through""",
    )
    # `lower` and `upper` are the least values with more than that many values up to them.  The row
    # folded from everything below a bracket has no value and must end before the rank.
    found = (
        ranked.groupBy("metric", "slot", "position")
        .agg(
            F.expr("min(if(through > floor(position), value, null)) as lower"),
            F.expr("min(if(through > ceil(position), value, null)) as upper"),
            F.expr("coalesce(max(if(value is null, through, 0)), 0) as folded"),
        )
        .selectExpr(
            "metric",
            "slot",
            """if(upper is not null and folded <= floor(position),
                  lower + (upper - lower) * (position - floor(position)),
                  cast(raise_error('quantile bracket missed its rank') as double)) as quantile""",
        )
    )

    def slots(c: str) -> str:
        found_in = (
            f"max(if(metric = '{c}' and slot = {i}, quantile, null))"
            for i in range(len(probabilities))
        )
        return f"array({', '.join(found_in)}) as `{c}`"

    return found.selectExpr(*(slots(c) for c in columns))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram: ``bin, lower, upper, count``, empty bins included.

    Bins are closed below and open above, the last closed on both sides.  A constant column gets a
    range of one around its value.
    """
    if bins < 1:
        raise ValueError("a histogram needs at least one bin")
    numbers = _numbers(df, [column]).selectExpr(f"`{column}` as x").where("x is not null")
    span = numbers.selectExpr(
        """struct(min(x) - if(min(x) = max(x), 0.5d, 0d) as lo,
                  max(x) + if(min(x) = max(x), 0.5d, 0d) as hi) as s"""
    )

    def edge(i: str) -> str:
        return f"if({i} = {bins}, s.hi, s.lo + {i} * ((s.hi - s.lo) / {bins}))"

    guess = f"least(floor((x - s.lo) / (s.hi - s.lo) * {bins}), {bins - 1}L) as i"
    # The guess can be off by one through rounding; the edges decide.
    settled = f"""case when x < {edge("i")} then i - 1
                       when x >= {edge("(i + 1)")} and i < {bins - 1} then i + 1
                       else i end as bin"""
    counts = (
        numbers.select("x", span.scalar().alias("s"))
        .selectExpr("x", "s", guess)
        .groupBy(F.expr(settled))
        .agg(F.expr("count(*) as n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin"), span.scalar().alias("s"))
    # At most `bins` rows are broadcast.
    return (
        frame.join(F.broadcast(counts), "bin", "left")
        .selectExpr(
            "bin",
            f"{edge('bin')} as lower",
            f"{edge('(bin + 1)')} as upper",
            "coalesce(n, 0L) as count",
        )
        .orderBy("bin")
    )


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and the number of outliers per column.

    ``metric, q1, median, q3, whisker_low, whisker_high, outliers``.
    """
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    whole = quartiles.select(F.struct(*columns).alias("q"))
    data = _numbers(df, columns).select(*columns, whole.scalar().alias("q"))

    def summary(c: str) -> str:
        q1, q3 = f"q.`{c}`[0]", f"q.`{c}`[2]"
        low, high = f"({q1} - ({q3} - {q1}) * 1.5d)", f"({q3} + ({q3} - {q1}) * 1.5d)"
        return f"""struct(
            '{c}' as metric,
            min({q1}) as q1,
            min(q.`{c}`[1]) as median,
            min({q3}) as q3,
            least(min(if(`{c}` >= {low}, `{c}`, null)), min({q1})) as whisker_low,
            greatest(max(if(`{c}` <= {high}, `{c}`, null)), max({q3})) as whisker_high,
            count_if(`{c}` < {low} or `{c}` > {high}) as outliers)"""

    rows = f"array({', '.join(summary(c) for c in columns)}) as rows"
    return data.agg(F.expr(rows)).selectExpr("inline(rows)")
