import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import item, rows
from shoplens.operators import box_stats, coerce_numeric, exact_quantiles, histogram, top_values
from shoplens.plans import (
    avg_transaction,
    cohort_retention,
    customer_scatter,
    customer_segments,
    customer_value,
    segment_users,
    user_segmentation,
    value_histogram,
)


def tx(i, user, timestamp="2025-01-05T10:00:00", total=1.0, items=()):
    return {
        "transaction_id": f"t{i}",
        "user_id": user,
        "timestamp": timestamp,
        "total": total,
        "items": list(items),
    }


def test_cohorts_across_the_year_end(transactions):
    docs = transactions(
        tx(1, "a", "2024-12-30T10:00:00"),
        tx(2, "a", "2025-01-02T10:00:00"),
        tx(3, "a", "2025-01-20T10:00:00"),
        tx(4, "b", "2024-12-01T00:00:00"),
        tx(5, "c", "2025-01-31T23:59:59"),
        tx(6, None, "2025-01-31T23:59:59"),
        tx(7, "d", "not a time"),
    )
    got = [(str(r[0]), *r[1:]) for r in cohort_retention(docs).collect()]
    assert got == [
        ("2024-12-01", 0, 2, 2, 1.0),
        ("2024-12-01", 1, 1, 2, 0.5),
        ("2025-01-01", 0, 1, 1, 1.0),
    ]


def test_retention_invariants(spark, folder):
    from shoplens import testdata

    result = cohort_retention(testdata.transactions(spark, folder))
    bad = result.where(
        "not (retention_rate > 0 and retention_rate <= 1) or (cohort_index = 0 and retention_rate <> 1)"
        " or cohort_size is null"
    )
    assert bad.count() == 0


def test_customer_value_spans(transactions):
    docs = transactions(
        tx(1, "a", "2025-01-01T10:00:00", 10.25),
        tx(2, "a", "2025-01-31T09:00:00", 5.5),
        tx(2, "a", "2025-01-31T09:00:00", 5.5),
        tx(3, "b", total=100.0),
    )
    got = [
        (r.user_id, r.total_revenue, r.num_orders, r.active_days)
        for r in customer_value(docs).collect()
    ]
    # A repeated document adds revenue but not an order.
    assert got == [("b", 100.0, 1, 0), ("a", 21.25, 2, 30)]


def test_buckets(spark):
    counts = {"none": 1, "two": 2, "three": 3, "nine": 9, "ten": 10, "huge": 12}
    lines = [
        (f"{user}-{i}", user, f"2025-01-{i + 1:02d}", 10_000)  # parts of a cent
        for user, n in counts.items()
        for i in range(n)
    ]
    totals = spark.createDataFrame(
        lines, "transaction_id string, user_id string, created_at string, tx_total bigint"
    )
    got = rows(segment_users(totals, [2, 3, 10, 12]))
    assert got == [
        ("2", 1, 2.0, 2.0, "2025-01-02"),
        ("3", 2, 6.0, 6.0, "2025-01-09"),
        ("10", 1, 10.0, 10.0, "2025-01-10"),
        ("other", 2, 6.5, 6.5, "2025-01-12"),
    ]


@pytest.mark.parametrize("bad", [[], [1], [3, 1], [1, 1]])
def test_bad_boundaries(spark, transactions, bad):
    with pytest.raises(ValueError):
        user_segmentation(transactions(tx(1, "a")), boundaries=bad)


def test_segmentation_of_documents(transactions):
    docs = transactions(
        tx(1, "a", items=[item("p1", 2, 1.5), item("p2", 1, 1.0)]),
        tx(2, "a", "2025-02-05T10:00:00", items=[item("p1", 1, 2.0)]),
        tx(3, "b", items=[]),
        tx(4, "c", items=[item("p1", 1, 2.0)]),
    )
    assert rows(user_segmentation(docs)) == [("1", 2, 1.5, 4.0, "2025-02-05T10:00:00")]
    later = user_segmentation(docs, start="2025-02-01")
    assert rows(later) == [("1", 1, 1.0, 2.0, "2025-02-05T10:00:00")]


def value_frame(spark, pairs):
    return spark.createDataFrame(
        [(f"u{i}", float(r), n, 3) for i, (r, n) in enumerate(pairs)],
        "user_id string, total_revenue double, num_orders bigint, active_days int",
    )


@pytest.mark.parametrize("seed", range(4))
def test_segments_equal_pandas_qcut(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(1, 60) / 4, rng.randint(1, 25)) for _ in range(rng.randint(80, 300))]
    df = pd.DataFrame(pairs, columns=["r", "n"])
    s = pd.qcut(df.r, 4, labels=False)
    f = pd.qcut(df.n, 4, labels=False)
    expected = np.zeros((4, 4), int)
    for i, j in zip(s, f):
        expected[i, j] += 1
    got = customer_segments(value_frame(spark, pairs)).collect()
    assert [r[0] for r in got] == ["Low", "Medium", "High", "Premium"]
    assert [list(r[1:]) for r in got] == expected.tolist()


def test_repeated_edges_raise_when_run(spark):
    df = value_frame(spark, [(i, 1) for i in range(20)])
    with pytest.raises(ValueError):
        pd.qcut(pd.Series([1] * 20), 4)
    segments = customer_segments(df)
    with pytest.raises(Exception, match="edges of num_orders are not unique"):
        segments.collect()


def test_values_that_are_not_numbers_are_dropped(spark):
    text = spark.createDataFrame(
        [("a", "12.5", "2", "1"), ("b", "5d", "1", "1"), ("c", "7", None, "1")],
        "user_id string, total_revenue string, num_orders string, active_days string",
    )
    assert rows(customer_scatter(text)) == [(2.0, 12.5, "1")]
    assert avg_transaction(text).first().avg_transaction == 6.25
    assert coerce_numeric(text, "total_revenue").count() == 2


def test_top_values_come_smallest_first(spark):
    text = spark.createDataFrame(
        [("a", "3"), ("b", "10"), ("c", "x"), ("d", "10"), ("e", "1")], "name string, n string"
    )
    assert rows(top_values(text, "name", "n", 3)) == [("a", 3.0), ("d", 10.0), ("b", 10.0)]


@pytest.mark.parametrize("bins", [1, 7, 50])
@pytest.mark.parametrize("kind", ["edges", "floats", "constant"])
def test_histogram_equals_numpy(spark, bins, kind):
    rng = np.random.default_rng(3)
    values = {
        "edges": np.arange(0, 51) / 10,
        "floats": rng.lognormal(3, 1, 500).round(2),
        "constant": np.full(9, 4.25),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    counts, edges = np.histogram(values, bins=bins)
    got = histogram(df, "x", bins).collect()
    assert [r["count"] for r in got] == counts.tolist()
    assert np.allclose([r.lower for r in got], edges[:-1])
    assert np.allclose([r.upper for r in got], edges[1:])


def test_value_histograms_count_every_customer(spark):
    df = value_frame(spark, [(i * 1.5, i % 9 + 1) for i in range(200)])
    for column, bins in {"total_revenue": 50, "num_orders": 30, "avg_transaction": 50}.items():
        got = value_histogram(df, column).agg(F.count("*"), F.sum("count")).first()
        assert tuple(got) == (bins, 200)


def test_quantiles_small(spark):
    values = [1.0, 1.0, 1.0, 2.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ps = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    assert np.allclose(exact_quantiles(df, ["x"], ps).first().x, np.quantile(values, ps))
    none = exact_quantiles(df.where("x > 99"), ["x"], ps).first().x
    assert none == [None] * len(ps)


def test_quantiles_large_and_skewed(spark):
    """Enough rows for brackets, a value that makes up a third of them, and a heavy tail."""
    n = 400_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0))
        .otherwise(F.pow(F.lit(1.00005), (F.col("id") * 7919) % n))
        .alias("x"),
        ((F.col("id") * 104729) % n).cast("int").alias("y"),
        F.lit(5).alias("z"),
    )
    ps = (0.25, 0.5, 0.75, 0.999)
    got = exact_quantiles(df, ["x", "y", "z"], ps).first()
    data = df.toPandas()
    for c in "xyz":
        assert np.allclose(got[c], np.quantile(data[c], ps), rtol=1e-12), c


def box_by_hand(x):
    q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    reach = 1.5 * (q3 - q1)
    inside_low, inside_high = x[x >= q1 - reach], x[x <= q3 + reach]
    low = min(inside_low.min(), q1) if len(inside_low) else q1
    high = max(inside_high.max(), q3) if len(inside_high) else q3
    return [q1, med, q3, low, high, int(((x < low) | (x > high)).sum())]


def test_box(spark):
    rng = np.random.default_rng(5)
    x, y = rng.lognormal(2, 1, 300), rng.normal(0, 1, 300)
    df = spark.createDataFrame(
        [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 0.5)], "x double, y double"
    )
    got = {r.metric: list(r)[1:] for r in box_stats(df, ["x", "y"]).collect()}
    assert np.allclose(got["x"], box_by_hand(x))
    assert np.allclose(got["y"], box_by_hand(np.append(y, 0.5)))
