import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import item, rows
from shoplens.functions import (
    month_index,
    parse_bound,
    parse_iso,
    parse_iso_seconds,
    timestamp_storage,
    to_number,
)
from shoplens.operators import in_time_range, line_total_parts, order_lines, unparsed_timestamps
from shoplens.sources import read_collection, schemas
from shoplens.plans import (
    category_timeline,
    customer_value,
    customer_value_from_items,
    line_items,
    revenue_by_category,
    top_products,
    user_segmentation,
)

CATALOG = [("p1", "one", "c1"), ("p2", "two", "c2"), ("p3", "three", "c1")]


def tx(i, items, user="u1", timestamp="2025-01-05T10:00:00", **extra):
    return {"transaction_id": f"t{i}", "user_id": user, "timestamp": timestamp, "items": items} | extra


def test_line_items_columns_and_types(transactions, products):
    df = line_items(transactions(tx(1, [item("p1", 2, 3.25)])), products(*CATALOG))
    assert df.dtypes == [
        ("transaction_id", "string"),
        ("user_id", "string"),
        ("timestamp", "timestamp_ntz"),
        ("product_id", "string"),
        ("quantity", "int"),
        ("unit_price", "double"),
        ("subtotal", "double"),
        ("product_name", "string"),
        ("category_id", "string"),
    ]
    assert rows(df) == [
        ("t1", "u1", datetime(2025, 1, 5, 10), "p1", 2, 3.25, 6.5, "one", "c1")
    ]


def test_orders_without_items_vanish_and_nulls_stay(transactions, products):
    docs = transactions(
        tx(1, None),
        tx(2, []),
        tx(3, [item("p1")], user=None, timestamp="2025-01-05T10:00:00.250"),
        tx(4, [item("p1")], timestamp="not a time"),
    )
    got = {r.transaction_id: r for r in line_items(docs, products(*CATALOG)).collect()}
    assert set(got) == {"t3", "t4"}
    assert got["t3"].user_id is None and got["t3"].timestamp.microsecond == 250000
    assert got["t4"].timestamp is None
    assert rows(unparsed_timestamps(docs, ["timestamp"])) == [(1,)]


def test_unknown_products_are_kept(transactions, products):
    docs = transactions(tx(1, [item("nope", 1, 5.0), item("p1", 1, 2.0)]))
    lines = line_items(docs, products(*CATALOG)).orderBy("product_id").collect()
    assert [(r.product_id, r.product_name) for r in lines] == [("nope", None), ("p1", "one")]
    revenue = revenue_by_category(docs, products(*CATALOG))
    assert rows(revenue) == [(None, "2025-01", 5.0), ("c1", "2025-01", 2.0)]
    best = top_products(docs, products(*CATALOG), limit=1)
    assert rows(best) == [("nope", None, None, 1, 5.0, 1)]


def test_defaults_of_missing_line_fields(transactions):
    docs = transactions(
        tx(
            1,
            [
                {"product_id": "a", "unit_price": 2.0},
                {"product_id": "b", "quantity": 3, "price": 1.5},
                {"product_id": "c", "quantity": 3, "unit_price": 1.5, "line_total": 0.99},
                {"product_id": "d", "quantity": 3},
                {"product_id": "e", "quantity": 2, "unit_price": 1.1, "price": 9.0},
            ],
        )
    )
    totals = order_lines(docs).select("product_id", line_total_parts().alias("parts"))
    assert dict(rows(totals)) == {"a": 0, "b": 45000, "c": 9900, "d": 0, "e": 22000}


def test_items_may_lack_fields_altogether(spark):
    docs = spark.sql(
        "select 't' as transaction_id, array(named_struct('product_id', 'a', 'quantity', 2)) as items"
    )
    lines = order_lines(docs)
    assert rows(lines.select("product_id", "user_id", line_total_parts())) == [("a", None, 0)]


def test_prices_below_a_cent_are_not_lost(spark, transactions, products, tmp_path):
    docs = transactions(tx(1, [item("p1", 1000, 0.004)]))
    assert top_products(docs, products(*CATALOG)).first().total_revenue == 4.0
    assert revenue_by_category(docs, products(*CATALOG)).first().revenue == 4.0
    assert user_segmentation(docs).first().avg_spend == 4.0
    (tmp_path / "t.json").write_text('{"transaction_id": "t", "items": [{"product_id": "p1", "quantity": 1000, "unit_price": 0.004}]}')
    read = read_collection(spark, str(tmp_path / "t.json"), schemas.TRANSACTIONS)
    assert top_products(read, products(*CATALOG)).first().total_revenue == 4.0


def test_three_revenues_differ(transactions, products):
    docs = transactions(
        tx(
            1,
            # 2 * 10.00, a subtotal that was edited by hand, and an order discount of 3.
            [item("p1", 2, 10.0) | {"subtotal": 19.0}],
            total=16.0,
            subtotal=19.0,
            discount=3.0,
        )
    )
    catalog = products(*CATALOG)
    assert customer_value(docs).first().total_revenue == 16.0
    assert customer_value_from_items(line_items(docs, catalog)).first().clv == 19.0
    assert top_products(docs, catalog).first().total_revenue == 20.0
    assert revenue_by_category(docs, catalog).first().revenue == 20.0
    assert user_segmentation(docs).first().avg_spend == 20.0


@pytest.mark.parametrize("typed", [False, True])
def test_a_date_bound_is_midnight(transactions, typed):
    docs = transactions(
        tx(1, [item("p1")], timestamp="2024-12-31T23:59:59"),
        tx(2, [item("p1")], timestamp="2025-01-01T00:00:00"),
        tx(3, [item("p1")], timestamp="2025-12-30T10:00:00"),
        tx(4, [item("p1")], timestamp="2025-12-31T10:00:00"),
    )
    if typed:
        docs = docs.withColumn("timestamp", parse_iso(F.col("timestamp")))
    got = in_time_range(docs, "2025-01-01", "2025-12-31")
    kept = sorted(r.transaction_id for r in got.collect())
    # As text, midnight of the first day sorts after the bare date; both forms agree here.
    assert kept == ["t2", "t3"]
    exact = in_time_range(docs, None, "2025-12-31T10:00:00")
    assert exact.count() == 4


@pytest.mark.parametrize("typed", [False, True])
@pytest.mark.parametrize("storage", ["auto", "date", "string"])
def test_kind_of_comparison_can_be_chosen(transactions, typed, storage):
    docs = transactions(
        tx(1, []), tx(2, [], timestamp="2025-03-01T00:00:00"), tx(3, [], timestamp="2025-03-02T00:00:01")
    )
    if typed:
        docs = docs.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    chosen = in_time_range(docs, "2025-03-01T00:00:00", "2025-03-02T00:00:00", storage=storage)
    found = {r.transaction_id for r in chosen.collect()}
    assert len(found) == 1
    with pytest.raises(ValueError):
        in_time_range(docs, "2025-03-01", storage="text")


def test_bounds_are_checked(transactions):
    docs = transactions(tx(1, [item("p1")]))
    for bad in ("2025-13-01", "yesterday", "2025-01-01T00:00:00+02:00"):
        with pytest.raises(ValueError):
            in_time_range(docs, bad)
    assert parse_bound(None) is None and parse_bound("") is None
    assert parse_bound("2025-01-02") == datetime(2025, 1, 2)
    assert parse_bound("2025-01-02T03:04:05") == datetime(2025, 1, 2, 3, 4, 5)


def test_time_storage(spark, transactions):
    assert timestamp_storage(transactions(tx(1, []))) == "string"
    assert timestamp_storage(spark.sql("select timestamp_ntz'2025-01-01' as timestamp")) == "date"
    with pytest.raises(TypeError):
        timestamp_storage(spark.sql("select 1 as timestamp"))


def test_status_is_not_filtered(transactions):
    docs = transactions(
        tx(1, [], total=5.0, status="processing"), tx(2, [], total=7.0, status="completed")
    )
    assert customer_value(docs).first().total_revenue == 12.0


def test_iso_parsing(spark):
    texts = ["2025-03-12T14:37:22", "2025-03-12T14:37:22.5", "2025-03-12", "garbage", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows(df.select(parse_iso(F.col("t")), parse_iso_seconds(F.col("t"))))
    moment = datetime(2025, 3, 12, 14, 37, 22)
    assert got == [
        (moment, moment),
        (moment.replace(microsecond=500000), None),
        (datetime(2025, 3, 12), None),
        (None, None),
        (None, None),
    ]


def test_numbers_from_text(spark):
    texts = ["12.5", "5d", "7f", "abc", "", None, "-3", "+.5", "1e3", " 4 ", "0x10", "1_000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(to_number(F.col("t"))).collect()]
    assert got == [12.5, None, None, None, None, None, -3.0, 0.5, 1000.0, 4.0, None, None]


def test_month_index_crosses_years(spark):
    df = spark.sql("select date'2026-02-01' as m, date'2024-11-01' as c")
    assert df.select(month_index(F.col("m"), F.col("c"))).first()[0] == 15


def test_top_products_ties_and_range(transactions, products):
    docs = transactions(
        tx(1, [item("p2", 1, 6.0), item("p1", 2, 3.0), item("p3", 2, 3.0), item("p1", 1, 0.0)]),
        tx(2, [item("p1", 1, 100.0)], timestamp="2030-01-01T00:00:00"),
    )
    best = top_products(docs, products(*CATALOG), end="2026-01-01", limit=2)
    # Equal revenue: more units first, then the smaller id.
    assert [(r.product_id, r.total_qty, r.orders) for r in best.collect()] == [("p1", 3, 1), ("p3", 2, 1)]


def test_revenue_is_conserved(transactions, products):
    docs = transactions(
        *(tx(i, [item(f"p{i % 4}", i, 1.37), item("p2", 1, 0.1)]) for i in range(1, 40))
    )
    by_category = revenue_by_category(docs, products(*CATALOG)).agg(F.sum("revenue")).first()[0]
    by_product = top_products(docs, products(*CATALOG), limit=100).agg(F.sum("total_revenue")).first()[0]
    expected = round(sum(i * 1.37 + 0.1 for i in range(1, 40)), 2)
    assert round(by_category, 2) == round(by_product, 2) == expected


def test_category_names_and_timeline(spark, transactions, products):
    docs = transactions(
        tx(1, [item("p1", 1, 4.0)], timestamp="2025-02-01T00:00:00"), tx(2, [item("p2", 1, 3.0)])
    )
    names = spark.createDataFrame([("c1", "Toys")], "category_id string, name string")
    revenue = revenue_by_category(docs, products(*CATALOG), categories=names)
    assert rows(revenue) == [("c1", "2025-02", 4.0, "Toys"), ("c2", "2025-01", 3.0, None)]
    line = category_timeline(revenue)
    assert [(r.category_name, r.month.isoformat(), r.revenue) for r in line.collect()] == [
        ("c2", "2025-01-01", 3.0),
        ("Toys", "2025-02-01", 4.0),
    ]
    text = revenue.drop("category_name").withColumn(
        "revenue", F.when(F.col("category_id") == "c1", "n/a").otherwise("3.0")
    )
    assert [(r.category_name, r.revenue) for r in category_timeline(text).collect()] == [("c2", 3.0)]


FINE = [
    {
        "transaction_id": f"t{k}",
        "user_id": "u",
        "timestamp": f"2025-01-0{k + 1}T00:00:00",
        "items": [
            {"product_id": "a", "quantity": 1_000_000, "unit_price": 0.00004, "subtotal": 0.000123},
            {"product_id": "b", "quantity": 3, "price": 0.333333, "subtotal": 0.999999},
            {"product_id": "c", "quantity": 7, "line_total": 0.000001, "subtotal": 99_999_999.999999},
        ],
    }
    for k in range(3)
]


def test_prices_of_six_decimals_are_not_rounded(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, FINE)))
    docs = read_collection(spark, str(tmp_path / "t.json"), schemas.finer(schemas.TRANSACTIONS, 6))
    catalog = spark.createDataFrame([("a", "A", "x"), ("b", "B", "x")], "product_id string, name string, category_id string")
    top = top_products(docs, catalog)
    assert [(r.product_id, r.total_revenue) for r in top.collect()] == [("a", 120.0), ("b", 2.999997), ("c", 0.000003)]
    assert "SortAggregate" not in top._jdf.queryExecution().toString()
    revenue = revenue_by_category(docs, catalog).collect()
    assert [(r.category_id, r.revenue) for r in revenue] == [(None, 0.000003), ("x", 122.999997)]
    assert user_segmentation(docs).first().avg_spend == 123.0
    lines = order_lines(docs)
    assert customer_value_from_items(lines).first().clv == 300_000_003.000363
    with pytest.raises(ValueError):
        schemas.finer(schemas.TRANSACTIONS, 3)


def test_four_decimals_stay_whole_numbers(spark, transactions):
    docs = transactions(*FINE)
    assert dict(order_lines(docs).select(line_total_parts(order_lines(docs)).alias("x")).dtypes) == {"x": "bigint"}
