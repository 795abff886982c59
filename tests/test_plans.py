"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows
from shoplens import plans, testdata
from shoplens.operators import exact_quantiles, in_time_range, latest_by_key
from shoplens.plans import baskets, cohort_retention, line_items, top_products
from shoplens.sources import read_collection, schemas, write_line_items

OPTIONAL = {*entry.training_text.queries(), "pipeline"} if entry.training_text else set()
QUERIES = {name: query for name, query in entry.queries().items() if name not in OPTIONAL}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"incremental_ingest"}))
def test_no_cross_join_and_no_python(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert bad not in text


@pytest.mark.parametrize(
    "name, columns",
    {
        "cohort_retention": {"o_custkey", "o_orderdate"},
        "dedupe_basket": {"l_orderkey", "l_partkey"},
        "device_distribution": {"event_type"},
        "duplicate_keys": {"l_orderkey", "l_partkey"},
        "histogram_revenue": {"o_custkey", "o_orderkey", "o_totalprice"},
    }.items(),
)
def test_only_needed_columns_are_read(spark, folder, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, folder)))
    assert schemas, name
    for found in schemas:
        assert {field.split(":")[0] for field in found.split(",")} == columns


def test_time_bounds_reach_the_scan(spark, folder):
    text = plan(QUERIES["time_range_filter"](spark, folder))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThanOrEqual(o_orderdate" in pushed


def test_time_bounds_prune_months(spark, folder, tmp_path):
    items = line_items(testdata.order_documents(spark, folder), testdata.products(spark, folder))
    write_line_items(items, str(tmp_path / "items"))
    stored = spark.read.parquet(str(tmp_path / "items"))
    chosen = in_time_range(stored, "1996-02-10", "1996-04-01")
    assert chosen.count() == in_time_range(items, "1996-02-10", "1996-04-01").count() > 0
    text = plan(chosen)
    assert re.search(r"PartitionFilters: \[[^\]]*order_month[^\]]*1996-02", text)
    assert stored.count() == items.count()


def test_sorts_come_last(spark, folder):
    for name in ("cohort_retention", "customer_value", "revenue_by_category"):
        top = plan(QUERIES[name](spark, folder)).splitlines()[1:3]
        assert any("Sort [" in line for line in top), (name, top)


def test_top_k_is_not_a_full_sort(spark, folder):
    lines = testdata.lines(spark, folder)
    assert "TakeOrderedAndProject(limit=10" in plan(baskets._top_pairs(lines, 10, 200))
    for name in ("copurchase_totals", "user_sessions", "converted_sessions"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["histogram_revenue", "device_distribution", "customer_segments", "box_stats"])
def test_both_passes_share_one_shuffle_of_the_facts(spark, folder, name):
    """The bounds and the counts read the same shuffled aggregate; the facts are scanned once."""
    df = QUERIES[name](spark, folder)
    df.collect()
    final = plan(df).split("\n+- == Initial Plan ==")[0]
    # Only executed scans have the conversion from columns above them.
    assert final.count("ColumnarToRow") == 1, final
    assert "ReusedExchange" in final


def test_hot_keys_are_combined_before_the_shuffle(spark, folder):
    """Partial aggregates sit below the exchanges of what groups by a possibly hot key."""
    sessions = spark.range(10).select(
        (F.col("id") % 2).alias("row_key"), "id", F.lit("x").alias("session_id")
    )
    text = plan(latest_by_key(sessions, ["row_key"], F.col("id")))
    assert "partial_max_by" in text
    cohort = plan(cohort_retention(testdata.transactions(spark, folder)))
    assert "partial_collect_set" in cohort


def test_an_upsert_scans_once_and_aggregates_by_hash(spark, folder):
    """Both the search for the newest versions and their rows read one shuffle."""
    df = QUERIES["session_upsert_latest"](spark, folder)
    df.collect()
    final = plan(df).split("\n+- == Initial Plan ==")[0]
    assert final.count("FileScan") == 1, final
    assert "ReusedExchange" in final and "SortAggregate" not in final


def test_tied_products_are_limited_before_the_shuffle(spark):
    lines = spark.range(3000).select(
        (F.col("id") % 3).alias("transaction_id"), (F.col("id") / 3).cast("bigint").alias("product_id")
    )
    text = plan(baskets._top_pairs(lines, 10, 200))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_only_lines_of_the_winners_are_shuffled_by_order(spark, folder):
    df = top_products(testdata.priced_lines(spark, folder), testdata.products(spark, folder), limit=5)
    text = plan(df)
    # The ranking groups by product alone; orders are counted behind the broadcast winners.
    assert "TakeOrderedAndProject(limit=5" in text and "BroadcastHashJoin" in text
    ranking = text[text.index("TakeOrderedAndProject(limit=5") :]
    assert "transaction_id" not in re.search(r"HashAggregate\(keys=\[product_id[^\n]*", ranking).group()
    assert "SortAggregate" not in text
    assert df.count() == 5


def test_the_order_join_carries_one_amount(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["revenue_by_category"](spark, folder))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # What is shuffled towards the order headers, and the month is no text there.
    below = re.findall(r"Exchange hashpartitioning\(transaction_id[^\n]*\n[^\n]*Project \[([^\n]*)\]", text)
    assert below and not any("quantity" in p and "unit_price" in p and "revenue" not in p for p in below)
    assert "date_format" not in text.split("HashAggregate")[-1]


def test_large_joins_shuffle_on_their_keys(spark, folder):
    """With broadcasting off the plans still work and agree."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["revenue_by_category"](spark, folder)
        assert "SortMergeJoin" in plan(df)
        off = sorted(rows(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert off == sorted(rows(QUERIES["revenue_by_category"](spark, folder)))


def test_quantile_ranking_sees_a_sliver_of_the_data(spark):
    n = 300_000
    df = spark.range(n).select(F.col("id").cast("double").alias("x"))
    quantiles = exact_quantiles(df, ["x"], (0.5,))
    assert quantiles.first().x == [(n - 1) / 2]


def test_a_hot_join_key_is_split(spark, tmp_path):
    """A product on every third line, too big a catalogue to broadcast: its partition is cut up."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16",
    }
    lines = spark.range(0, 300_000, 1, 8).selectExpr(
        "id as transaction_id",
        "'u' as user_id",
        "timestamp_ntz'2025-01-01' as timestamp",
        "if(id % 3 = 0, 7, id % 20000) as product_id",
        "1 as quantity",
        "cast(id % 977 as double) as unit_price",
        "cast(id as double) as subtotal",
    )
    lines.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    catalog = spark.range(20_000).selectExpr(
        "id as product_id", "concat('n', id) as name", "id % 25 as category_id"
    )
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df = line_items(lines, catalog)
        assert df.where("product_name is null").count() == 0
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        assert "skew=true" in plan(df).split("\n+- == Initial Plan ==")[0]
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("query", ["user_segmentation", "cohort_retention", "customer_value", "top_products"])
def test_text_ids_and_times_are_aggregated_by_hash(spark, tmp_path, query):
    """With the schemas of the raw collections, not the numbers of the test tables."""
    (tmp_path / "t.json").write_text(
        '{"transaction_id": "t1", "user_id": "u1", "timestamp": "2025-01-01T00:00:00", "total": 2.0,'
        ' "items": [{"product_id": "p1", "quantity": 1, "unit_price": 2.0}]}'
    )
    orders = read_collection(spark, str(tmp_path / "t.json"), schemas.TRANSACTIONS)
    catalog = spark.createDataFrame([], schemas.PRODUCTS)
    args = (orders, catalog) if query == "top_products" else (orders,)
    df = getattr(plans, query)(*args)
    assert df.count() == 1
    assert "SortAggregate" not in plan(df)
