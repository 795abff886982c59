"""The star schema test tables under the library's names.

Facts are used as they lie: order headers (``orders``) and lines (``lineitem``) apart.  Nothing
collects the lines of an order into a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns used, so that no file is opened for its schema.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
                 o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double,
                   l_extendedprice double, l_returnflag string, l_linestatus string""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
                 props string""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Order headers."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        (F.col("p_size") % 25).alias("category_id"),
        F.col("p_retailprice").alias("base_price"),
    )


def categories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name")
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines without user, time and unit price."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("subtotal"),
        "l_returnflag",
    )


def priced_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the retail price of their product as unit price."""
    prices = products(spark, folder).select("product_id", F.col("base_price").alias("unit_price"))
    return lines(spark, folder).join(prices, "product_id", "left")


def order_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their items, ready to be unnested; every order again with no items, and with null.

    An order has a handful of lines, so collecting them is bounded.
    """
    headers = transactions(spark, folder).select("transaction_id", "user_id", "timestamp")
    item = F.struct("product_id", "quantity", "unit_price", "subtotal")
    items = priced_lines(spark, folder).groupBy("transaction_id").agg(F.collect_list(item).alias("items"))
    full = items.join(headers, "transaction_id")
    kind = full.schema["items"].dataType
    empty = headers.withColumn("items", F.array().cast(kind))
    missing = headers.withColumn("items", F.lit(None).cast(kind))
    return full.unionByName(empty).unionByName(missing)


def flat_session_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions of `session_documents` with flat fields and other names; some in structs of other names."""
    nested = session_documents(spark, folder)
    return nested.select(
        "session_id",
        "user_id",
        F.col("start_time").alias("timestamp"),
        "end_time",
        F.col("duration_seconds").alias("duration"),
        F.col("device_profile").alias("device"),
        F.col("geo_data.city").alias("city"),
        F.col("geo_data.state").alias("state"),
        F.col("geo_data.country").alias("country"),
        F.col("geo_data.ip_address").alias("ip_address"),
        F.size("page_views").alias("page_views_count"),
        "conversion_status",
        "referrer",
        "viewed_products",
        "cart_contents",
    )


def session_documents(spark: SparkSession, folder: str, start: str = "ts") -> DataFrame:
    """Each event as a nested session; ``start`` is the expression for its start time."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, folder, "events").withColumn("k", k)
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return events.select(
        F.col("event_id").cast("string").alias("session_id"),
        F.format_string("user_%06d", "user_id").alias("user_id"),
        F.date_format(F.expr(start), iso).alias("start_time"),
        F.date_format(F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, k)"), iso).alias("end_time"),
        F.col("k").alias("duration_seconds"),
        F.expr(
            """struct(concat('city_', user_id % 10) as city, concat('state_', user_id % 5) as state,
                      'country' as country, concat('10.0.0.', k) as ip_address)"""
        ).alias("geo_data"),
        F.expr(
            """struct(event_type as type, concat('os_', k % 3) as os,
                      concat('browser_', k % 4) as browser)"""
        ).alias("device_profile"),
        F.expr("if(event_type = 'purchase', 'converted', 'browsed')").alias("conversion_status"),
        F.expr("concat('referrer_', k % 5)").alias("referrer"),
        F.expr("array(concat('prod_', k))").alias("viewed_products"),
        F.expr(
            "array_repeat(struct('product_detail' as page_type, concat('prod_', k) as product_id), k % 4)"
        ).alias("page_views"),
        F.expr("map(concat('prod_', k), struct(1 as quantity))").alias("cart_contents"),
        F.col("event_id").alias("load_order"),
    )
