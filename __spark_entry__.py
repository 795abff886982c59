"""Entry points: a flagship query, every query by name, and the SQL that must agree with it."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens import functions as fn
from shoplens import operators as ops
from shoplens import plans
from shoplens import testdata as data
from shoplens.session import tune
from shoplens.sources import (
    first_ranges,
    load_collection,
    load_unique,
    merge_ranges,
    read_array_blocks,
    read_collection,
    read_ranges,
    read_result_csv,
    read_unique,
    run_sql_script,
    scratch_path,
    set_aside,
    write_ragged,
    write_ranges,
    write_result,
    write_sessions,
)
from shoplens.streaming import ingest_files, ingest_growing_sessions, ingest_sessions

try:  # an optional part of the library, with its pipeline
    import corpus_pipeline
    from shoplens.llm import queries as training_text
except ImportError as missing:
    warnings.warn(f"the training text queries are left out: {missing}", stacklevel=1)
    corpus_pipeline = training_text = None

Query = Callable[[SparkSession, str], DataFrame]
PROBABILITIES = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


# Normalised lines, baskets, cohorts


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    return plans.line_items(data.order_documents(spark, folder), data.products(spark, folder))


def line_items_hot_products(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines with the products of many lines dealt out; three quarters are moved to five products."""
    orders, few = data.order_documents(spark, folder), F.lit(5).cast("bigint")
    moved = F.transform(
        "items",
        lambda line: line.withField(
            "product_id", F.when(line["product_id"] % 4 == 0, line["product_id"]).otherwise(line["product_id"] % few + 1)
        ),
    )
    return plans.line_items(orders.withColumn("items", moved), data.products(spark, folder), salts=16)


def dedupe_basket(spark: SparkSession, folder: str) -> DataFrame:
    return ops.basket_items(data.lines(spark, folder))


def also_bought(spark: SparkSession, folder: str) -> DataFrame:
    return plans.also_bought(data.lines(spark, folder), products=data.products(spark, folder))


def also_bought_large_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with nearly every basket treated as a large one."""
    return plans.also_bought(
        data.lines(spark, folder), products=data.products(spark, folder), small_basket=3
    )


def also_bought_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs after pruning rare products, whatever the number of lines."""
    return plans.also_bought(
        data.lines(spark, folder), products=data.products(spark, folder), small_basket=5, prune_from=0
    )


def copurchase_totals(spark: SparkSession, folder: str) -> DataFrame:
    return plans.copurchase_totals(also_bought(spark, folder))


def cohort_retention(spark: SparkSession, folder: str) -> DataFrame:
    return plans.cohort_retention(data.transactions(spark, folder))


# Customers


def customer_value(spark: SparkSession, folder: str) -> DataFrame:
    return plans.customer_value(data.transactions(spark, folder))


def _value(spark: SparkSession, folder: str) -> DataFrame:
    return plans.customer_value(data.transactions(spark, folder), ordered=False)


def customer_value_from_items(spark: SparkSession, folder: str) -> DataFrame:
    headers = data.transactions(spark, folder)
    return plans.customer_value_from_items(data.lines(spark, folder), headers)


def user_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    headers = data.transactions(spark, folder)
    return plans.user_segmentation(data.priced_lines(spark, folder), headers=headers)


def user_segmentation_range(spark: SparkSession, folder: str) -> DataFrame:
    return plans.user_segmentation(
        data.priced_lines(spark, folder),
        start="1995-01-01",
        end="1996-12-31",
        boundaries=[1, 2, 3, 5, 8],
        headers=data.transactions(spark, folder),
    )


def customer_segments(spark: SparkSession, folder: str) -> DataFrame:
    return plans.customer_segments(_value(spark, folder))


def customer_scatter(spark: SparkSession, folder: str) -> DataFrame:
    return plans.customer_scatter(_value(spark, folder))


def _histogram(column: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plans.value_histogram(_value(spark, folder), column)

    return query


def box_stats(spark: SparkSession, folder: str) -> DataFrame:
    box = plans.value_distribution_box(_value(spark, folder))
    limits = ("q1", "median", "q3", "whisker_low", "whisker_high")
    return box.withColumns({c: F.round(c, 4) for c in limits})


def quantiles_bracketed(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of line prices with brackets narrow enough that even small tables use them."""
    lines = data.lines(spark, folder)
    found = ops.exact_quantiles(lines, ["subtotal"], PROBABILITIES, approximation=1000)
    return found.select(F.posexplode("subtotal").alias("place", "value")).select(
        "place", F.round("value", 4).alias("value")
    )


# Products


def top_products(spark: SparkSession, folder: str) -> DataFrame:
    return plans.top_products(data.priced_lines(spark, folder), data.products(spark, folder))


def top_products_range(spark: SparkSession, folder: str) -> DataFrame:
    """Best sellers of two years, from lines that carry their order's time."""
    times = data.transactions(spark, folder).select("transaction_id", "timestamp")
    lines = data.priced_lines(spark, folder).join(times, "transaction_id")
    return plans.top_products(
        lines, data.products(spark, folder), start="1995-01-01", end="1996-12-31", limit=15
    )


def revenue_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return plans.revenue_by_category(
        data.priced_lines(spark, folder),
        data.products(spark, folder),
        categories=data.categories(spark, folder),
        headers=data.transactions(spark, folder),
    )


def revenue_by_category_range(spark: SparkSession, folder: str) -> DataFrame:
    """Without category names, in a range of time."""
    return plans.revenue_by_category(
        data.priced_lines(spark, folder),
        data.products(spark, folder),
        start="1995-06-01",
        end="1996-05-31",
        headers=data.transactions(spark, folder),
    )


def category_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return plans.category_timeline(revenue_by_category(spark, folder))


# Sessions


def _sessions(spark: SparkSession, folder: str, start: str = "ts") -> DataFrame:
    return ops.flatten_sessions(data.session_documents(spark, folder, start))


def session_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder).drop("load_order")


def session_flatten_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """The same sessions from JSON chunks of both layouts, loaded incrementally."""
    chunks = scratch_path(spark, "chunks")
    for documents in (data.session_documents(spark, folder), data.flat_session_documents(spark, folder)):
        half = "cast(session_id as bigint) % 2"
        side = 0 if "start_time" in documents.columns else 1
        _write_arrays(documents.drop("load_order").where(f"{half} = {side}"), chunks, "session_id")
    target, progress = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-progress")
    loaded = ingest_sessions(spark, chunks, target, progress, pattern="part-*")
    return plans.current_sessions(loaded)


def _write_arrays(df: DataFrame, path: str, key: str, pretty: bool = False) -> None:
    """JSON array files of about a thousand objects, as they come."""
    arrays = _arrays(df, key, pretty)
    arrays.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)


def _arrays(df: DataFrame, key: str, pretty: bool) -> DataFrame:
    """The text of each file.

    Rows are dealt out before they are gathered, to as many tasks as there are rows for: gathered rows stay in memory,
    so neither the size of the splits nor the number of shuffle partitions may decide how many a task holds.
    """
    piece = F.floor(F.col(key).cast("bigint") / 1000).alias("piece")
    dealt = _dealt(df.select(piece, F.struct("*").alias("object")), df.count())
    text = F.to_json(F.collect_list("object"), {"pretty": str(pretty).lower()})
    return dealt.groupBy("piece").agg(text.alias("value"))


ROWS_PER_WRITER = 25_000


def _dealt(keyed: DataFrame, rows: int) -> DataFrame:
    """Rows with those of a piece together, in as many tasks as there are rows for."""
    return keyed.repartition(-(-rows // ROWS_PER_WRITER) or 1, "piece")


def session_row_key(spark: SparkSession, folder: str) -> DataFrame:
    events = data.table(spark, folder, "events")
    key = fn.row_key(F.format_string("user_%06d", "user_id"), F.col("ts").cast("string"))
    keyed = events.select("event_id", key.alias("row_key"))
    return keyed.withColumn("key_user", fn.row_key_user(F.col("row_key")))


def session_upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    # Start times cut to the day, so that keys collide.
    sessions = _sessions(spark, folder, "date_trunc('day', ts)")
    kept = sessions.select("row_key", "session_id", "device_type", "duration", "load_order")
    return plans.current_sessions(kept)


def session_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Three loads whose keys collide, put one after the other into a table in ranges of its key."""
    sessions = _sessions(spark, folder, "date_trunc('day', ts)")
    loads = sessions.select("row_key", "session_id", "device_type", "duration", "load_order")
    path = scratch_path(spark, "session-ranges")
    last = data.table(spark, folder, "events").agg(F.max("event_id")).first()[0] or 0
    third = F.floor(F.col("load_order") * 3 / (last + 1))
    write_ranges(plans.current_sessions(loads.where(third == 0)), path, 24)
    for part in (1, 2):
        merge_ranges(spark, path, loads.where(third == part), unkeyed=~plans.has_key())
    return read_ranges(spark, path).drop("key_range")


def converted_sessions_in_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The first converted sessions, from the first ranges of a stored table."""
    path = scratch_path(spark, "session-ranges")
    write_ranges(_sessions(spark, folder).drop("load_order"), path, 64)
    wanted = F.col("conversion_status") == "converted"
    return plans.converted_sessions(first_ranges(spark, path, wanted, 10))


def user_sessions_in_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """One user's sessions, from the ranges that can hold them."""
    path = scratch_path(spark, "session-ranges")
    write_ranges(_sessions(spark, folder).drop("load_order"), path, 64)
    return plans.user_sessions(read_ranges(spark, path, "user_000000_"), "user_000000")


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Found by the prefix of the key in a stored table."""
    path = scratch_path(spark, "sessions-stored")
    write_sessions(_sessions(spark, folder).drop("load_order"), path)
    return plans.user_sessions(spark.read.parquet(path), "user_000000")


def converted_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return plans.converted_sessions(_sessions(spark, folder))


def device_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return plans.device_distribution(_sessions(spark, folder))


def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrive in files, half of them after a first run, loaded over three runs."""
    events = data.table(spark, folder, "events")
    arriving, target = scratch_path(spark, "events-arriving"), scratch_path(spark, "events")
    progress = scratch_path(spark, "events-progress")
    for part in (0, 1, None):
        if part is not None:
            new = events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part)
            new.repartition(3).write.mode("append").parquet(arriving)
        ingest_files(
            spark,
            arriving,
            data.SCHEMAS["events"],
            target,
            checkpoint=progress,
            file_format="parquet",
            pattern="*.parquet",
            max_files_per_batch=2,
        )
    return spark.read.schema(data.SCHEMAS["events"]).parquet(target)


def ingest_grown_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are sent in part, then whole, then once more, with a load after each."""
    documents = data.session_documents(spark, folder).drop("load_order")
    number = F.col("at")
    arriving, target = scratch_path(spark, "growing"), scratch_path(spark, "grown")
    # The second sending has each chunk's first half again and its other half behind it; the third is the second.
    parts = (number % 1000 < 500, F.lit(True), F.lit(True))
    made = scratch_path(spark, "sendings")
    _write_sendings(documents, made, "session_id", parts)
    for sending in range(len(parts)):
        _send(spark, made, arriving, sending)
        loaded = ingest_growing_sessions(spark, arriving, target)
    return loaded.drop("load_order")


def _write_sendings(df: DataFrame, path: str, key: str, parts: tuple[Column, ...]) -> None:
    """JSON array files of about a thousand objects, for each sending those of its part, in order of the key.

    Rows are dealt out before they are gathered, to as many tasks as there are rows for, and each task makes the
    files of all sendings, so a row is dealt out and turned into text once.
    """
    number = F.col(key).cast("bigint")
    keyed = df.select(F.struct("*").alias("object"), number.alias("at"), F.floor(number / 1000).alias("piece"))
    dealt = _dealt(keyed, df.count())
    chosen = [F.coalesce(part, F.lit(False)) for part in parts]
    one = F.struct("at", F.to_json("object").alias("text"), F.array(*chosen).alias("sent"))
    gathered = F.array_sort(F.collect_list("one")).alias("ones")
    pieces = dealt.select("piece", one.alias("one")).groupBy("piece").agg(gathered)

    def joined(sending: int) -> Column:
        chosen = F.filter("ones", lambda one: one["sent"][sending])
        return F.array_join(F.transform(chosen, lambda one: one["text"]), ",")

    files = pieces.select("piece", F.posexplode(F.array(*map(joined, range(len(parts))))).alias("sending", "objects"))
    text = F.concat(F.lit("["), "objects", F.lit("]")).alias("value")
    files.where("objects != ''").select("sending", "piece", text).write.partitionBy("sending", "piece").text(path)


def _send(spark: SparkSession, made: str, folder: str, sending: int) -> None:
    """Put each chunk in place of the one of that name."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    fs = path(made).getFileSystem(conf)
    fs.mkdirs(path(folder))
    found = fs.globStatus(path(f"{made}/sending={sending}/piece=*/part-*"))
    # Sent files differ in time even where a file system counts whole seconds.
    time = fs.getFileStatus(path(made)).getModificationTime() + 2000 * sending
    for source in spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found):
        piece = source.toString().split("/piece=")[1].split("/")[0]
        goal = path(f"{folder}/sessions_{piece}.json")
        if sending:
            fs.delete(goal, False)
        fs.rename(source, goal)
        fs.setTimes(goal, time, -1)


# Sources and sinks: a table written in a format and read back


PRODUCT_FIELDS = "product_id bigint, name string, category_id int, base_price decimal(18,4)"


def _products(spark: SparkSession, folder: str) -> DataFrame:
    return data.products(spark, folder).withColumn("base_price", F.col("base_price").cast("decimal(18,4)"))


def _read_back(spark: SparkSession, path: str, layout: str) -> DataFrame:
    found = read_collection(spark, path, PRODUCT_FIELDS, layout)
    return found.withColumn("base_price", F.col("base_price").cast("double"))


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json-lines")
    _products(spark, folder).write.json(path)
    return _read_back(spark, path, "auto")


def json_arrays(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json-arrays")
    _write_arrays(_products(spark, folder), path, "product_id")
    return _read_back(spark, path, "auto")


def json_array_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One array in one file on one line, cut into blocks."""
    path = scratch_path(spark, "json-line")
    products = _products(spark, folder)
    least = products.agg(F.min("product_id")).scalar()
    sign = F.when(F.col("product_id") == least, "[").otherwise(",")
    objects = products.select("product_id", F.concat(sign, F.to_json(F.struct("*"))).alias("value"))
    end = spark.range(1).select(F.lit(None).cast("bigint").alias("product_id"), F.lit("]").alias("value"))
    whole = objects.unionByName(end).coalesce(1).sortWithinPartitions(F.col("product_id").asc_nulls_last())
    whole.select("value").write.option("lineSep", " ").text(path)
    found = read_array_blocks(spark, path, PRODUCT_FIELDS)
    return found.drop("file", "place").withColumn("base_price", F.col("base_price").cast("double"))


def json_indented(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json-indented")
    _write_arrays(_products(spark, folder), path, "product_id", pretty=True)
    return _read_back(spark, path, "array")


def json_load_append(spark: SparkSession, folder: str) -> DataFrame:
    """A collection loaded with replacement, then once more, then appended to."""
    path, target = scratch_path(spark, "json-users"), scratch_path(spark, "users")
    data.users(spark, folder).select(F.col("user_id").cast("string")).write.json(path)
    load_collection(spark, "users", path, target)
    load_collection(spark, "users", path, target)
    loaded = load_collection(spark, "users", path, target, drop_first=False)
    return loaded.groupBy("user_id").agg(F.count("*").alias("rows"))


def unique_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a collection with a unique customer, in two loads that overlap: rows by what became of them."""
    orders = data.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    path = scratch_path(spark, "unique")
    for part in (0, 1):
        load_unique(orders.where(F.col("o_orderkey") % 2 == part), path, "o_custkey", order_by="o_orderkey")
    taken = read_unique(spark, path).withColumn("outcome", F.lit("taken"))
    others = set_aside(spark, path).select("o_orderkey", "o_custkey", F.col("reason").alias("outcome"))
    return taken.unionByName(others)


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Customer values as CSV in order, and back as numbers."""
    path = scratch_path(spark, "csv")
    write_result(_value(spark, folder), path, [F.col("total_revenue").desc()])
    columns = ["user_id", "total_revenue", "num_orders"]
    return read_result_csv(spark, path, columns, numeric=["total_revenue", "num_orders"])


def csv_ragged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rows of differing keys, in one CSV file with the union of the keys, and back."""
    k = F.get_json_object("props", "$.k")
    parts = {
        "click": ("event_id", "click_k", "user_id"),
        "purchase": ("user_id", "event_id", "event_type"),
    }
    values = {
        "event_id": F.col("event_id").cast("string"),
        "user_id": F.col("user_id").cast("string"),
        "event_type": F.col("event_type"),
        "click_k": k,
        "other_k": k,
    }

    def record(names: tuple[str, ...]) -> Column:
        return F.create_map(*(c for name in names for c in (F.lit(name), values[name])))

    kind = F.col("event_type")
    rows = F.when(kind == "click", record(parts["click"])).when(kind == "purchase", record(parts["purchase"]))
    rows = rows.otherwise(record(("other_k", "event_id")))
    path = scratch_path(spark, "csv-ragged")
    order = [F.col("user_id").desc(), F.col("event_id")]
    columns = write_ragged(
        data.table(spark, folder, "events").withColumn("record", rows), path, "record", order, single_file=True
    )
    return read_result_csv(spark, path, columns).withColumn("header", F.lit(",".join(columns)))


# Single operators


def time_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    return ops.in_time_range(data.transactions(spark, folder), "1997-01-01", "1997-12-31")


def line_total_fallback(spark: SparkSession, folder: str) -> DataFrame:
    flag, price = F.col("l_returnflag"), F.col("unit_price")
    lines = data.priced_lines(spark, folder).select(
        "transaction_id",
        "product_id",
        "quantity",
        F.when(flag == "A", F.col("subtotal")).alias("line_total"),
        F.when(flag == "R", price).alias("unit_price"),
        F.when(flag == "N", price).alias("price"),
    )
    total = fn.amount(ops.line_total_parts()).alias("line_total")
    return ops.order_lines(lines).select("transaction_id", "product_id", total)


def line_total_fine_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity times prices of four decimals: a thousandth of the line's price per unit."""
    price = (F.floor(F.col("subtotal") / F.col("quantity") / 1000 * 10000) / 10000).alias("unit_price")
    lines = data.lines(spark, folder).select("transaction_id", "product_id", "quantity", price)
    total = F.sum(ops.line_total_parts())
    return ops.order_lines(lines).groupBy("product_id").agg(fn.amount(total).alias("revenue"))


def top_products_six_decimals(spark: SparkSession, folder: str) -> DataFrame:
    """Best sellers by prices of six decimals: a millionth of the line's price per unit, of which nothing is lost."""
    millionths = F.floor(F.col("subtotal") / F.col("quantity")).cast("decimal(12,0)")
    price = (millionths * F.expr("0.000001BD")).cast("decimal(18,6)").alias("unit_price")
    lines = data.lines(spark, folder).select("transaction_id", "product_id", "quantity", price)
    return plans.top_products(lines, data.products(spark, folder), limit=50)


def parse_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    events = data.table(spark, folder, "events")
    exact = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return events.select(
        "event_id",
        fn.parse_iso(exact).alias("ts"),
        fn.parse_iso_seconds(whole).alias("ts_seconds"),
        fn.parse_iso_seconds(exact).isNull().alias("fraction_rejected"),
    )


def numeric_coerce_dropna(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr("substring(o_orderpriority, 1, cast(o_orderkey % 2 + 1 as int))").alias("n")
    orders = data.table(spark, folder, "orders").select("o_orderkey", text)
    return ops.coerce_numeric(orders, "n")


def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.table_counts(
        {
            "users": data.users(spark, folder),
            "categories": data.categories(spark, folder),
            "products": data.products(spark, folder),
            "transactions": data.transactions(spark, folder),
        }
    )


def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return ops.duplicate_keys(data.lines(spark, folder), "transaction_id", "product_id")


def sql_script(spark: SparkSession, folder: str) -> DataFrame:
    data.table(spark, folder, "lineitem").createOrReplaceTempView("script_lines")
    script = """
        create or replace temporary view script_flags as
        select l_returnflag, l_linestatus, cast(l_extendedprice as decimal(14,2)) as price
        from script_lines;

        select l_returnflag, l_linestatus, count(*) as lines, cast(sum(price) as double) as revenue
        from script_flags group by l_returnflag, l_linestatus;
    """
    return run_sql_script(spark, script)[-1]


def entry(spark: SparkSession) -> DataFrame:
    """Revenue by category and month on the smallest tables."""
    folder = "/root/testdata/sf0.001"
    return revenue_by_category(tune(spark, folder), folder)


def queries() -> dict[str, Query]:
    """Every query by name; each takes (spark, folder of the tables)."""
    plain = [
        line_items,
        line_items_hot_products,
        dedupe_basket,
        also_bought,
        also_bought_large_baskets,
        also_bought_pruned,
        copurchase_totals,
        cohort_retention,
        customer_value,
        customer_value_from_items,
        user_segmentation,
        user_segmentation_range,
        customer_segments,
        customer_scatter,
        box_stats,
        quantiles_bracketed,
        top_products,
        top_products_range,
        revenue_by_category,
        revenue_by_category_range,
        category_timeline,
        session_flatten,
        session_flatten_alternatives,
        session_row_key,
        session_upsert_latest,
        session_merge,
        user_sessions,
        user_sessions_in_ranges,
        converted_sessions,
        converted_sessions_in_ranges,
        device_distribution,
        incremental_ingest,
        ingest_grown_chunks,
        json_lines,
        json_arrays,
        json_array_blocks,
        json_indented,
        json_load_append,
        unique_loads,
        csv_round_trip,
        csv_ragged_rows,
        time_range_filter,
        line_total_fallback,
        line_total_fine_prices,
        top_products_six_decimals,
        parse_timestamps,
        numeric_coerce_dropna,
        table_counts,
        duplicate_keys,
        sql_script,
    ]
    named = {query.__name__: query for query in plain}
    named["histogram_revenue"] = _histogram("total_revenue")
    named["histogram_orders"] = _histogram("num_orders")
    named["histogram_avg_transaction"] = _histogram("avg_transaction")
    if training_text:
        named |= training_text.queries()
        named["pipeline"] = corpus_pipeline.run

    def tuned(query: Query) -> Query:
        return lambda spark, folder: query(tune(spark, folder), folder)

    return {name: tuned(query) for name, query in named.items()}


# The same results in DuckDB SQL.

_MONEY = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
_UNIT_CENTS = "CAST(ROUND(p_retailprice * 100) AS BIGINT)"
_REVENUE_CENTS = f"CAST(l_quantity AS BIGINT) * {_UNIT_CENTS}"
_REVENUE = f"CAST(SUM({_REVENUE_CENTS}) AS DOUBLE) / 100"

_PAIRS = """
    baskets AS (
        SELECT DISTINCT l_orderkey AS t, l_partkey AS p FROM lineitem
        WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL
    ),
    best AS (
        SELECT a.p AS product_a, b.p AS product_b, COUNT(*) AS co_count
        FROM baskets a JOIN baskets b ON a.t = b.t AND a.p < b.p
        GROUP BY a.p, b.p
        ORDER BY co_count DESC, product_a, product_b LIMIT 10
    ),
    pairs AS (
        SELECT product_a, x.p_name AS product_a_name, product_b, y.p_name AS product_b_name, co_count
        FROM best LEFT JOIN part x ON x.p_partkey = product_a LEFT JOIN part y ON y.p_partkey = product_b
    )
"""

_VALUE = f"""
    value AS (
        SELECT o_custkey AS user_id, {_MONEY.format("o_totalprice")} AS total_revenue,
               COUNT(DISTINCT o_orderkey) AS num_orders,
               MIN(o_orderdate) AS first_purchase, MAX(o_orderdate) AS last_purchase,
               CAST(datediff('day', MIN(o_orderdate), MAX(o_orderdate)) AS INTEGER) AS active_days
        FROM orders GROUP BY o_custkey
    )
"""

_CATEGORY_REVENUE = f"""
    revenue AS (
        SELECT p_size % 25 AS category_id, strftime(o_orderdate, '%Y-%m') AS year_month,
               {_REVENUE} AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2
    ),
    named AS (
        SELECT category_id, year_month, revenue, n_name AS category_name
        FROM revenue LEFT JOIN nation ON n_nationkey = category_id
    )
"""

_PRODUCTS = """
    SELECT p_partkey AS product_id, p_name AS name, p_size % 25 AS category_id, p_retailprice AS base_price
    FROM part
"""

_SESSIONS = """
    keyed AS (
        SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
    ),
    sessions AS (
        SELECT printf('user_%06d', user_id) || '_' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS row_key,
               printf('user_%06d', user_id) AS user_id,
               CAST(event_id AS VARCHAR) AS session_id,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS start_time,
               strftime(ts + to_seconds(k), '%Y-%m-%dT%H:%M:%S.%f') AS end_time,
               k AS duration,
               CASE WHEN event_type = 'purchase' THEN 'converted' ELSE 'browsed' END AS conversion_status,
               'referrer_' || k % 5 AS referrer,
               event_type AS device_type, 'os_' || k % 3 AS device_os, 'browser_' || k % 4 AS browser,
               'city_' || user_id % 10 AS city, 'state_' || user_id % 5 AS state,
               'country' AS country, '10.0.0.' || k AS ip_address,
               '["prod_' || k || '"]' AS viewed_products,
               '{"prod_' || k || '":{"quantity":1}}' AS cart_contents,
               k % 4 AS page_views_count
        FROM keyed
    )
"""


def _histogram_sql(expression: str, bins: int) -> str:
    return f"""
        WITH {_VALUE},
        x AS (SELECT CAST({expression} AS DOUBLE) AS x FROM value WHERE {expression} IS NOT NULL),
        s AS (
            SELECT MIN(x) - CASE WHEN MIN(x) = MAX(x) THEN 0.5 ELSE 0 END AS lo,
                   MAX(x) + CASE WHEN MIN(x) = MAX(x) THEN 0.5 ELSE 0 END AS hi FROM x
        ),
        e AS (
            SELECT i AS bin, lo + i * ((hi - lo) / {bins}) AS lower,
                   CASE WHEN i = {bins} - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS upper
            FROM s, range({bins}) r(i)
        )
        SELECT bin, lower, upper, COUNT(x) AS count
        FROM e LEFT JOIN x ON x >= lower AND (x < upper OR (bin = {bins} - 1 AND x <= upper))
        GROUP BY bin, lower, upper
    """


def _box_sql() -> str:
    measures = {
        "total_revenue": "total_revenue",
        "orders_x1000": "num_orders * 1000",
        "avg_transaction": "total_revenue / num_orders",
    }
    parts = [
        f"""
        SELECT '{metric}' AS metric, ROUND(q1, 4) AS q1, ROUND(q2, 4) AS median, ROUND(q3, 4) AS q3,
               ROUND(LEAST(MIN(x) FILTER (x >= q1 - (q3 - q1) * 1.5), q1), 4) AS whisker_low,
               ROUND(GREATEST(MAX(x) FILTER (x <= q3 + (q3 - q1) * 1.5), q3), 4) AS whisker_high,
               COUNT(*) FILTER (x < q1 - (q3 - q1) * 1.5 OR x > q3 + (q3 - q1) * 1.5) AS outliers
        FROM (SELECT CAST({expression} AS DOUBLE) AS x FROM value),
             (SELECT quantile_cont(CAST({expression} AS DOUBLE), 0.25) AS q1,
                     quantile_cont(CAST({expression} AS DOUBLE), 0.5) AS q2,
                     quantile_cont(CAST({expression} AS DOUBLE), 0.75) AS q3 FROM value)
        GROUP BY q1, q2, q3
        """
        for metric, expression in measures.items()
    ]
    return f"WITH {_VALUE} " + " UNION ALL ".join(parts)


def _segments_sql() -> str:
    levels = "CASE WHEN {0} <= {1}[1] THEN 0 WHEN {0} <= {1}[2] THEN 1 WHEN {0} <= {1}[3] THEN 2 ELSE 3 END"
    counts = ", ".join(
        f"COUNT(*) FILTER (f = {j}) AS {name}" for j, name in enumerate(plans.customers.FREQUENCY_LEVELS)
    )
    names = ", ".join(f"({i}, '{name}')" for i, name in enumerate(plans.customers.SPENDING_LEVELS))
    return f"""
        WITH {_VALUE},
        q AS (
            SELECT quantile_cont(total_revenue, [0.25, 0.5, 0.75]) AS r,
                   quantile_cont(CAST(num_orders AS DOUBLE), [0.25, 0.5, 0.75]) AS n FROM value
        ),
        levels AS (
            SELECT {levels.format("total_revenue", "r")} AS s, {levels.format("num_orders", "n")} AS f
            FROM value, q
        )
        SELECT spending, {counts}
        FROM (VALUES {names}) v(i, spending) LEFT JOIN levels ON s = i GROUP BY spending
    """


_LATEST_SESSIONS = """
    SELECT printf('user_%06d', user_id) || '_' || strftime(ts, '%Y-%m-%d') || 'T00:00:00.000000' AS row_key,
           CAST(MAX(event_id) AS VARCHAR) AS session_id,
           arg_max(event_type, event_id) AS device_type,
           CAST(json_extract_string(arg_max(props, event_id), '$.k') AS INTEGER) AS duration
    FROM events GROUP BY 1
"""

_USER_SESSIONS = f"""
    WITH {_SESSIONS}
    SELECT row_key, session_id, start_time, duration, conversion_status, device_type, browser,
           city, state, page_views_count AS page_views
    FROM sessions WHERE starts_with(row_key, 'user_000000_') ORDER BY row_key, session_id LIMIT 10
"""

_CONVERTED = f"""
    WITH {_SESSIONS}
    SELECT row_key, user_id, session_id, start_time, duration, device_type, referrer
    FROM sessions WHERE conversion_status = 'converted' ORDER BY row_key, session_id LIMIT 10
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over the same tables, for each query that SQL can express."""
    found = {
        "line_items": f"""
            SELECT l_orderkey AS transaction_id, o_custkey AS user_id, o_orderdate AS "timestamp",
                   l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
                   {_UNIT_CENTS} / 100 AS unit_price, l_extendedprice AS subtotal,
                   p_name AS product_name, p_size % 25 AS category_id
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        """,
        "line_items_hot_products": f"""
            WITH moved AS (
                SELECT *, CASE WHEN l_partkey % 4 = 0 THEN l_partkey ELSE l_partkey % 5 + 1 END AS product_id FROM lineitem
            )
            SELECT l_orderkey AS transaction_id, o_custkey AS user_id, o_orderdate AS "timestamp",
                   product_id, CAST(l_quantity AS INTEGER) AS quantity,
                   {_UNIT_CENTS.replace("p_retailprice", "price.p_retailprice")} / 100 AS unit_price, l_extendedprice AS subtotal,
                   named.p_name AS product_name, named.p_size % 25 AS category_id
            FROM moved JOIN orders ON l_orderkey = o_orderkey JOIN part price ON l_partkey = price.p_partkey
                 LEFT JOIN part named ON product_id = named.p_partkey
        """,
        "dedupe_basket": """
            SELECT DISTINCT l_orderkey AS transaction_id, l_partkey AS product_id FROM lineitem
            WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL
        """,
        "also_bought": f"WITH {_PAIRS} SELECT * FROM pairs",
        "copurchase_totals": f"""
            WITH {_PAIRS}
            SELECT product_name, CAST(SUM(co_count) AS BIGINT) AS co_purchases
            FROM (SELECT product_a_name AS product_name, co_count FROM pairs
                  UNION ALL SELECT product_b_name, co_count FROM pairs)
            GROUP BY product_name ORDER BY co_purchases DESC, product_name LIMIT 15
        """,
        "cohort_retention": """
            WITH months AS (
                SELECT o_custkey AS u, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders
                WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
            ),
            firsts AS (SELECT u, MIN(m) AS c FROM months GROUP BY u),
            active AS (
                SELECT c, CAST(datediff('month', c, m) AS BIGINT) AS i, COUNT(DISTINCT u) AS n
                FROM months JOIN firsts USING (u) GROUP BY 1, 2
            )
            SELECT a.c AS cohort_month, a.i AS cohort_index, a.n AS active_users, z.n AS cohort_size,
                   a.n / z.n AS retention_rate
            FROM active a LEFT JOIN active z ON a.c = z.c AND z.i = 0
        """,
        "customer_value": f"WITH {_VALUE} SELECT * FROM value",
        "customer_value_from_items": f"""
            SELECT o_custkey AS user_id, {_MONEY.format("l_extendedprice")} AS clv,
                   COUNT(DISTINCT l_orderkey) AS num_orders
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
        """,
        "user_segmentation": f"""
            WITH tx AS (
                SELECT l_orderkey AS t, MIN(o_custkey) AS u, MIN(o_orderdate) AS d,
                       SUM({_REVENUE_CENTS}) AS s
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
                GROUP BY l_orderkey
            ),
            people AS (SELECT u, COUNT(*) AS n, SUM(s) AS s, MAX(d) AS d FROM tx GROUP BY u)
            SELECT CASE WHEN n >= 0 AND n < 1 THEN '0' WHEN n >= 1 AND n < 3 THEN '1'
                        WHEN n >= 3 AND n < 5 THEN '3' WHEN n >= 5 AND n < 10 THEN '5'
                        WHEN n >= 10 AND n < 1000 THEN '10' ELSE 'other' END AS bucket,
                   COUNT(*) AS customers, SUM(n) / COUNT(*) AS avg_orders,
                   CAST(SUM(s) AS DOUBLE) / 100 / COUNT(*) AS avg_spend, MAX(d) AS max_last_order_at
            FROM people GROUP BY 1
        """,
        "customer_segments": _segments_sql(),
        "customer_scatter": f"WITH {_VALUE} SELECT num_orders, total_revenue, active_days FROM value",
        "box_stats": _box_sql(),
        "histogram_revenue": _histogram_sql("total_revenue", 50),
        "histogram_orders": _histogram_sql("num_orders", 30),
        "histogram_avg_transaction": _histogram_sql("total_revenue / num_orders", 50),
        "top_products": f"""
            SELECT l_partkey AS product_id, MIN(p_name) AS product_name,
                   MIN(p_size % 25) AS category_id, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_qty,
                   {_REVENUE} AS total_revenue, COUNT(DISTINCT l_orderkey) AS orders
            FROM lineitem JOIN part ON l_partkey = p_partkey
            GROUP BY l_partkey ORDER BY total_revenue DESC, total_qty DESC, product_id LIMIT 20
        """,
        "revenue_by_category": f"WITH {_CATEGORY_REVENUE} SELECT * FROM named",
        "category_timeline": f"""
            WITH {_CATEGORY_REVENUE}
            SELECT COALESCE(category_name, CAST(category_id AS VARCHAR)) AS category_name,
                   CAST(year_month || '-01' AS DATE) AS month, revenue
            FROM named WHERE revenue IS NOT NULL
        """,
        "session_flatten": f"WITH {_SESSIONS} SELECT * FROM sessions",
        "session_flatten_alternatives": f"""
            WITH {_SESSIONS}
            SELECT * EXCLUDE (nth, cart_contents), replace(cart_contents, '}}}}', ',"price":null}}}}') AS cart_contents FROM (
                SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY CAST(session_id AS BIGINT) DESC) AS nth
                FROM sessions
            ) WHERE nth = 1
        """,
        "session_row_key": """
            SELECT event_id, printf('user_%06d', user_id) || '_' || regexp_replace(regexp_replace(
                       CAST(ts AS VARCHAR), '\\s+', '_', 'g'), '[^0-9A-Za-z_\\-:.T]', '', 'g') AS row_key,
                   printf('user_%06d', user_id) AS key_user
            FROM events
        """,
        "top_products_six_decimals": """
            SELECT l_partkey AS product_id, any_value(p_name) AS product_name, any_value(p_size) % 25 AS category_id,
                   CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_qty,
                   CAST(SUM(CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice / l_quantity) AS BIGINT)) AS DOUBLE)
                       / 1000000 AS total_revenue,
                   COUNT(DISTINCT l_orderkey) AS orders
            FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
            GROUP BY l_partkey ORDER BY total_revenue DESC, total_qty DESC, product_id LIMIT 50
        """,
        "unique_loads": """
            WITH loads AS (SELECT o_orderkey, o_custkey, o_orderkey % 2 AS load FROM orders),
            ranked AS (
                SELECT *, row_number() OVER (PARTITION BY o_custkey, load ORDER BY o_orderkey) AS nth,
                       min(load) OVER (PARTITION BY o_custkey) AS first_load
                FROM loads
            )
            SELECT o_orderkey, o_custkey, CASE WHEN load > first_load THEN 'known' WHEN nth = 1 THEN 'taken'
                                               ELSE 'repeated' END AS outcome
            FROM ranked
        """,
        "session_merge": _LATEST_SESSIONS,
        "json_array_blocks": _PRODUCTS,
        "user_sessions_in_ranges": _USER_SESSIONS,
        "converted_sessions_in_ranges": _CONVERTED,
        "ingest_grown_chunks": f"""
            WITH {_SESSIONS}
            SELECT * EXCLUDE (cart_contents), replace(cart_contents, '}}}}', ',"price":null}}}}') AS cart_contents
            FROM sessions
        """,
        "csv_ragged_rows": """
            WITH named AS (
                SELECT *, json_extract_string(props, '$.k') AS k,
                       CASE event_type WHEN 'click' THEN ['event_id', 'click_k', 'user_id']
                            WHEN 'purchase' THEN ['user_id', 'event_id', 'event_type']
                            ELSE ['other_k', 'event_id'] END AS names
                FROM events
            ),
            spread AS (
                SELECT user_id, event_id, unnest(names) AS name, unnest(range(len(names))) AS nth FROM named
            ),
            firsts AS (
                SELECT name, min({'a': -user_id, 'b': event_id, 'c': nth}) AS first FROM spread GROUP BY name
            ),
            header AS (SELECT string_agg(name, ',' ORDER BY first) AS header FROM firsts)
            SELECT CAST(event_id AS VARCHAR) AS event_id,
                   CASE WHEN event_type IN ('click', 'purchase') THEN CAST(user_id AS VARCHAR) END AS user_id,
                   CASE WHEN event_type = 'purchase' THEN event_type END AS event_type,
                   CASE WHEN event_type = 'click' THEN k END AS click_k,
                   CASE WHEN event_type NOT IN ('click', 'purchase') THEN k END AS other_k, header
            FROM named, header
        """,
        "session_upsert_latest": _LATEST_SESSIONS,
        "user_sessions": _USER_SESSIONS,
        "converted_sessions": _CONVERTED,
        "device_distribution": """
            SELECT event_type AS device_type, COUNT(*) AS sessions,
                   COUNT(*) / (SELECT COUNT(*) FROM events) * 100 AS pct
            FROM events GROUP BY event_type
        """,
        "incremental_ingest": "SELECT * FROM events",
        "json_lines": _PRODUCTS,
        "json_arrays": _PRODUCTS,
        "json_indented": _PRODUCTS,
        "json_load_append": """
            SELECT CAST(c_custkey AS VARCHAR) AS user_id, 2 * COUNT(*) AS rows FROM customer GROUP BY 1
        """,
        "csv_round_trip": f"""
            WITH {_VALUE}
            SELECT CAST(user_id AS VARCHAR) AS user_id, total_revenue, CAST(num_orders AS DOUBLE) AS num_orders FROM value
        """,
        "line_total_fine_prices": """
            SELECT l_partkey AS product_id, CAST(SUM(CAST(l_quantity AS BIGINT)
                       * CAST(floor(l_extendedprice / l_quantity / 1000 * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS revenue
            FROM lineitem GROUP BY 1
        """,
        "quantiles_bracketed": f"""
            SELECT CAST(unnest(range({len(PROBABILITIES)})) AS INTEGER) AS place,
                   unnest([round(q, 4) for q in quantile_cont(l_extendedprice, {list(PROBABILITIES)})]) AS value
            FROM lineitem
        """,
        "also_bought_large_baskets": f"WITH {_PAIRS} SELECT * FROM pairs",
        "also_bought_pruned": f"WITH {_PAIRS} SELECT * FROM pairs",
        "top_products_range": f"""
            SELECT l_partkey AS product_id, MIN(p_name) AS product_name,
                   MIN(p_size % 25) AS category_id, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_qty,
                   {_REVENUE} AS total_revenue, COUNT(DISTINCT l_orderkey) AS orders
            FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
            WHERE o_orderdate >= '1995-01-01' AND o_orderdate <= '1996-12-31'
            GROUP BY l_partkey ORDER BY total_revenue DESC, total_qty DESC, product_id LIMIT 15
        """,
        "revenue_by_category_range": f"""
            SELECT p_size % 25 AS category_id, strftime(o_orderdate, '%Y-%m') AS year_month, {_REVENUE} AS revenue
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
            WHERE o_orderdate >= '1995-06-01' AND o_orderdate <= '1996-05-31'
            GROUP BY 1, 2
        """,
        "user_segmentation_range": f"""
            WITH tx AS (
                SELECT l_orderkey AS t, MIN(o_custkey) AS u, MIN(o_orderdate) AS d,
                       SUM({_REVENUE_CENTS}) AS s
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
                WHERE o_orderdate >= '1995-01-01' AND o_orderdate <= '1996-12-31'
                GROUP BY l_orderkey
            ),
            people AS (SELECT u, COUNT(*) AS n, SUM(s) AS s, MAX(d) AS d FROM tx GROUP BY u)
            SELECT CASE WHEN n >= 1 AND n < 2 THEN '1' WHEN n >= 2 AND n < 3 THEN '2'
                        WHEN n >= 3 AND n < 5 THEN '3' WHEN n >= 5 AND n < 8 THEN '5' ELSE 'other' END AS bucket,
                   COUNT(*) AS customers, SUM(n) / COUNT(*) AS avg_orders,
                   CAST(SUM(s) AS DOUBLE) / 100 / COUNT(*) AS avg_spend, MAX(d) AS max_last_order_at
            FROM people GROUP BY 1
        """,
        "time_range_filter": """
            SELECT o_orderkey AS transaction_id, o_custkey AS user_id, o_orderdate AS "timestamp",
                   o_totalprice AS total, o_orderstatus AS status
            FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate <= '1997-12-31'
        """,
        "line_total_fallback": f"""
            SELECT l_orderkey AS transaction_id, l_partkey AS product_id,
                   CASE WHEN l_returnflag = 'A' THEN l_extendedprice
                        ELSE {_REVENUE_CENTS} / 100
                   END AS line_total
            FROM lineitem JOIN part ON l_partkey = p_partkey
        """,
        "parse_timestamps": """
            SELECT event_id, ts, date_trunc('second', ts) AS ts_seconds, TRUE AS fraction_rejected
            FROM events
        """,
        "numeric_coerce_dropna": """
            SELECT o_orderkey, TRY_CAST(substring(o_orderpriority, 1, CAST(o_orderkey % 2 + 1 AS INTEGER)) AS DOUBLE) AS n
            FROM orders
            WHERE TRY_CAST(substring(o_orderpriority, 1, CAST(o_orderkey % 2 + 1 AS INTEGER)) AS DOUBLE) IS NOT NULL
        """,
        "table_counts": """
            SELECT 'users' AS "table", COUNT(*) AS "rows" FROM customer
            UNION ALL SELECT 'categories', COUNT(*) FROM nation
            UNION ALL SELECT 'products', COUNT(*) FROM part
            UNION ALL SELECT 'transactions', COUNT(*) FROM orders
        """,
        "duplicate_keys": """
            SELECT l_orderkey AS transaction_id, l_partkey AS product_id, COUNT(*) AS count
            FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1
        """,
        "sql_script": f"""
            SELECT l_returnflag, l_linestatus, COUNT(*) AS lines, {_MONEY.format("l_extendedprice")} AS revenue
            FROM lineitem GROUP BY l_returnflag, l_linestatus
        """,
    }
    if training_text:
        found |= training_text.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
