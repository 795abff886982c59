import pytest
from pyspark.sql import functions as F

from conftest import rows
from shoplens.operators import hot_keys, join_hot
from shoplens.plans import line_items

ALONE = {  # nothing but the plan itself helps
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "false",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name, value in ALONE.items():
        spark.conf.set(name, value)
    yield
    for name in ALONE:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def facts(spark):
    """A third of the rows on one key, another third without a key."""
    return spark.range(0, 90_000, 1, 6).selectExpr(
        "id", "case id % 3 when 0 then 'hot' when 1 then null else concat('k', id % 4000) end as k"
    )


@pytest.fixture
def names(spark):
    return spark.range(3000).selectExpr("concat('k', id) as k", "concat('n', id) as name").unionByName(
        spark.createDataFrame([("hot", "h"), (None, "nobody")], "k string, name string")
    )


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_keys(spark, facts):
    found = spark.range(1).select(hot_keys(facts, "k", 0.05).alias("hot")).first().hot
    assert found == ["hot"]
    assert spark.range(1).select(hot_keys(facts.limit(0), "k", 0.05).alias("hot")).first().hot == []
    with pytest.raises(ValueError):
        hot_keys(facts, "k", 0.0001)


def test_a_hot_key_is_dealt_out(alone, facts, names):
    plain = facts.join(names, "k", "left")
    salted = join_hot(facts, names, "k", salts=48)
    assert largest_share(plain) > 0.3
    assert largest_share(salted) < 0.15
    assert salted.columns == plain.columns
    assert sorted(map(str, rows(salted))) == sorted(map(str, rows(plain)))


def test_repeated_and_unknown_keys(alone, spark, facts):
    twice = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k2", "c"), ("other", "d")], "k string, name string")
    some = facts.where("id < 600")
    plain, salted = some.join(twice, "k", "left"), join_hot(some, twice, "k", salts=5, share=0.1)
    assert sorted(map(str, rows(salted))) == sorted(map(str, rows(plain)))
    assert join_hot(some.limit(0), twice, "k").count() == 0
    assert join_hot(some, twice.limit(0), "k").where("name is not null").count() == 0


def test_lines_of_a_hot_product(alone, spark):
    lines = spark.range(0, 60_000, 1, 6).selectExpr(
        "id as transaction_id", "'u' as user_id", "timestamp_ntz'2025-01-01' as timestamp",
        "if(id % 3 = 0, 7, id % 2000) as product_id", "1 as quantity", "2.0d as unit_price", "2.0d as subtotal",
    )
    catalog = spark.range(2000).selectExpr("id as product_id", "concat('n', id) as name", "id % 25 as category_id")
    plain, salted = line_items(lines, catalog), line_items(lines, catalog, salts=32)
    assert largest_share(plain) > 0.3 > 0.15 > largest_share(salted)
    assert salted.columns == plain.columns
    assert sorted(rows(salted)) == sorted(rows(plain))
