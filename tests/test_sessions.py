import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from shoplens.functions import row_key, row_key_part, row_key_user
from shoplens.operators import flatten_sessions, latest_by_key
from shoplens.plans import converted_sessions, device_distribution, user_sessions
from shoplens.sources import schemas


def sessions(spark, *documents, schema=schemas.SESSIONS_ANY):
    text = spark.createDataFrame([(json.dumps(d),) for d in documents], "line string")
    return text.select(F.from_json("line", schema).alias("d")).select("d.*")


NESTED = {
    "session_id": "s1",
    "user_id": "user_000042",
    "start_time": "2025-03-12T14:37:22",
    "end_time": "2025-03-12T15:00:00",
    "duration_seconds": 90,
    "geo_data": {"city": "Ulm", "state": "BW", "country": "DE", "ip_address": "1.2.3.4"},
    "device_profile": {"type": "mobile", "os": "iOS", "browser": "Safari"},
    "viewed_products": ["p1", "p2"],
    "page_views": [{"page_type": "home"}, {"page_type": "cart"}],
    "cart_contents": {"p1": {"quantity": 2, "price": 1.5}},
    "conversion_status": "converted",
    "referrer": "email",
}


def test_nested_session(spark):
    row = flatten_sessions(sessions(spark, NESTED, schema=schemas.SESSIONS)).first()
    assert row.row_key == "user_000042_2025-03-12T14:37:22"
    assert (row.duration, row.page_views_count) == (90, 2)
    assert (row.device_type, row.device_os, row.browser) == ("mobile", "iOS", "Safari")
    assert (row.city, row.state, row.country, row.ip_address) == ("Ulm", "BW", "DE", "1.2.3.4")
    assert json.loads(row.viewed_products) == ["p1", "p2"]
    assert json.loads(row.cart_contents) == {"p1": {"quantity": 2, "price": 1.5}}
    assert len(row) == 18  # row key, user and the 16 stored columns


def test_alternative_and_flat_names(spark):
    renamed = {
        "session_id": "s2",
        "user_id": "u",
        "timestamp": "2025-01-01T00:00:00",
        "duration": 5,
        "device": {"type": "tablet", "browser": "Edge"},
        "geo": {"city": "Bonn"},
    }
    flat = {
        "session_id": "s3",
        "user_id": "u",
        "start_time": "2025-01-01T00:00:01",
        "device_type": "desktop",
        "device_profile": {"type": "mobile", "os": "iOS"},
        "city": "Jena",
        "page_views_count": 4,
    }
    second, third = flatten_sessions(sessions(spark, renamed, flat)).orderBy("session_id").collect()
    assert (second.row_key, second.duration, second.page_views_count) == ("u_2025-01-01T00:00:00", 5, 0)
    assert (second.device_type, second.browser, second.city) == ("tablet", "Edge", "Bonn")
    assert (second.viewed_products, second.cart_contents) == ("[]", "{}")
    assert (third.device_type, third.device_os, third.city) == ("desktop", "iOS", "Jena")
    assert third.page_views_count == 4


def test_columns_that_are_no_structs_count_as_missing(spark):
    df = spark.sql("select 's' as session_id, 'u' as user_id, 'x' as start_time, 'phone' as device_profile")
    row = flatten_sessions(df).first()
    assert (row.device_type, row.city, row.page_views_count) == (None, None, 0)


@pytest.mark.parametrize(
    "user, start, key",
    [
        ("user_1", "2025-01-01 10:00:00", "user_1_2025-01-01_10:00:00"),
        ("a  b\tc", "t", "a_b_c_t"),
        ("ü/ser#7", "1.5", "ser7_1.5"),
        (None, None, "_"),
    ],
)
def test_row_keys(spark, user, start, key):
    df = spark.createDataFrame([(user, start)], "u string, s string")
    assert df.select(row_key(F.col("u"), F.col("s"))).first()[0] == key


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=12), min_size=1, max_size=30))
def test_row_key_parts_equal_python_regexes(spark, texts):
    texts += [f"a{c}b" for c in "\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff"]
    expected = [re.sub(r"[^0-9A-Za-z_\-:.T]", "", re.sub(r"\s+", "_", t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(row_key_part(F.col("t"))).collect()] == expected


def test_user_of_key(spark):
    df = spark.createDataFrame([("user_000042_2025_x",), ("solo",)], "k string")
    assert [r[0] for r in df.select(row_key_user(F.col("k"))).collect()] == ["user_000042", "solo"]


def test_same_second_collapses_to_the_last(spark):
    df = spark.createDataFrame(
        [("k", 1, "old", None), ("k", 3, "new", None), ("k", 2, "mid", "x"), ("j", 1, "only", "y")],
        "row_key string, load_order int, session_id string, city string",
    )
    newest = latest_by_key(df, ["row_key"], F.col("load_order"))
    assert sorted(rows(newest)) == [("j", 1, "only", "y"), ("k", 3, "new", None)]


def many(spark):
    documents = [
        NESTED
        | {
            "session_id": f"s{i:02d}",
            "user_id": f"user_{i % 3:06d}",
            "start_time": f"2025-01-01T00:00:{i:02d}",
            "conversion_status": "converted" if i % 4 == 0 else "browsed",
            "device_profile": {"type": ["mobile", "desktop", None][i % 3]},
        }
        for i in range(20)
    ]
    return flatten_sessions(sessions(spark, *documents, schema=schemas.SESSIONS))


def test_user_sessions(spark):
    got = user_sessions(many(spark), "user_000001", limit=3).collect()
    assert [r.session_id for r in got] == ["s01", "s04", "s07"]
    assert got[0].asDict().keys() == {
        "row_key",
        "session_id",
        "start_time",
        "duration",
        "conversion_status",
        "device_type",
        "browser",
        "city",
        "state",
        "page_views",
    }


def test_converted_sessions_scan_limit(spark):
    everything = converted_sessions(many(spark), limit=10, scan_limit=None).collect()
    assert [r.session_id for r in everything] == ["s00", "s12", "s04", "s16", "s08"]
    assert everything[0].user_id == "user_000000"
    some = converted_sessions(many(spark), limit=10, scan_limit=7).collect()
    assert [r.session_id for r in some] == ["s00", "s12"]


def test_device_distribution(spark):
    assert rows(device_distribution(many(spark))) == [
        ("desktop", 7, 35.0),
        ("mobile", 7, 35.0),
        ("", 6, 30.0),
    ]
    labelled = device_distribution(many(spark), sample_size=8, missing_label="unknown")
    assert rows(labelled) == [("mobile", 7, 87.5), ("desktop", 1, 12.5)]
