import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoplens.plans import converted_sessions, has_key, user_sessions
from shoplens.sources import bounds_of, first_ranges, merge_ranges, read_ranges, write_ranges
from shoplens.sources.ranges import Bounds

SCHEMA = "row_key string, session_id string, conversion_status string, load_order long"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def contents(spark, path):
    return sorted((r.row_key, r.session_id, r.conversion_status) for r in read_ranges(spark, path).collect())


def key(i):
    return f"user_{i % 100:06d}_2025-01-01T00:00:{i:02d}"


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "sessions")
    rows = [(key(i), f"s{i}", "converted" if i % 10 == 9 else "browsed", i) for i in range(200)]
    write_ranges(frame(spark, *rows).drop("load_order"), path, 16)
    return path


def opened(df):
    """Ranges a plan reads after its filters on the folders."""
    return {r.key_range for r in df.select("key_range").distinct().collect()}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab_", max_size=3), min_size=1, max_size=9), st.lists(st.text("ab_c", max_size=4), min_size=1))
def test_range_of_a_key(spark, least, keys):
    least = sorted(least)
    bounds = Bounds(least, [10 * k for k in range(len(least))])
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", bounds.number_of(F.col("k")).alias("n"))
    for row in df.collect():
        below = [i for i, bound in enumerate(least) if bound <= row.k]
        assert row.n == 10 * (below[-1] if below else 0)
    for prefix in keys:
        inside = set(bounds.with_prefix(prefix))
        for k, number in ((r.k, r.n) for r in df.collect()):
            assert not k.startswith(prefix) or number in inside


def test_a_prefix_below_all_bounds_is_in_the_first_range():
    assert Bounds(["a", "b"], [3, 5]).with_prefix("_") == [3]


def test_ranges_are_ordered_and_whole(spark, stored):
    table = read_ranges(spark, stored)
    assert table.count() == 200
    spans = table.groupBy("key_range").agg(F.min("row_key").alias("low"), F.max("row_key").alias("high"))
    spans = sorted((r.key_range, r.low, r.high) for r in spans.collect())
    assert len(spans) > 4
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert bounds_of(spark, stored).least == [low for _, low, _ in spans]


def test_first_rows_open_the_first_ranges(spark, stored):
    wanted = F.col("conversion_status") == "converted"
    some = first_ranges(spark, stored, wanted, 2)
    whole = read_ranges(spark, stored)
    assert 0 < len(opened(some)) < len(opened(whole)) / 2
    full = whole.withColumns({c: F.lit("x") for c in ("start_time", "device_type", "referrer")}).withColumn("duration", F.lit(1))
    part = some.withColumns({c: F.lit("x") for c in ("start_time", "device_type", "referrer")}).withColumn("duration", F.lit(1))
    assert converted_sessions(part, limit=2).collect() == converted_sessions(full, limit=2).collect()
    # More than there are: everything is opened, and nothing breaks.
    assert opened(first_ranges(spark, stored, wanted, 1000)) == opened(whole)
    assert first_ranges(spark, stored, wanted, 0).count() == 0


def test_a_prefix_opens_its_ranges(spark, stored):
    part = read_ranges(spark, stored, "user_000042_")
    assert len(opened(part)) <= 2
    found = part.where(F.col("row_key").startswith("user_000042_"))
    assert sorted(r.session_id for r in found.collect()) == ["s142", "s42"]
    assert read_ranges(spark, stored, "zzz").where("row_key like 'zzz%'").count() == 0


def test_a_load_rewrites_only_what_it_touches(spark, stored, tmp_path):
    def stamps():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "sessions").rglob("part-*.parquet")}

    before, rows_before = stamps(), contents(spark, stored)
    load = frame(spark, (key(3), "new", "browsed", 7), (key(3), "older", "browsed", 6), ("user_000003_x", "added", "browsed", 1))
    touched = merge_ranges(spark, stored, load)
    after = stamps()
    changed = {p.parent.name for p in before.keys() ^ after.keys()}
    assert changed == {f"key_range={number}" for number in touched} and len(touched) <= 2
    wanted = [row for row in rows_before if row[0] != key(3)] + [(key(3), "new", "browsed"), ("user_000003_x", "added", "browsed")]
    assert contents(spark, stored) == sorted(wanted)
    # The same load again changes nothing.
    merge_ranges(spark, stored, load)
    assert contents(spark, stored) == sorted(wanted)


def test_keys_outside_the_bounds_and_rows_without_key(spark, stored):
    load = frame(
        spark, ("a_first", "f", "x", 1), ("z_last", "l", "x", 1), ("_", "n1", "x", 1), ("_", "n2", "x", 2), ("u_", None, "x", 3)
    )
    for _ in range(2):
        merge_ranges(spark, stored, load, unkeyed=~has_key())
    added = [(r.row_key, r.session_id, "x") for r in read_ranges(spark, stored).where("conversion_status = 'x'").collect()]
    assert sorted(added, key=str) == sorted(
        [("a_first", "f", "x"), ("z_last", "l", "x"), ("_", "n1", "x"), ("_", "n2", "x"), ("u_", None, "x")], key=str
    )
    assert merge_ranges(spark, stored, frame(spark).limit(0)) == []


def test_a_key_on_most_rows_is_cut(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = [("_", f"s{i:05d}", "x", i) for i in range(3000)] + [(key(i), f"k{i}", "x", i) for i in range(50)]
    write_ranges(frame(spark, *rows).drop("load_order"), path, 8)
    sizes = read_ranges(spark, path).groupBy("key_range").count().collect()
    assert max(r["count"] for r in sizes) < 1500
    assert read_ranges(spark, path, "_").where("row_key = '_'").count() == 3000


def test_number_of_ranges_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        write_ranges(frame(spark).limit(0), str(tmp_path / "x"), 0)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_ranges(frame(spark).limit(0).drop("load_order"), path, 4)
    assert bounds_of(spark, path).numbers == [0]
    assert read_ranges(spark, path).count() == 0
    merge_ranges(spark, path, frame(spark, (key(1), "s", "x", 1)))
    assert contents(spark, path) == [(key(1), "s", "x")]
