import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shoplens.sources.blocks import read_array_blocks

SCHEMA = "n long, text string, inner array<struct<x:string>>"


@pytest.fixture(scope="module")
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


TEXT = st.text('ab{}[]",\\ :\n漢é', max_size=8)
OBJECT = st.fixed_dictionaries(
    {"n": st.integers(0, 99), "text": TEXT, "inner": st.lists(st.fixed_dictionaries({"x": TEXT}), max_size=2)}
)
OTHER = st.one_of(st.none(), st.integers(0, 9), TEXT, st.lists(OBJECT, max_size=2), st.lists(TEXT, max_size=2))


def found(spark, path):
    rows = read_array_blocks(spark, str(path), SCHEMA).orderBy("place").collect()
    return [{"n": r.n, "text": r.text, "inner": [{"x": i.x} for i in r.inner]} for r in rows]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(OBJECT, OTHER), max_size=12), st.sampled_from([None, 2]), st.booleans())
def test_objects_of_one_array(spark, small_splits, tmp_path_factory, elements, indent, ascii_only):
    path = tmp_path_factory.mktemp("array") / "a.json"
    path.write_text(json.dumps(elements, indent=indent, ensure_ascii=ascii_only))
    assert found(spark, path) == [e for e in elements if isinstance(e, dict)]


def test_one_line_is_read_by_many_tasks(spark, small_splits, tmp_path):
    elements = [{"n": i, "text": "}{" * (i % 9), "inner": [{"x": '"'}] * (i % 3)} for i in range(300)]
    path = tmp_path / "line.json"
    path.write_text(json.dumps(elements))
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    assert found(spark, path) == elements


def test_files_have_places_of_their_own(spark, small_splits, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"n": 10 * k + i, "text": "t", "inner": []} for i in range(7)]))
    rows = read_array_blocks(spark, str(tmp_path), SCHEMA).orderBy("file", "place").collect()
    assert [r.n for r in rows] == [10 * k + i for k in range(3) for i in range(7)]
    assert [r.place for r in rows] == [*range(7)] * 3


@pytest.mark.parametrize("text", ["[]", " [ ] \n", "[1, null, \"{}\"]"])
def test_arrays_without_objects(spark, small_splits, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert found(spark, tmp_path / "a.json") == []


@pytest.mark.parametrize("text", ['[{"n": 1}', '{"n": 1}', '[{"n": 1}, {"n"', "no json", '[{"n": 1}]]', '[{"n": "x"}]'])
def test_what_is_no_array_raises(spark, small_splits, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON array|MALFORMED|Malformed|malformed"):
        found(spark, tmp_path / "a.json")
