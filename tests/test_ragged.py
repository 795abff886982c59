import csv
import json

import pytest
from pyspark.sql import functions as F

from shoplens.session import tune
from shoplens.sources import union_of_rows, write_ragged, write_result


def frame(spark, *records):
    """Maps made of JSON text, which keeps the order of the keys."""
    lines = [(n, None if record is None else json.dumps(record)) for n, record in enumerate(records)]
    record = F.from_json("line", "map<string,string>").alias("record")
    return spark.createDataFrame(lines, "n long, line string").select("n", record)


def one_file(path):
    (part,) = path.glob("part-*.csv")
    with part.open(newline="", encoding="utf-8") as lines:
        return list(csv.reader(lines))


ROWS = [
    {"b": "1", "a": "2"},
    {},
    None,
    {"c": None, "a": "3"},
    {"d, e": "x,\"y\"", "b": "4"},
    {"a": "", "z": "last"},
]


def header(rows):
    """Keys in order of first appearance, as a loop over all rows finds them."""
    return list(dict.fromkeys(key for row in rows if row for key in row))


@pytest.mark.parametrize("descending", [False, True])
def test_columns_stand_in_order_of_first_appearance(spark, tmp_path, descending):
    order = F.col("n").desc() if descending else F.col("n")
    df = frame(spark, *ROWS).repartition(3)
    columns = write_ragged(df, str(tmp_path / "out"), "record", [order], single_file=True)
    rows = ROWS[::-1] if descending else ROWS
    assert columns == header(rows)
    lines = one_file(tmp_path / "out")
    assert lines[0] == columns
    wanted = [[(row or {}).get(key) or "" for key in columns] for row in rows]
    # A line of empty fields only is written as separators.
    assert lines[1:] == wanted


def test_many_files_hold_the_same_rows(spark, tmp_path):
    df = frame(spark, *[{f"k{i % 7}": str(i), "n": str(i)} for i in range(300)]).repartition(5)
    columns = write_ragged(df, str(tmp_path / "out"), "record", ["n"])
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == columns == ["k0", "n", *(f"k{i}" for i in range(1, 7))]
    assert sorted(int(r.n) for r in back.collect()) == list(range(300))


@pytest.mark.parametrize("per_file", [0, 400])
def test_one_file_of_many_ranges_is_written_without_a_sort_in_one_task(spark, tmp_path, per_file):
    from shoplens.sources import ragged

    df = frame(spark, *[{f"k{i % 7}": str(i), "n": str(i)} for i in range(3000)]).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", str(per_file))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        placed = ragged._placed(df, "record", ["n"])
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        assert len(placed.inputFiles()) > 3
        whole = ragged._file_by_file(placed)
        assert whole.rdd.getNumPartitions() == 1
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan
        assert [int(r.n) for r in whole.select(F.col("record")["n"].alias("n")).collect()] == list(range(3000))
        write_ragged(df, str(tmp_path / "out"), "record", [F.col("n").desc()], single_file=True)
    finally:
        for name in ("adaptive.coalescePartitions.enabled", "files.maxRecordsPerFile", "files.maxPartitionBytes"):
            spark.conf.unset(f"spark.sql.{name}")
        tune(spark)
    lines = one_file(tmp_path / "out")
    at = lines[0].index("n")
    assert [int(line[at]) for line in lines[1:]] == list(range(2999, -1, -1))


def test_nothing_is_written_without_rows_or_keys(spark, tmp_path):
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept" / "part-0.csv").write_text("old\n")
    assert write_ragged(frame(spark).limit(0), str(tmp_path / "kept"), "record") == []
    assert write_ragged(frame(spark, {}, None), str(tmp_path / "kept"), "record") == []
    assert (tmp_path / "kept" / "part-0.csv").read_text() == "old\n"


def test_union_as_a_frame(spark):
    df = frame(spark, *ROWS).withColumnRenamed("record", "place")
    found = union_of_rows(df, "place", ["n"])
    assert found.columns == header(ROWS)
    assert found.count() == len(ROWS)
    assert [tuple(r) for r in found.where("b = '1'").collect()] == [("1", "2", None, None, None)]


def test_keys_that_differ_in_case(spark):
    df = frame(spark, {"a": "1", "A": "2"})
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert union_of_rows(df, "record", ["n"]).columns == ["a", "A"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_a_hot_shape_is_combined_before_the_shuffle(spark):
    from shoplens.sources import ragged

    placed = ragged._placed(frame(spark, *ROWS), "record", ["n"])
    shapes = placed.where(F.size("record") > 0).groupBy(F.map_keys("record")).agg(F.min("place"))
    text = shapes._jdf.queryExecution().toString()
    assert "partial_min" in text and "SortAggregate" not in text


def test_an_empty_result_is_skipped_in_one_computation(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(5).mapInPandas(look, "id long")
    assert write_result(df, str(tmp_path / "some"), ["id"], single_file=True, skip_empty=True)
    assert seen.value == 5
    assert not write_result(df.where("id > 9"), str(tmp_path / "none"), skip_empty=True)
    assert not (tmp_path / "none").exists()
