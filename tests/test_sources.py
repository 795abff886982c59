import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import item, rows
from shoplens.operators import duplicate_keys, latest_by_key, table_counts
from shoplens.sources import (
    load_collection,
    read_collection,
    read_result_csv,
    read_sessions,
    run_sql_script,
    schemas,
    scratch_path,
    write_result,
    write_sessions,
)

DOCUMENTS = [
    {
        "transaction_id": f"txn_{i}",
        "user_id": f"user_{i:06d}",
        "timestamp": f"2025-03-1{i}T14:37:22",
        "items": [item("p1", i + 1, 2.5)],
        "total": 2.5 * (i + 1),
    }
    for i in range(3)
]
LAYOUTS = {
    "array_on_one_line": json.dumps(DOCUMENTS),
    "array_indented": json.dumps(DOCUMENTS, indent=2),
    "lines": "\n\n".join(json.dumps(d) for d in DOCUMENTS) + "\n",
}


@pytest.mark.parametrize("kind", LAYOUTS)
def test_layouts_read_alike(spark, tmp_path, kind):
    path = tmp_path / "transactions.json"
    path.write_text(LAYOUTS[kind])
    df = read_collection(spark, str(path), schemas.TRANSACTIONS)
    got = sorted((r.transaction_id, float(r.total), r["items"][0].quantity) for r in df.collect())
    assert got == [("txn_0", 2.5, 1), ("txn_1", 5.0, 2), ("txn_2", 7.5, 3)]
    explicit = "lines" if kind == "lines" else "array"
    again = read_collection(spark, str(path), schemas.TRANSACTIONS, explicit)
    assert again.count() == 3
    assert again.schema["total"].dataType.simpleString() == "decimal(14,2)"


def test_array_elements_that_are_not_objects_are_skipped(spark, tmp_path):
    path = tmp_path / "mixed.json"
    path.write_text(json.dumps([DOCUMENTS[0], 5, None, "text", [1], DOCUMENTS[1]]))
    df = read_collection(spark, str(path), schemas.TRANSACTIONS)
    assert sorted(r.transaction_id for r in df.collect()) == ["txn_0", "txn_1"]
    assert df.where("total > 3").count() == 1


@pytest.mark.parametrize("text", ['{"transaction_id": "a"}\n{broken', '[{"transaction_id": "a"}, {'])
def test_broken_json_raises(spark, tmp_path, text):
    path = tmp_path / "broken.json"
    path.write_text(text)
    with pytest.raises(Exception):
        read_collection(spark, str(path), schemas.TRANSACTIONS).collect()


def test_missing_collection_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_collection(spark, str(tmp_path / "none.json"), schemas.USERS)
    with pytest.raises(AnalysisException):
        read_collection(spark, str(tmp_path / "none.json"), schemas.USERS, "lines")
    with pytest.raises(ValueError):
        read_collection(spark, str(tmp_path), schemas.USERS, "xml")


def test_load_replaces_or_appends(spark, tmp_path):
    path, target = tmp_path / "transactions.json", str(tmp_path / "table")
    path.write_text(LAYOUTS["lines"])
    assert load_collection(spark, "transactions", str(path), target).count() == 3
    assert load_collection(spark, "transactions", str(path), target, drop_first=False).count() == 6
    assert load_collection(spark, "transactions", str(path), target).count() == 3


def session(i, user="user_000001", start="2025-03-12T14:37:22", **extra):
    return {
        "session_id": f"sess_{i}",
        "user_id": user,
        "start_time": start,
        "duration_seconds": 60 + i,
        "device_profile": {"type": "mobile", "os": "iOS", "browser": "Safari"},
        "cart_contents": {f"prod_{i}": {"quantity": i, "price": 1.5}},
        "conversion_status": "browsed",
    } | extra


def test_session_chunks_keep_map_type_and_load_order(spark, tmp_path):
    (tmp_path / "sessions_0.json").write_text(json.dumps([session(0), session(1)]))
    (tmp_path / "sessions_1.json").write_text(json.dumps([session(2), session(3, "user_000002")]))
    (tmp_path / "other.json").write_text(json.dumps([session(9)]))
    df = read_sessions(spark, str(tmp_path))
    assert df.schema["cart_contents"].dataType.simpleString().startswith("map<string")
    assert [r.session_id for r in df.orderBy("load_order").collect()] == [
        "sess_0",
        "sess_1",
        "sess_2",
        "sess_3",
    ]
    newest = latest_by_key(df, ["user_id", "start_time"], F.col("load_order"))
    assert sorted(r.session_id for r in newest.collect()) == ["sess_2", "sess_3"]
    assert newest.columns == df.columns


def test_a_folder_without_chunks_is_an_error(spark, tmp_path):
    (tmp_path / "other.json").write_text("[]")
    with pytest.raises(FileNotFoundError):
        read_sessions(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        read_collection(spark, str(tmp_path / "empty*"), schemas.USERS)


def test_a_folder_of_files_is_one_collection(spark, tmp_path):
    for i, d in enumerate(DOCUMENTS):
        (tmp_path / f"part-{i}.json").write_text(json.dumps(d))
    (tmp_path / "_SUCCESS").write_text("")
    assert read_collection(spark, str(tmp_path), schemas.TRANSACTIONS).count() == 3


def test_session_order_survives_elements_that_are_not_objects(spark, tmp_path):
    (tmp_path / "sessions_0.json").write_text(json.dumps([session(0), 7, session(1), session(2)]))
    ordered = read_sessions(spark, str(tmp_path)).orderBy("load_order")
    assert [r.session_id for r in ordered.collect()] == ["sess_0", "sess_1", "sess_2"]


def test_csv_coercion(spark, tmp_path):
    path = tmp_path / "clv.csv"
    path.write_text("user_id,total_revenue\na,12.5\nb,5d\nc,abc\nd,\ne, 1e2 \nf,inf\ng,nan\n")
    df = read_result_csv(spark, str(path), ["total_revenue", "user_id"], ["total_revenue"])
    assert rows(df.orderBy("user_id")) == [(12.5, "a"), (100.0, "e"), (float("inf"), "f")]


def test_single_file_result_is_ordered(spark, tmp_path):
    target = tmp_path / "out"
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("n"), F.lit('a "b", c').alias("t"))
    assert write_result(df, str(target), ["n"], single_file=True)
    files = list(target.glob("part-*.csv"))
    assert len(files) == 1
    lines = files[0].read_text().splitlines()
    assert lines[0] == "n,t"
    assert [int(x.split(",")[0]) for x in lines[1:]] == list(range(100))
    assert read_result_csv(spark, str(target), ["t"]).distinct().collect()[0].t == 'a "b", c'


def test_many_file_result_is_ordered_across_files(spark, tmp_path):
    target = tmp_path / "out"
    write_result(spark.range(1000).repartition(5).toDF("n"), str(target), ["n"])
    numbers = [
        int(line)
        for f in sorted(target.glob("part-*.csv"))
        for line in f.read_text().splitlines()[1:]
    ]
    assert numbers == list(range(1000))


def test_empty_result_can_be_skipped(spark, tmp_path):
    target = tmp_path / "out"
    assert not write_result(spark.range(0), str(target), skip_empty=True)
    assert not target.exists()


def test_script(spark):
    frames = run_sql_script(
        spark, "create or replace temp view v as select 1 as a;\n ; select a + 1 as b from v; select 3 c"
    )
    assert [rows(f) for f in frames] == [[(2,)], [(3,)]]
    assert run_sql_script(spark, "\n\n") == []


def test_checks(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "product_id string")
    assert rows(duplicate_keys(df, "product_id")) == [("a", 2)]
    assert sorted(rows(table_counts({"x": df, "y": df.limit(0)}))) == [("x", 3), ("y", 0)]


def test_scratch_is_under_the_session_setting(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert path != scratch_path(spark, "x")


def test_stored_sessions_are_pruned_by_key_prefix(spark, tmp_path):
    df = spark.range(1000).selectExpr(
        "format_string('user_%06d_x', id % 50) as row_key", "id as session_id"
    )
    write_sessions(df, str(tmp_path / "s"))
    found = spark.read.parquet(str(tmp_path / "s")).where(F.col("row_key").startswith("user_000007_"))
    assert found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(row_key,user_000007_)" in plan
