"""Compare queries with their DuckDB SQL: ``python tests/oracle_check.py [folder] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split()
TABLES += ["labels", "conversations"]


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def compare(spark: SparkSession, con, query, sql: str, folder: str):
    """None if columns and rows agree, else a description of the difference."""
    df = query(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = canonical(df.columns, mine), canonical(columns, theirs)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"rows {len(a)} and {len(b)}; {wrong}"
    return None


def main() -> int:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if name not in sql or (chosen and name not in chosen):
            continue
        begun = time.time()
        try:
            problem = compare(spark, con, query, sql[name], folder)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - begun:6.2f}s {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
