"""SQL scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql_script(spark: SparkSession, text: str) -> list[DataFrame]:
    """Run the statements of a script in order and return those that yield columns.

    Statements are separated by ``;``, which therefore may not occur inside a literal.
    """
    statements = [piece.strip() for piece in text.split(";")]
    frames = [spark.sql(statement) for statement in statements if statement]
    return [frame for frame in frames if frame.columns]
