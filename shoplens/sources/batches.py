"""Numbered batches under a folder; one counts once Spark has marked it as written."""

from __future__ import annotations

from pyspark.sql import SparkSession


def finished_batches(spark: SparkSession, root: str, name: str) -> list[str]:
    """The folders ``name=0``, ``name=1`` and so on that are written in full, up to the first that is not."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(root)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found: list[str] = []
    while fs.exists(path(folder, f"{name}={len(found)}/_SUCCESS")):
        found.append(f"{root}/{name}={len(found)}")
    return found
