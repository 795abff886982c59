"""Where intermediate tables and stream checkpoints go."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path in the shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder of this machine.  On a
    cluster a folder without a shared file system's scheme gets a warning: it must be mounted by all.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not folder:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="shoplens-")
    elif not local and folder.startswith(("/", "file:")):
        warnings.warn(f"{folder} must be shared by all executors and the driver", stacklevel=2)
    path = f"{folder.rstrip('/')}/shoplens/{purpose}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Compute an intermediate that several later steps read, once, as a table in scratch space.

    The table outlives lost executors, and its size on disk tells the planner what it may broadcast.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made within, at its end: results must have been read or written by then."""
    before = len(_made)
    try:
        yield
    finally:
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for path in _made[before:]:
            location = spark._jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(conf).delete(location, True)
        del _made[before:]
