"""Session settings the plans count on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Adaptive execution picks joins by measured sizes and splits hot keys; forcing lets it split a hot join
# key even where the rows must be shuffled once more for a following aggregation.  The last setting
# keeps the first k rows of a window group ahead of the shuffle for every k this library uses.  Sets
# collected per key are few months each, so a task may hold many keys before it falls back to sorting.
SETTINGS = {
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "100001",
    "spark.sql.session.timeZone": "UTC",
}


INPUT_PER_PARTITION = 2 << 30
MOST_PARTITIONS = 20_000
SCAN_TASKS = 100_000
LARGEST_SPLIT = 1 << 30
OWN_SPLIT = "shoplens.session.maxPartitionBytes"
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
ROWS_PER_TASK = 2_000_000
FINE_READ = 16 << 20


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of files or folders as the file system lists them."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    total = 0
    for path in paths:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += location.getFileSystem(conf).getContentSummary(location).getLength()
    return total


def _size_stages(spark: SparkSession, total: int) -> None:
    """Shuffle partitions and scan splits for ``total`` bytes of input."""
    first = max(
        min(total // INPUT_PER_PARTITION, MOST_PARTITIONS),
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    spark.conf.set(PARTITIONS, str(first))
    session_split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    own = int(spark.conf.get(OWN_SPLIT, str(session_split)))
    spark.conf.set(OWN_SPLIT, str(own))
    split = max(own, min(total // SCAN_TASKS, LARGEST_SPLIT))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))


def tune(spark: SparkSession, *inputs: str) -> SparkSession:
    """Apply the run-time settings and size the stages for the inputs, if they are named.

    A shuffle starts with a partition per INPUT_PER_PARTITION of stored input, never fewer than the
    session's own ``spark.sql.shuffle.partitions``; adaptive execution merges those that stay small.
    Scan splits grow beyond the session's own size where there would be more than SCAN_TASKS, since
    the blocks of a shuffle number map tasks times partitions.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    if inputs:
        _size_stages(spark, stored_bytes(spark, *inputs))
    return spark


@contextmanager
def fine_stages(spark: SparkSession) -> Iterator[Callable[[int], None]]:
    """Within, adaptive execution merges partitions to FINE_READ only; for plans whose rows become many more.

    It gives a function to be told how many rows a shuffle will meet: later stages start with a partition per
    ROWS_PER_TASK of them, never fewer than before.  The settings are put back at the end, so what is planned
    within must be computed within.
    """
    before = {name: spark.conf.get(name, None) for name in (PARTITIONS, ADVISORY)}
    own = int(before[PARTITIONS] or spark.conf.get("spark.sql.shuffle.partitions"))

    def expect(rows: int) -> None:
        spark.conf.set(PARTITIONS, str(max(own, min(tasks_for(rows), MOST_PARTITIONS))))

    spark.conf.set(ADVISORY, str(FINE_READ))
    try:
        yield expect
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def tasks_for(rows: int) -> int:
    return -(-rows // ROWS_PER_TASK)
