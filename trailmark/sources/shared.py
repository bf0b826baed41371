"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[tempfile.TemporaryDirectory] = []
#: Rows that a task sorts at a time where tables are dealt by ``parts_of``.
PART_ROWS = 1 << 18


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in spark.checkpoint.dir; in local mode alone, where that is unset, in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="trailmark-", ignore_cleanup_errors=True))
        folder = f"file://{_local[0].name}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to spark.checkpoint.dir: plans that use it more than once read it, and its lineage ends there."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(*tables: DataFrame) -> int:
    """Partitions of at most about ``PART_ROWS`` rows for the longest of these tables, or 0 where Spark's own number will do.

    Spark merges small partitions until each core has one, so without a number of its own a task's part would grow with the table."""
    rows = max(t.count() for t in tables)
    return max(-(-rows // PART_ROWS), tables[0].sparkSession.sparkContext.defaultParallelism) if rows > PART_ROWS else 0


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df dealt by a key into so many parts (0: as it is)."""
    return df.repartition(parts, key) if parts else df
