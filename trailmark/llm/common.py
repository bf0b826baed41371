"""Shared folders and small helpers of the training-text operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: A sample's share of all rows is taken as a part of this many values of a hash: of any number of rows some are sampled.
GRAIN = 1 << 62


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="trailmark-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, and lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the input has."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def release() -> None:
    """Gives freed memory back to the system: Spark keeps a worker process, and what it holds, for later tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def in_slices(make: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", step: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands ``make`` at most about ``step`` bytes of text, and one row at least, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, n = 0, batch.num_rows
            while lo < n:
                hi, size = n, batch.slice(lo).column(text).nbytes
                if size > step:
                    share = max(1, int((n - lo) * step / size))
                    hi = min(n, lo + share)
                if (out := make(batch.slice(lo, hi - lo))) is not None and out.num_rows:
                    yield out
                lo = hi
        release()

    return run
