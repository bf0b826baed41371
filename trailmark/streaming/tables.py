"""Bucketed tables that a stream rewrites: versions told by manifests, replays without doubles, reloads, expiry.

A version is a manifest: for each bucket the folder that has its rows.  A micro-batch writes the buckets that it touches to a folder of its
own and then publishes a manifest, by Spark's own commit; until then readers see the version before.  Versions are ordered by epoch and
batch: batch numbers begin anew with each checkpoint, so every checkpoint (by the id that Spark keeps in it) has an epoch of its own, later
than all before.  A batch builds on the last version before its own, so replaying it makes the same again, and a reload into a used
table builds on what is there.  Versions but the last ``keep``, and folders that none of these names, are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Apply = Callable[[DataFrame | None, DataFrame], DataFrame]
Sink = Callable[[DataFrame, int], None]
_MANIFEST = "epoch long, batch long, source string, bucket int, folder string"


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint; another one if the checkpoint is made anew."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


class _Files:
    """A folder in whatever file system Spark reads it from."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)


def _version(name: str) -> tuple[int, int]:
    epoch, _, batch = name.partition("-")
    return int(epoch), int(batch)


class BucketedTable:
    """A table in a folder; rows belong to ``buckets`` buckets by a hash of their key, and a batch rewrites only those that it touches."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", buckets: int = 64, keep: int = 10):
        self.spark, self.folder, self.key, self.buckets, self.keep = spark, folder.rstrip("/"), key, buckets, max(2, keep)
        self.files = _Files(spark, self.folder)

    def versions(self) -> list[str]:
        """Names of the published versions, oldest first: epoch-batch."""
        return [n for n in self.files.names(f"{self.folder}/manifests") if "_SUCCESS" in self.files.names(f"{self.folder}/manifests/{n}")]

    def manifest(self, version: str) -> list:
        """``buckets`` rows at most."""
        return self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifests/{version}").collect()

    def rows(self, version: str | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of a version (the last one, if not given), of some buckets if given; None where there are none."""
        known = self.versions()
        if not known:
            return None
        wanted = [r for r in self.manifest(version or known[-1]) if r["folder"] and (buckets is None or r["bucket"] in buckets)]
        return self.spark.read.parquet(*[f"{self.folder}/data/{r['folder']}/bucket={r['bucket']}" for r in wanted]) if wanted else None

    def rows_before(self, epoch: int, batch: int, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows that a batch builds on, whether it has been written or not."""
        before = [v for v in self.versions() if v < f"{epoch:08d}-{batch:012d}"]
        return self.rows(before[-1], buckets) if before else None

    def epoch_of(self, source: str) -> int:
        """The epoch of a checkpoint: the one that it has, if that is the last, or else one after all."""
        newest: dict[str, int] = {}
        for version in self.versions():
            rows = self.manifest(version)
            newest[rows[0]["source"]] = max(newest.get(rows[0]["source"], 0), _version(version)[0])
        last = max(newest.values(), default=-1)
        return last if newest.get(source) == last and last >= 0 else last + 1

    def place(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def write(self, apply: Apply, batch: DataFrame, batch_id: int, epoch: int, source: str) -> None:
        """``apply`` takes the rows of the touched buckets (None where there are none) and the batch's; returns the buckets' next rows."""
        name = f"{epoch:08d}-{batch_id:012d}"
        before = [v for v in self.versions() if v < name]
        touched = {r["bucket"] for r in self.place(batch).select("bucket").distinct().collect()}  # ``buckets`` rows at most
        old = self.rows(before[-1], touched) if before else None
        if touched:
            data = f"{self.folder}/data/{name}"
            self.place(apply(old, batch)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
            written = {int(n.partition("=")[2]) for n in self.files.names(data) if n.startswith("bucket=")}
        else:
            written = set()
        folders = {r["bucket"]: r["folder"] for r in (self.manifest(before[-1]) if before else []) if r["bucket"] is not None}
        folders |= {b: name if b in written else None for b in touched | written}
        rows = [(epoch, batch_id, source, b, f) for b, f in sorted(folders.items())] or [(epoch, batch_id, source, None, None)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/{name}")
        self.expire()

    def expire(self) -> None:
        """Deletes versions but the last ``keep``, then folders older than the newest version that none of these names."""
        known = self.versions()
        for version in known[: -self.keep]:
            self.files.delete(f"{self.folder}/manifests/{version}")
        kept = known[-self.keep :]
        named = {r["folder"] for v in kept for r in self.manifest(v)}
        for folder in self.files.names(f"{self.folder}/data"):
            if kept and folder < kept[-1] and folder not in named:
                self.files.delete(f"{self.folder}/data/{folder}")


class BucketSink:
    """A foreachBatch sink into a table; ``of`` binds it to a checkpoint, whose id decides the epoch of its batches."""

    def __init__(self, table: Callable[[SparkSession], BucketedTable], apply: Apply, checkpoint: str | None = None):
        self.table, self.apply, self.checkpoint = table, apply, checkpoint
        self._epoch: tuple[str, int] | None = None

    def of(self, checkpoint: str) -> BucketSink:
        return BucketSink(self.table, self.apply, checkpoint)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        table = self.table(batch.sparkSession)
        source = ""
        if self.checkpoint:
            source = query_id(batch.sparkSession, self.checkpoint)
        if self._epoch is None or self._epoch[0] != source:
            self._epoch = (source, table.epoch_of(source))
        table.write(self.apply, batch, batch_id, self._epoch[1], source)


def into_buckets(apply: Apply, folder: str, key: str = "id", buckets: int = 64, keep: int = 10) -> BucketSink:
    """A foreachBatch sink: a batch rewrites the buckets that it touches as ``apply`` makes of their rows and the batch's."""
    return BucketSink(lambda spark: BucketedTable(spark, folder, key, buckets, keep), apply)


def current(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """A bucketed table as its last batch left it, or as it was in a version that is kept."""
    rows = BucketedTable(spark, folder).rows(version)
    if rows is None:
        raise ValueError(f"{folder} has no rows yet")
    return rows
