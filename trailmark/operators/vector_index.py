"""A kept index of embeddings in cells, for exact nearest chunks of many vectors at once.

A sample of vectors are the cells' centres; a row lies in the cell of its nearest centre and knows how far from it.  Files are kept by
cell.  No row of a cell is nearer to a query than the centre's distance less the cell's radius, so a cell matters only while that is within the
k-th distance that a query has found.  Queries of neighbouring cells form groups, which first meet the nearest cells that have k rows for each of
them, which bounds k-th distances, and then the cells that bounds don't rule out.  A group meets its rows in parts: inner products leave out what
is farther than the bound, and the few that are left are measured plainly.  The result is that of a scan, ties included.

Changes come as generations over the same centres, like those of ``text_index``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.sources.shared import cut
from trailmark.streaming.tables import BucketedTable

MOST_CELLS = 1024
#: How many queries a group has, and rows a part of those that it meets, about.
GROUP_QUERIES, PART_ROWS = 1 << 12, 1 << 14
#: What rounding may add to a distance, as a share of it.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row, summed component after component as ``retrieval.distance`` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += (a[:, i] - b[:, i]) ** 2
    return np.sqrt(total)


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty((len(v), len(centres)))
    for i, c in enumerate(centres):  # plainly, not by inner products, which lose digits
        out[:, i] = np.sqrt(((v - c) ** 2).sum(axis=1))
    return out


class VectorIndex:
    """An index in a folder; rows are chunks (email_id, chunk_index, embedding), all of one width."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = BucketedTable(spark, f"{self.folder}/state", key="email_id", buckets=buckets)

    @classmethod
    def created(cls, chunks: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
        """Chooses the centres, a sample of about the square root of the rows (``MOST_CELLS`` at most), and takes all chunks up."""
        out = cls(chunks.sparkSession, folder)
        n = cells or min(MOST_CELLS, max(1, isqrt(chunks.count())))
        centres = chunks.orderBy(F.xxhash64("email_id", "chunk_index")).select(F.col("embedding").cast("array<double>").alias("centre")).limit(n)
        centres.withColumn("cell", F.monotonically_increasing_id()).coalesce(1).write.mode("overwrite").parquet(f"{out.folder}/centres")
        out.update(chunks, chunks.select("email_id").distinct().withColumn("action", F.lit("embed")))
        return out

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """``MOST_CELLS`` rows at most."""
        rows = sorted(self.spark.read.parquet(f"{self.folder}/centres").collect(), key=lambda r: r["cell"])
        return np.array([r["cell"] for r in rows], np.int64), np.array([r["centre"] for r in rows], float)

    def update(self, chunks: DataFrame, actions: DataFrame) -> None:
        """Takes up the chunks of mails to embed, and drops what is to be deleted (V08's actions: email_id, action)."""
        versions = self.state.versions()
        n = int(versions[-1].partition("-")[2]) + 1 if versions else 0
        model = self.spark.sparkContext.broadcast(self.centres())
        fresh = chunks.join(actions.where("action = 'embed'").select("email_id"), "email_id", "left_semi").select("email_id", "chunk_index", F.col("embedding").cast("array<double>").alias("embedding"))

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, centres = model.value
            for b in batches:
                if b.num_rows:
                    d = _distances(_matrix(b.column("embedding")), centres)
                    at = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells[at]), pa.array(d[np.arange(len(d)), at])], names=[*b.schema.names, "cell", "off"])

        placed = fresh.mapInArrow(make, "email_id string, chunk_index int, embedding array<double>, cell long, off double")
        placed.repartition("cell").sortWithinPartitions("cell", "off").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/rows/generation={n}")

        def apply(old: DataFrame | None, batch: DataFrame) -> DataFrame:
            kept = batch.where("action = 'embed'").select("email_id", F.lit(n).alias("since"))
            return kept if old is None else old.join(batch.select("email_id"), "email_id", "left_anti").select("email_id", "since").unionByName(kept)

        self.state.write(apply, actions.where("action <> 'keep'").select("email_id", "action"), n, 0, "index")

    def rows_of(self, cells: list[int] | None = None) -> DataFrame:
        """The rows that count, of some cells if given: only these cells' files are read."""
        live = self.state.rows().withColumnRenamed("since", "generation")
        kept = self.spark.read.parquet(f"{self.folder}/rows")
        kept = kept if cells is None else kept.where(F.col("cell").isin(cells) if cells else F.lit(False))
        return kept.join(live, ["email_id", "generation"], "left_semi")

    def nearest(self, queries: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
        """query_id, rank, email_id, chunk_index, distance: each query's k nearest rows; ties by email_id and chunk_index.  queries: query_id, vector.

        A cut-off is applied after the k are chosen, so fewer may be left."""
        cells, centres = self.centres()
        facts = {r["cell"]: (r["n"], r["radius"]) for r in self.rows_of().groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()}  # a row a cell
        known = np.array([c in facts for c in cells.tolist()], bool)
        cells, centres = cells[known], centres[known]
        size, radius = (np.array([facts[c][i] for c in cells.tolist()], float) for i in (0, 1))
        parts = max(1, -(-int(size.sum()) // PART_ROWS))
        shape = "query_id long, vector array<double>, own long"
        model = self.spark.sparkContext.broadcast((cells, centres, size, radius))

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, centres, _, _ = model.value
            for b in batches:
                if b.num_rows and len(cells):
                    own = _distances(_matrix(b.column("vector")), centres).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=[*b.schema.names, "own"])

        placed = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(home, shape), "asked")
        asked = placed.withColumn("group", self._groups(placed, centres))

        def choose(first: bool):
            """group, cell: which cells the queries of each batch need."""

            def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                cells, centres, size, radius = model.value
                for b in batches:
                    if not b.num_rows:
                        continue
                    d = _distances(_matrix(b.column("vector")), centres)
                    if first:
                        order = np.argsort(d, axis=1, kind="stable")
                        near = np.zeros(d.shape, bool)
                        np.put_along_axis(near, order, np.cumsum(size[order], axis=1) - size[order] < k, axis=1)
                    else:
                        bound = b.column("bound").to_numpy(zero_copy_only=False)[:, None]
                        bound = np.where(np.isnan(bound), np.inf, bound)
                        near = d - radius[None] <= bound + SLACK * (bound + d + 1)
                    i, j = np.nonzero(near)
                    pair = np.unique(np.stack([b.column("group").to_numpy()[i], cells[j]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["group", "cell"])

            return make

        def measure(asked: pa.Table, rows: pa.Table) -> pa.Table:
            """For each query its k nearest of these rows, and those equally far, as far as its bound lets them in."""
            ids, found = asked.column("query_id").to_numpy(), []
            if asked.num_rows and rows.num_rows:
                q, v = _matrix(asked.column("vector").combine_chunks()), _matrix(rows.column("embedding").combine_chunks())
                bound = asked.column("bound").to_numpy()
                bound = np.where(np.isnan(bound), np.inf, bound)
                v_square = (v**2).sum(axis=1)
                for lo in range(0, len(q), 256):
                    part = q[lo : lo + 256]
                    sizes = (part**2).sum(axis=1)[:, None] + v_square[None]
                    rough, error = sizes - 2 * (part @ v.T), SLACK * sizes
                    limit = bound[lo : lo + 256] ** 2
                    if v.shape[0] > k:
                        limit = np.minimum(limit, np.partition(rough + error, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero(~(rough - error > (limit * (1 + SLACK))[:, None]))
                    found.append((i + lo, j, _plain(part[i], v[j])))
            i, j, d = (np.concatenate([x[n] for x in found] or [np.zeros(0, np.int64)]) for n in range(3))
            return pa.table([pa.array(ids[i], pa.int64()), *[rows.column(c).take(pa.array(j, pa.int64())) for c in ("email_id", "chunk_index")], pa.array(d, pa.float64())], names=["query_id", "email_id", "chunk_index", "distance"])

        rank = Window.partitionBy("query_id").orderBy("distance", "email_id", "chunk_index")
        best = lambda df: df.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

        def meet(asked: DataFrame, pairs: DataFrame) -> DataFrame:
            few = [r["cell"] for r in pairs.select("cell").distinct().limit(MOST_CELLS).collect()]
            part = F.pmod(F.xxhash64("email_id", "chunk_index"), F.lit(parts)).cast("int").alias("part")
            rows = self.rows_of(few).join(pairs, "cell").select("group", part, "email_id", "chunk_index", "embedding")
            sent = asked.join(pairs.select("group").distinct(), "group", "left_semi").select("group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", "vector", "bound")
            met = sent.groupBy("group", "part").cogroup(rows.groupBy("group", "part"))
            return best(met.applyInArrow(measure, "query_id long, email_id string, chunk_index int, distance double")).drop("rank")

        blind = asked.withColumn("bound", F.lit(None).cast("double"))
        pairs = cut(blind.mapInArrow(choose(True), "group long, cell long").distinct(), "pairs")
        tried = cut(meet(blind, pairs), "tried")
        bounds = tried.groupBy("query_id").agg(F.max("distance").alias("bound"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
        bounded = cut(asked.join(bounds, "query_id", "left"), "bounded")
        further = cut(bounded.mapInArrow(choose(False), "group long, cell long").distinct().join(pairs, ["group", "cell"], "left_anti"), "pairs")
        out = best(tried.unionByName(meet(bounded, further))).select("query_id", F.col("rank").cast("int").alias("rank"), "email_id", "chunk_index", "distance")
        return out if max_distance is None else out.where(F.col("distance") <= max_distance)

    @staticmethod
    def _groups(placed: DataFrame, centres: np.ndarray) -> Column:
        """The group of a query: neighbouring cells, in the order of the centres' main direction, make up about ``GROUP_QUERIES``; more in one cell are dealt out."""
        asked = {r["own"]: r["n"] for r in placed.groupBy("own").agg(F.count("*").alias("n")).collect()}  # a row a cell
        if not asked:
            return F.lit(0).cast("long")
        apart = centres - centres.mean(axis=0)
        along = apart @ np.linalg.svd(apart, full_matrices=False)[2][0]
        first, deal, now, held = {}, {}, 0, 0
        for own in sorted(asked, key=lambda i: along[i]):
            n = asked[own]
            if held and held + n > GROUP_QUERIES:
                now, held = now + 1, 0
            first[own], deal[own] = now, max(1, -(-n // GROUP_QUERIES))
            held += n
            if deal[own] > 1:
                now, held = now + deal[own], 0
        table = lambda d: F.create_map(*[F.lit(int(x)) for pair in d.items() for x in pair])[F.col("own").cast("int")]
        return (table(first) + F.pmod(F.xxhash64("query_id"), table(deal))).cast("long")
