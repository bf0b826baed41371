"""Exact top-k search by inner product: a Voronoi join.

Vectors become integers, floor(1024 x).  Pivots, a sample of vectors that grows like the square root of their number (``MOST_PIVOTS``
at most), divide queries and data into Voronoi cells; each cell is summarised by its size, radius and longest vector.  Data cells are
dealt into blocks of about ``block`` rows by a hash of the row's number, so a cell may hold any share of all rows; queries form groups
of about ``query_group`` from a cell, or a part of it, or several neighbouring cells.  For a query q and a cell of pivot p, no score exceeds
min(q.p + |q| radius, |q| longest).  First each query meets a block of the cell whose pivot scores highest, which gives a lower bound
for its k-th score; then it goes only to blocks of cells whose bound reaches that score.  As the queries of a group are
neighbours, they need much the same blocks: a data block is replicated only to the groups with a query that needs it.  Each block and group
is solved locally in exact integer arithmetic, and the local results are merged.

Vectors that are null, or hold a null or non-finite component, and rows with a null vec_id take no part.  Vectors shorter than others
count as if zeros followed (an empty one scores 0 with all).  Ties go to the smaller vec_id; repeated rows are candidates of their
own, but rows with the query's own vec_id are not its candidates, and of queries with one vec_id the least vector is taken.
Components may have any size; a score among the highest that doesn't fit in a long (2**63 - 1 in size or more) raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

MOST_PIVOTS = 1024
_MOST = 2**63 - 1
#: What geometry, which needs bounds only, takes a larger component for; its cell and query then count as boundless.
_FAR = 1e150


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return pick(vectors, "vec_id", "embedding").where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows x dims, or more where a list is longer, with zeros where lists are shorter."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    dims = max(dims, int(n.max(initial=0)))
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))


def whole(v: np.ndarray) -> np.ndarray:
    """floor(1024 x) of each component: exact as a double, or as Python's integers where one is beyond all doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(v * 1024)
    if np.isfinite(out).all():
        return out
    return np.array([[int(x) * 1024 if abs(x) > 2**60 else int(np.floor(x * 1024)) for x in row] for row in v.tolist()], object).reshape(v.shape)


def _exact(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole rows; ``most`` bounds the sum of any product's terms' sizes."""
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    as_ints = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)
    return np.clip(as_ints(a) @ as_ints(b).T, -_MOST, _MOST).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows, those beyond a long cut to its ends.  Only rows with large components leave the fast way."""
    size = lambda x: np.array([max((abs(float(c)) for c in r), default=0.0) for r in x]) if x.dtype == object else np.abs(x).max(axis=1, initial=0)
    sa, sb = size(a), size(b)
    edge = (2.0**53 / max(1, a.shape[1])) ** 0.5
    if sa.max(initial=0) * sb.max(initial=0) * a.shape[1] < 2**53:
        return _exact(a, b, 0)
    out = np.zeros((len(a), len(b)), np.int64)
    for i in (np.flatnonzero(sa < edge), np.flatnonzero(sa >= edge)):
        for j in (np.flatnonzero(sb < edge), np.flatnonzero(sb >= edge)):
            if len(i) and len(j):
                with np.errstate(over="ignore"):
                    out[np.ix_(i, j)] = _exact(a[i], b[j], sa[i].max() * sb[j].max() * a.shape[1])
    return out


def local_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k best rows, ties to the smaller vec_id."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], whole(v[order])
    q, v = same_width(whole(q), v)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q_ids), 256):
        s = products(q[lo : lo + 256], v)
        for i, row in enumerate(s):
            row_ids, own = ids, ids != q_ids[lo + i]
            if not own.all():
                row, row_ids = row[own], ids[own]
            at = np.arange(len(row))
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row >= least)
            best = at[np.argsort(-row[at], kind="stable")[:k]]
            out.append((np.full(len(best), q_ids[lo + i]), row_ids[best], row[best]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _near(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole components, large ones cut, and which rows had any cut."""
    with np.errstate(over="ignore"):
        v = np.floor(v * 1024)
    return np.clip(v, -_FAR, _FAR), (np.abs(v) > _FAR).any(axis=1)


def assign_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds each vector's nearest pivot, its distance from it and its length (infinite where components are cut)."""
    model = vectors.sparkSession.sparkContext.broadcast(pivots)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, cut = _near(matrix(b.column("v"), 0))
            v, p = same_width(v, _near(model.value)[0])
            d = (p**2).sum(1)[None] - 2 * (v @ p.T)
            cell = d.argmin(1)
            far, long = (np.where(cut, np.inf, np.linalg.norm(x, axis=1)) for x in (v - p[cell], v))
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(long)], names=["vec_id", "v", "cell", "far", "long"])

    return vectors.mapInArrow(make, "vec_id long, v array<double>, cell int, far double, long double")


def _solve(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: block, query_group, is_query, id, v.  Local top-k of each group's queries in each block."""

    def make(t: pa.Table) -> pa.Table:
        is_q = t.column("is_query").to_numpy()
        ids, v = t.column("id").to_numpy(), matrix(t.column("v").combine_chunks(), 0)
        a, b, c = local_top(ids[is_q], v[is_q], ids[~is_q], v[~is_q], k)
        return pa.table([pa.array(x) for x in (a, b, c)], names=["query_id", "vec_id", "score"])

    return pairs.groupBy("block", "query_group").applyInArrow(make, "query_id long, vec_id long, score long")


def _meet(queries: DataFrame, data: DataFrame) -> DataFrame:
    """queries: blocks (array), query_group, id, v; data: block, id, v.  Each block's rows once for each group that needs it."""
    sent = queries.select(F.explode("blocks").alias("block"), "query_group", F.lit(True).alias("is_query"), "id", "v")
    needed = sent.select("block", "query_group").distinct()
    return sent.unionByName(data.join(needed, "block").select("block", "query_group", F.lit(False).alias("is_query"), "id", "v"))


class Cells:
    """The summaries of all cells: at most MOST_PIVOTS rows."""

    def __init__(self, points: np.ndarray, stats: dict, block: int):
        self.known = sorted(stats)
        of = lambda name: np.array([stats[c][name] for c in self.known], float)
        self.points, _ = _near(points[self.known] if self.known else points[:0])
        self.rows, self.radius, self.longest = of("n"), of("radius"), of("longest")
        self.blocks = [-(-stats[c]["n"] // block) for c in self.known]
        self.first = [0, *np.cumsum(self.blocks)[:-1].tolist()] if self.known else []

    def query_groups(self, queries: list[int], most: int) -> tuple[list[int], list[int]]:
        """The first group of each cell's queries, and into how many they are dealt: neighbouring cells share one while it holds ``most``."""
        start, many, group, held = [0] * len(queries), [1] * len(queries), 0, 0
        todo, at = set(range(len(queries))), 0
        while todo:  # from each cell to the nearest one left
            rest = sorted(todo)
            at = rest[int(((self.points[rest] - self.points[at]) ** 2).sum(axis=1).argmin())]
            todo.remove(at)
            if held and held + queries[at] > most:
                group, held = group + 1, 0
            start[at], many[at] = group, max(1, -(-queries[at] // most))
            group, held = group + many[at] - 1, held + queries[at]
        return start, many

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """No row of the cell scores higher: queries x cells."""
        q, cut = _near(v)
        q, p = same_width(q, self.points)
        size = np.linalg.norm(q, axis=1)[:, None]
        with np.errstate(invalid="ignore", over="ignore"):
            best = np.minimum(q @ p.T + size * self.radius[None], size * self.longest[None])
            slack = 1e-9 * size * (np.linalg.norm(p, axis=1) + self.radius)[None] + 1
        return np.where(np.isfinite(best) & ~cut[:, None], best + slack, np.inf)

    def first_blocks(self, v: np.ndarray, k: int) -> list[list[int]]:
        """For each query a block of its most promising cell, and of the next ones while these have no more than k rows."""
        q, p = same_width(_near(v)[0], self.points)
        order = np.argsort(-(q @ p.T), axis=1, kind="stable")
        rows = (self.rows / np.maximum(1, self.blocks))[order]
        take = np.cumsum(rows, axis=1) - rows <= 2 * k
        return [[self.first[c] for c in o[t]] for o, t in zip(order, take, strict=True)]

    def further_blocks(self, v: np.ndarray, k: int, least: np.ndarray) -> list[list[int]]:
        """The blocks of all cells that reach each query's k-th score so far, without its first ones."""
        reach = self.bounds(v) >= np.where(np.isnan(least), -np.inf, least)[:, None]
        out = []
        for r, had in zip(reach, self.first_blocks(v, k), strict=True):
            had = set(had)
            out.append([x for c in np.flatnonzero(r) for x in range(self.first[c], self.first[c] + self.blocks[c]) if x not in had])
        return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None, block: int = 4096, query_group: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each row that ``is_query`` with all other rows."""
    spark = vectors.sparkSession
    sound = sound_vectors(vectors)
    wanted = pivots or min(MOST_PIVOTS, max(16, isqrt(vectors.count()) // 2))
    sample = [r["v"] for r in sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()]  # MOST_PIVOTS rows at most
    points = np.unique(matrix(pa.array(sample or [[0.0]], pa.list_(pa.float64())), 1), axis=0)
    cells = written(assign_cells(sound, points).withColumn("asks", F.coalesce(is_query, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "cells")
    stats = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("long").alias("longest"), F.sum(F.col("asks").cast("int")).alias("queries")).collect()}
    shape = Cells(points, stats, block)
    model = spark.sparkContext.broadcast(shape)
    start, groups = shape.query_groups([stats[c]["queries"] for c in shape.known], query_group)
    dealt = spark.createDataFrame(list(zip(shape.known, shape.first, map(int, shape.blocks), start, groups, strict=True)) if shape.known else [], "cell int, first int, blocks int, first_group int, groups int")
    spread = lambda first, n: (F.col(first) + F.pmod(F.xxhash64("row"), F.col(n)).cast("int")).cast("int")
    placed = cells.join(F.broadcast(dealt), "cell")  # MOST_PIVOTS rows
    data = placed.select(spread("first", "blocks").alias("block"), F.col("vec_id").alias("id"), "v")
    asked = placed.where("asks").groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct("v", spread("first_group", "groups").alias("query_group"))).alias("q")).select("id", "q.v", "q.query_group")

    def with_blocks(queries: DataFrame, choose) -> DataFrame:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                least = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                chosen = choose(matrix(b.column("v"), 0), least)
                yield pa.record_batch([b.column("id"), b.column("v"), b.column("query_group"), pa.array(chosen, pa.list_(pa.int32()))], names=["id", "v", "query_group", "blocks"])

        return queries.select("id", "v", "query_group", "least").mapInArrow(make, "id long, v array<double>, query_group int, blocks array<int>")

    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    tried = written(_solve(_meet(with_blocks(asked.withColumn("least", F.lit(None).cast("double")), lambda v, _: model.value.first_blocks(v, k)), data), k), "tried")
    floor = tried.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    # as a double a score may be rounded, by less than the bounds' slack
    found = _solve(_meet(with_blocks(asked.join(floor, "id", "left"), lambda v, least: model.value.further_blocks(v, k, least)), data), k)
    best = tried.unionByName(found).withColumn("rank", F.row_number().over(rank).cast("int")).where(F.col("rank") <= k)
    fits = F.when(F.abs("score") < _MOST, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit in a long")).cast("long"))
    return best.select("query_id", "rank", "vec_id", fits.alias("score"))
