"""Near-duplicate embeddings: vectors linked by a cosine of at least ``least``, joined into components.

Rows are dealt into shards of about ``shard_rows`` by a hash.  Each shard becomes a hierarchical navigable small-world graph (hnsw.py), and
its search beam is widened until an audit against all nodes of the shard passes.  Then every vector queries every shard; beams that are
full of possible links are widened until they aren't, and cosines are verified in double precision.  The queries are dealt into parts of
about ``query_rows``, but ``most_parts`` at most, so that a graph is copied for no more parts as rows grow; each part streams past
the graph, which is sent in pieces of ``piece_bytes``.  Vectors that lie so close that all of them are linked form balls, which are nodes of the graph: a crowd of copies is
counted, not compared pair by pair, and hands on one link for each two balls that touch.  Links are found by search, so one may
be missed; the audit's share (``target``) is asked of each shard, and tests hold results against comparing all pairs.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null vec_id, link with nothing: n_links is 0, component_id
their own vec_id, and they are kept.  Vectors shorter than others count as if zeros followed.  Repeated rows, also of one vec_id, are vectors
of their own, each linked with the others; all rows whose vec_id is their component's are kept.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, release, written
from .components import components
from .hnsw import Graph
from .knn_join import matrix


def directions(column: pa.Array, dims: int = 1) -> np.ndarray:
    """Unit vectors of a list column whose rows are finite and not zero."""
    v = matrix(column, dims)
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=0.0)  # so that squares stay within doubles
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _sharded(vectors: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """vec_id, row, shard (null: links with nothing), v; and how many shards there are."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    numbered = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(sound, F.lit(False)).alias("sound"), v.alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = written(numbered.select("vec_id", "row", "sound", F.when(F.col("sound"), F.col("v")).alias("v")), "vectors")
    shards = max(1, -(-rows.where("sound").count() // shard_rows))
    return rows.withColumn("shard", F.when(F.col("sound"), F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))), shards


def _graphs(rows: DataFrame, least: float, target: float, piece_bytes: int) -> DataFrame:
    """For each vector: shard, row, v, leader (the row that stands for its ball); for each shard its graph instead, in numbered pieces."""

    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        shard, n = t.column("shard")[0].as_py(), t.num_rows
        graph = Graph(t.column("row").to_numpy(), directions(t.column("v").combine_chunks()), least)
        graph.audit(target)
        leader = graph.rows[graph.node[graph.ball]]
        of_row = pa.table([pa.array(np.full(n, shard, np.int32)), t.column("row"), t.column("v"), pa.array(leader), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["shard", "row", "v", "leader", "piece", "graph"])
        data = graph.dumped()
        pieces = [data[lo : lo + piece_bytes] for lo in range(0, len(data), piece_bytes)]
        k = len(pieces)
        of_shard = pa.table([pa.array(np.full(k, shard, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, t.column("v").type), pa.nulls(k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), pa.array(pieces, pa.binary())], names=of_row.column_names)
        release()
        return pa.concat_tables([of_row, of_shard.cast(of_row.schema)])

    return rows.select("shard", "row", "v").groupBy("shard").applyInArrow(make, "shard int, row long, v array<double>, leader long, piece int, graph binary")


def _found(graph: Graph, rows: np.ndarray, q: np.ndarray, leader: np.ndarray) -> pa.RecordBatch:
    """row, links (in the graph's shard); and a, b: balls that touch."""
    wide = q.shape[1] - graph.unit.shape[1]
    if wide > 0:
        graph.unit, graph.vectors = (np.pad(x, ((0, 0), (0, wide))) for x in (graph.unit, graph.vectors))
    links, r, node = graph.linked(rows, q)
    touch = np.unique(np.stack([leader[r], graph.rows[graph.node[node]]], axis=1), axis=0)
    touch = touch[touch[:, 0] != touch[:, 1]]
    some = np.flatnonzero(links)
    none = lambda n: pa.nulls(n, pa.int64())
    columns = [(pa.array(rows[some]), none(len(touch))), (pa.array(links[some]), none(len(touch))), (none(len(some)), pa.array(touch[:, 0])), (none(len(some)), pa.array(touch[:, 1]))]
    return pa.record_batch([pa.concat_arrays(c) for c in columns], names=["row", "links", "a", "b"])


def _search(queries: DataFrame, graphs: DataFrame, groups: int, step: int = 1 << 10) -> DataFrame:
    """queries: shard, part, row, v, leader; graphs: shard, part, piece, graph.  row, links (in that shard); and a, b: balls that touch.

    A graph's pieces come before the queries of its shard and part, which meet it ``step`` at a time: no group is held whole."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had, graph, pieces = None, None, []
        for batch in batches:
            shard, part = (batch.column(c).to_numpy() for c in ("shard", "part"))
            is_query = batch.column("piece").is_null().to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for lo, hi in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                run = batch.slice(lo, hi - lo)
                if (key := (shard[lo], part[lo])) != had:
                    had, graph, pieces = key, None, []
                if not is_query[lo]:
                    pieces += run.column("graph").to_pylist()
                    continue
                if pieces:
                    graph, pieces = Graph.loaded(b"".join(pieces)), []
                for at in range(0, run.num_rows if graph else 0, step):
                    some = run.slice(at, step)
                    yield _found(graph, some.column("row").to_numpy(), directions(some.column("v"), graph.unit.shape[1]), some.column("leader").to_numpy())
        graph = None
        release()

    null = lambda kind: F.lit(None).cast(kind)
    met = queries.select("shard", "part", null("int").alias("piece"), "row", "v", "leader", null("binary").alias("graph")).unionAll(
        graphs.select("shard", "part", "piece", null("long").alias("row"), null("array<double>").alias("v"), null("long").alias("leader"), "graph")
    )
    dealt = met.repartition(groups, "shard", "part").sortWithinPartitions("shard", "part", F.asc_nulls_last("piece"), "leader")
    return dealt.mapInArrow(make, "row long, links long, a long, b long")


def linked_components(vectors: DataFrame, least: float = 0.9, target: float = 0.99, shard_rows: int = 1 << 15, query_rows: int = 1 << 14, most_parts: int = 8, piece_bytes: int = 1 << 21) -> DataFrame:
    """vec_id, n_links (other vectors linked with it), component_id (smallest vec_id that links lead to), kept: one row per vector."""
    rows, shards = _sharded(vectors, shard_rows)
    built = written(_graphs(rows.where("sound"), least, target, piece_bytes), "graphs")
    parts = max(1, min(most_parts, -(-shards * shard_rows // query_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = built.where("piece IS NULL").select("row", "v", "leader")
    queries = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part"), "row", "v", "leader")
    graphs = built.where("piece IS NOT NULL").select("shard", every(parts).alias("part"), "piece", "graph")
    found = written(_search(queries, graphs, 2 * shards * parts), "links")

    counts = found.where("row IS NOT NULL").groupBy("row").agg(F.sum("links").alias("n_links"))
    roots = components(found.where("a IS NOT NULL").select("a", "b"))
    placed = written(rows.select("vec_id", "row").join(asked.select("row", "leader"), "row", "left").join(counts, "row", "left"), "placed")
    balls = placed.where("leader IS NOT NULL").groupBy("leader").agg(F.min("vec_id").alias("least"))
    balls = written(balls.join(roots, F.col("leader") == F.col("node"), "left").select("leader", "least", F.coalesce("root", "leader").alias("root")), "balls")
    least_ids = balls.groupBy("root").agg(F.min("least").alias("component"))
    of_ball = balls.join(least_ids, "root").select("leader", "component")
    out = placed.join(of_ball, "leader", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
