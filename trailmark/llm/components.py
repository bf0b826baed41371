"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (a, b) with a > b.  Links neighbours to the least node around each node."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.*")
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), "m")
    out = moved.where("a <> m").select("a", F.col("m").alias("b"))
    return out.distinct() if small else out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node that an edge touches; edges: columns a, b (long).

    Runs until nothing changes, which takes a number of rounds like the square of the logarithm of the nodes.  Edges with a null end
    link nothing."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = written(_star(_star(now, small=False), small=True), "edges")
        new = tuple(now.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
