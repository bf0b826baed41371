"""Toxicity by a classifier chain.

Categories are predicted one after another.  Each has a linear (logistic) model over the words that a text contains, hashed; every
model after the first also gets the probabilities of the categories before it.  While training, those come from out-of-fold
models, so that a later model learns from probabilities as good as it will meet.  The decision threshold of each category is the
one of best F1 over its own out-of-fold probabilities.

Models are fitted on a bounded sample of the labelled documents: ``sample_rows`` doc_ids at most, those of least hash, whole texts.
Repeated labels of a doc_id count as one (1 wins), and of repeated documents the least text.  Their features (word buckets) and labels
are at most sample_rows lists and are collected; scoring is one narrow pass over all rows.  Words that the sample says little about
have no weight: those in fewer than ``least`` of its rows, and those whose log-odds are within ``sure`` standard errors of nothing.

The labels table has one toxicity category, toxic; the query chains quality before it, so the chain there is low_quality -> toxic.

A null or wordless text has no features, and the chain's bias alone scores it.  Null labels count as 0.  If a category has no
positive or no negative row in the sample, its probability is 0 or 1 throughout.  Repeated rows and null doc_ids give a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GRAIN, in_slices, pick
from .wordhash import hash_words

BITS = 20


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word buckets of each row, one row after another, and where each row's begin."""
    w = hash_words(column)
    both = np.unique((w.rows().astype(np.uint64) << np.uint64(BITS)) | (w.hashes >> np.uint64(64 - BITS)))
    first = np.searchsorted(both >> np.uint64(BITS), np.arange(len(column) + 1, dtype=np.uint64))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int32), first


@dataclass
class Rows:
    """Sparse 0/1 features."""

    buckets: np.ndarray
    first: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.first[rows] - first[:-1], n) + np.arange(first[-1])
        return Rows(self.buckets[at], first)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.buckets])])
        return total[self.first[1:]] - total[self.first[:-1]]


@dataclass
class Linear:
    """A logistic model: word weights (sparse), weights of earlier categories, bias; ``constant`` where there was nothing to learn."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    constant: float | None = None

    def probability(self, x: Rows, before: np.ndarray) -> np.ndarray:
        n = len(x.first) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        w = np.zeros(1 << BITS)
        w[self.buckets] = self.weights
        return _sigmoid(x.sums(w) + before @ self.earlier + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Rows, before: np.ndarray, y: np.ndarray, least: int = 5, sure: float = 3.0, l2: float = 0.2, steps: int = 150) -> Linear:
    """Logistic regression by Adam over the buckets that ``least`` rows have and whose log-odds z-score is ``sure`` or more, or, where
    the sample is too small for such, over the 20 of largest score."""
    n, k = len(y), before.shape[1]
    if y.min(initial=1) == y.max(initial=0) or not n:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(k), 0.0, float(y[0]) if n else 0.0)
    row = np.repeat(np.arange(n), np.diff(x.first))
    pos = np.bincount(x.buckets, weights=y[row], minlength=1 << BITS)
    all_ = np.bincount(x.buckets, minlength=1 << BITS)
    p, q = (pos + 0.5) / (y.sum() + 1), (all_ - pos + 0.5) / (n - y.sum() + 1)
    z = np.abs(np.log(p / q)) / np.sqrt(1 / (pos + 0.5) + 1 / (all_ - pos + 0.5))
    z[all_ < least] = 0
    best = np.argsort(-z, kind="stable")[: max(20, int((z >= sure).sum()))]
    chosen = np.sort(best[z[best] > 0])
    to = np.full(1 << BITS, -1)
    to[chosen] = np.arange(len(chosen))
    keep = to[x.buckets] >= 0
    col, row = to[x.buckets[keep]], row[keep]
    w, m, v = np.zeros(len(chosen) + k + 1), 0.0, 0.0
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for t in range(1, steps + 1):
        s = np.bincount(row, weights=w[col], minlength=n) + before @ w[len(chosen) : -1] + w[-1]
        g = _sigmoid(s) - y
        grad = np.concatenate([np.bincount(col, weights=g[row], minlength=len(chosen)) + l2 * w[: len(chosen)], before.T @ g + l2 * w[len(chosen) : -1], [g.sum()]]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, x: Rows) -> np.ndarray:
        out = np.zeros((len(x.first) - 1, 0))
        for m in self.models:
            out = np.column_stack([out, m.probability(x, out)])
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut between two different probabilities that has the best F1 of those above which half the rows are positive; 0.5 where
    there is none."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    cuts = np.flatnonzero((p[:-1] > p[1:]) & (2 * hits[:-1] >= np.arange(1, len(p))))
    if not len(cuts):
        return 0.5
    f1 = 2 * hits[cuts] / (cuts + 1 + y.sum())
    i = int(cuts[f1.argmax()])
    return float((p[i] + p[i + 1]) / 2)


def fit_chain(x: Rows, labels: np.ndarray, names: list[str], folds: int = 4) -> Chain:
    """labels: rows x categories, in the chain's order.  Rows' folds go round in their order."""
    n = len(labels)
    fold = np.arange(n) % folds
    before, chain = np.zeros((n, 0)), Chain(names, [], [])
    for c in range(len(names)):
        y, out = labels[:, c].astype(float), np.zeros(n)
        for f in range(folds):
            a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            out[b] = fit(x.take(a), before[a], y[a]).probability(x.take(b), before[b])
        chain.models.append(fit(x, before, y))
        chain.thresholds.append(best_threshold(out, y))
        before = np.column_stack([before, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = 12_000) -> Chain:
    """categories: names in the chain's order, each with its 0/1 label as an expression over ``labels``."""
    names = list(categories)
    share = min(1.0, 1.2 * sample_rows / max(1, labels.count()))
    first = F.xxhash64(F.col("doc_id").cast("string"))
    kept = F.pmod(first, F.lit(GRAIN)) < int(share * GRAIN)
    known = labels.where(kept & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(categories.values())])
    once = known.groupBy("doc_id").agg(F.array(*[F.max(f"y{i}") for i in range(len(names))]).alias("y"))
    sample = once.orderBy(F.pmod(first, F.lit(GRAIN)), "doc_id").limit(sample_rows)
    found = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(sample), "doc_id")  # sample_rows bounds it
    rows = found.groupBy("doc_id", "y").agg(F.min(F.col("text").cast("string")).alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        b, first = features(batch.column("text"))
        return pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(b))], names=["doc_id", "y", "buckets"])

    got = rows.select("doc_id", "text", "y").mapInArrow(in_slices(make), "doc_id long, y array<int>, buckets array<int>").toArrow().combine_chunks()
    column = lambda c: pa.concat_arrays(got.column(c).chunks) if got.num_rows else pa.array([], got.schema.field(c).type)
    lists, y = column("buckets"), column("y").flatten().to_numpy().reshape(-1, len(names))
    x = Rows(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64))
    order = np.lexsort((x.sums(np.arange(1 << BITS, dtype=float)), column("doc_id").to_numpy()))  # the same whatever task came first
    return fit_chain(x.take(order), y[order], names)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """For each row: doc_id, p_<category> and is_<category> for every category of the chain."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"{a}_{c}" for c in chain.names for a in ("p", "is")]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        b, first = features(batch.column("text"))
        p = model.value.probabilities(Rows(b, first))
        columns = [a for c, t in enumerate(model.value.thresholds) for a in (pa.array(p[:, c]), pa.array(p[:, c] >= t))]
        return pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", *names])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(in_slices(make), ", ".join(["doc_id long", *[f"{n} {'double' if n[0] == 'p' else 'boolean'}" for n in names]]))
