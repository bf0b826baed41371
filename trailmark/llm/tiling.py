"""Benchmark decontamination by greedy string tiling.

Running Karp-Rabin hashes of ``seed`` words are taken at every place of every document and benchmark item; Spark joins equal ones.
For each document and item the shared seeds form diagonal runs; the longest run is marked, then the longest that remains free
of marked words, and so on (greedy string tiling).  An item counts as leaked where the tiles cover ``coverage`` of its words or
more, in whatever order the document has them.

An item of fewer than ``seed`` words counts as leaked where all its words stand in a row.

Before the join a Bloom filter of bounded size (16 bits for each seed of the items, within 2**LEAST_BITS and 2**MOST_BITS bits) drops
document seeds that no item has; it may let others through, and the join settles those.  So nothing that grows is broadcast, and only seeds of
likely leaks are shuffled: one row for each distinct seed of a text, with all its places, so words that repeat make no products of rows.
Pairs of a document and an item are first counted, by the item's places that their seeds cover; only pairs with enough of them get the places
themselves, so a seed that is common in both costs a number a pair, summed before it is shuffled.  Groups are single pairs.

Null texts, and texts and items without words, match nothing.  Items of one item_id (or of none) with different texts are items of
their own; repeated items of one item_id give one row, those of different ids, and repeated documents, a row each.  Extra columns are
left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, pick, written
from .wordhash import hash_words, rolling

LEAST_BITS, MOST_BITS = 24, 27
_SEEDS = "row long, id long, words int, size int, seed long, places array<int>"


def seeds_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of k words that stays in its row: row number, place, hash; and the word count of every row."""
    w = hash_words(column)
    h = rolling(w.hashes, k)
    row = w.rows()
    inside = np.flatnonzero(row[: len(h)] == row[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    return row[inside], inside - w.first[row[inside]], h[inside], w.counts()


def sizes_of(items: DataFrame, seed: int) -> list[int]:
    """The runs of words to look for: ``seed`` words, and the lengths of shorter items."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.unique(hash_words(batch.column("text")).counts())
            yield pa.record_batch([pa.array(n[(n > 0) & (n < seed)], pa.int64())], names=["n"])

    short = pick(items, "text").select(F.col("text").cast("string")).mapInArrow(make, "n long").distinct().collect()  # fewer than ``seed`` rows
    return sorted({seed, *(r["n"] for r in short)})


def _bits(keep: np.ndarray) -> int:
    return len(keep).bit_length() + 2  # bytes, a power of two


def seed_rows(texts: DataFrame, id_column: str, sizes: list[int], keep: np.ndarray | None = None) -> DataFrame:
    """row, id, words, size, seed, places for the distinct seeds of each text (of those in the filter ``keep``, if given).

    Without a filter the texts are items, whose seeds have the greatest size or, in shorter items, all words."""
    kept = texts.sparkSession.sparkContext.broadcast(keep)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for k in sizes:
            row, place, h, words = seeds_of(batch.column("text"), k)
            if kept.value is not None:
                slot = h >> np.uint64(64 - _bits(kept.value))
                hit = np.flatnonzero(kept.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            else:
                hit = np.flatnonzero((words[row] == k) | (k == sizes[-1]))
            row, place, h = row[hit], place[hit], h[hit]
            order = np.lexsort((place, h, row))
            row, place, h = row[order], place[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(row) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
            row, h = row[first], h[first]
            take = pa.array(row)
            parts.append(
                pa.record_batch(
                    [batch.column("row").take(take), batch.column("id").take(take), pa.array(words[row].astype(np.int32)), pa.array(np.full(len(row), k, np.int32)), pa.array(h.view(np.int64)), places],
                    names=["row", "id", "words", "size", "seed", "places"],
                )
            )
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(x.num_rows for x in parts) else None

    rows = pick(texts, id_column, "text").select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col("text").cast("string"))
    return rows.mapInArrow(in_slices(make), _SEEDS)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter of the items' seeds, or-ed from at most eight parts of bounded size."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * seeds.count()).bit_length()))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, bool)
        for batch in batches:
            found[batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        yield pa.record_batch([pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for part in seeds.select("seed").coalesce(8).mapInArrow(make, "bits binary").toLocalIterator():
        out |= np.frombuffer(part["bits"], np.uint8)
    return out


def tile(places: np.ndarray, item_places: np.ndarray, words: int, k: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the text, place in the item, words) from the places of shared seeds of k words, longest first."""
    order = np.lexsort((places, places - item_places))
    d, i = places[order], item_places[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 1) | (np.diff(i) != 1)]))
    ends = np.concatenate([starts[1:], [len(d)]])
    heap = [(-(int(e - s) + k - 1), int(d[s]), int(i[s])) for s, e in zip(starts, ends, strict=True)]
    heapq.heapify(heap)
    in_text: set[int] = set()
    in_item, free, out = bytearray(words), words, []
    while heap and free >= k:
        n, at, item_at = heapq.heappop(heap)
        n = -n
        runs, begin = [], None
        for x in range(n):
            taken = in_item[item_at + x] or (at + x) in in_text
            if not taken and begin is None:
                begin = x
            if taken and begin is not None:
                runs.append((begin, x))
                begin = None
        if begin is not None:
            runs.append((begin, n))
        if runs == [(0, n)]:
            out.append((at, item_at, n))
            in_text.update(range(at, at + n))
            in_item[item_at : item_at + n] = b"\1" * n
            free -= n
        else:
            for a, b in runs:
                if b - a >= k:
                    heapq.heappush(heap, (a - b, at + a, item_at + a))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, seed: int = 5, coverage: float = 0.7) -> DataFrame:
    """doc_id, item_id, coverage, tiles, first_word for each document row and item whose tiles cover enough of the item."""
    items = written(pick(items, "item_id", "text").distinct(), "items")
    sizes = sizes_of(items, seed)
    theirs = written(seed_rows(items, "item_id", sizes).select(F.col("row").alias("item"), F.col("id").alias("item_id"), "words", "size", F.col("places").alias("item_places"), "seed"), "item_seeds")
    own = written(seed_rows(docs, "doc_id", sizes, seed_filter(theirs)).withColumnRenamed("id", "doc_id").drop("words"), "seeds")
    counted = own.select("row", "seed", "size").join(theirs.select("item", "words", "size", "seed", F.size("item_places").alias("n")), ["seed", "size"])
    enough = counted.groupBy("row", "item", "words", "size").agg(F.sum("n").alias("n")).where(F.col("n") * F.col("size") >= coverage * F.col("words")).select("row", "item")
    shared = own.join(theirs, ["seed", "size"]).join(written(enough, "pairs"), ["row", "item"], "left_semi")
    likely = shared.groupBy("row", "item", "doc_id", "item_id", "words", "size").agg(F.collect_list("places").alias("places"), F.collect_list("item_places").alias("item_places"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, item_id, words, size, p, q in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "item_id", "words", "size", "places", "item_places")], strict=True):
            at = np.concatenate([np.repeat(np.array(a, np.int64), len(b)) for a, b in zip(p, q, strict=True)])
            item_at = np.concatenate([np.tile(np.array(b, np.int64), len(a)) for a, b in zip(p, q, strict=True)])
            tiles = tile(at, item_at, words, size)
            share = sum(t[2] for t in tiles) / words
            if share >= coverage:
                out.append({"doc_id": doc_id, "item_id": item_id, "coverage": share, "tiles": len(tiles), "first_word": min(t[0] for t in tiles)})
        kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64()), ("first_word", pa.int64())])
        return pa.RecordBatch.from_pylist(out, kind)

    return likely.select("doc_id", "item_id", "words", "size", "places", "item_places").mapInArrow(in_slices(make, "places"), "doc_id long, item_id long, coverage double, tiles long, first_word long")
