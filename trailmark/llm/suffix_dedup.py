"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes (of word sequences) are kept only at minimiser positions: of every ``window`` consecutive runs of ``prefix`` words, the
leftmost of least hash.  Which positions these are depends on the words alone, so a passage has the same ones wherever it stands, and
any passage of prefix + window - 1 = ``min_words`` words has one.  Kept suffixes are sorted by their prefix (a range partitioning, so
that even one prefix with a third of all suffixes spreads over tasks) and neighbours compared; those with a neighbour of equal
prefix in another document survive.

Surviving suffixes are sorted once more, by prefix and then by the words that follow, as in a suffix array, with the words before each
kept beside it.  Each is compared with its neighbours in other documents, to the right and to the left: every passage of ``min_words``
words around it that a neighbour has too is confirmed.  A neighbour that agrees far to the right may agree little to the left, so a
passage may still be shared with a suffix further off.  Passages that no neighbour confirms are therefore fingerprinted, and so is, once
a batch of rows, each confirmed one; sorted, they are compared with their neighbours like the prefixes before.  Confirmed passages are
merged into spans for each document: exactly the words that lie in a passage of ``min_words`` words or more which another document has
too (words as 64-bit hashes in prefixes, as 32-bit hashes beside them).

Runs are compared over task borders through the first and last row of each task: two rows a task.  Suffixes at a border of rows that
are handled together only leave more to the fingerprints.

Rows that share a doc_id are one document; repeats within one document don't count.  Rows without a doc_id count as other documents
(equal ones as one), but as nothing names them they aren't returned.  Null texts and texts of fewer than ``min_words`` words take no
part.  Only documents with a span are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, pick, release, written
from .wordhash import hash_words, mix, powers, rolling

MIN_WORDS = 50
WINDOW = 25
_NAMELESS = 1 << 61
#: Stands for all documents that have a confirmed passage.
_CONFIRMED = -(1 << 63) + 1
#: Stands for the document that has this very id.
_OF_THAT_ID = -(1 << 62) + 12345


def minimisers(column: pa.Array, min_words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of min_words words inside its row: row, start, minimiser's place, minimiser's hash, the run's own hash."""
    w = hash_words(column)
    none = np.zeros(0, np.int64)
    if len(w.hashes) < min_words:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    h = rolling(w.hashes, min_words - window + 1)
    best, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < window:
        step = min(size, window - size)
        a, b = best[:-step], best[step:]
        right = b < a
        best, at = np.where(right, b, a), np.where(right, at[step:], at[:-step])
        size += step
    row = w.rows()
    start = np.flatnonzero(row[: len(row) - min_words + 1] == row[min_words - 1 :])
    row, own = row[start], rolling(w.hashes, min_words)[start]
    return row, start - w.first[row], at[start] - w.first[row], best[start], own


def suffixes(docs: DataFrame, min_words: int, window: int) -> DataFrame:
    """key (of the first words), id and place of each kept suffix."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, _, at, key, _ = minimisers(batch.column("text"), min_words, window)
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])]) if len(row) else np.zeros(0, bool)
        return pa.record_batch([pa.array(key[new].view(np.int64)), batch.column("id").take(pa.array(row[new])), pa.array(at[new].astype(np.int32))], names=["key", "id", "place"])

    return docs.mapInArrow(in_slices(make), "key long, id long, place int")


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of 32-bit words as binary values that sort as the words do."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (4 * width)).astype(np.int32)), pa.py_buffer(rows.astype(">u4").tobytes())])


def contexts(docs: DataFrame, min_words: int, window: int) -> DataFrame:
    """docs: id, text, places of surviving suffixes.  Each with the window - 1 words after its prefix and before it (nearest first),
    and the range of words (low to high) that passages which have it as their minimiser begin before it."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, at, key, _ = minimisers(batch.column("text"), min_words, window)
        places = batch.column("places")
        flat = places.flatten().to_numpy().astype(np.int64) | (np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy())) << 32)
        keep = np.flatnonzero(np.isin(at | (row << 32), flat))
        row, start, at, key = row[keep], start[keep], at[keep], key[keep]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])])) if len(row) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(row)) - 1  # passages of one minimiser begin at consecutive words
        w = hash_words(batch.column("text"))
        words = np.append(np.maximum((w.hashes >> np.uint64(32)).astype(np.uint32), np.uint32(1)), np.uint32(0))  # 0: outside the row
        begin, end, step = w.first[row[new]][:, None], w.first[row[new] + 1][:, None], np.arange(window - 1)
        p = begin[:, 0] + at[new]
        near = lambda i: words[np.where((i >= begin) & (i < end), i, -1)]
        after, before = near(p[:, None] + (min_words - window + 1) + step), near(p[:, None] - 1 - step)
        low, high = at[new] - start[last], at[new] - start[new]
        return pa.record_batch(
            [pa.array(key[new].view(np.int64)), batch.column("id").take(pa.array(row[new])), pa.array(at[new].astype(np.int32)), _binary(after), _binary(before), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
            names=["key", "id", "place", "after", "before", "low", "high"],
        )

    return docs.mapInArrow(in_slices(make), "key long, id long, place int, after binary, before binary, low int, high int")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first words of each row are the same."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def _extended(window: int):
    """Sorted suffixes in; out: kind 0, confirmed passages (they begin at low to high); kind 1, unconfirmed ones (key: fingerprint);
    kind 2, the fingerprints of confirmed ones, once each."""
    width = window - 1
    up, down = powers(0x9FB21C651E98DF25, width)[0], powers(0xD6E8FEB86659FD93, width)[0]

    def out(kind, key, id_, low, high):
        return pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(id_), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["kind", "key", "id", "low", "high"])

    def sums(words: np.ndarray, factors: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(words.astype(np.uint64) * factors[None], axis=1, dtype=np.uint64)], axis=1)

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = b.num_rows
        key, id_, place, low, high = (b.column(c).to_numpy() for c in ("key", "id", "place", "low", "high"))
        after, before = (np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(n, width).astype(np.uint32) for c in ("after", "before"))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        l = np.arange(window)[None]  # words before the suffix
        wanted = (l >= low[:, None]) & (l <= high[:, None])
        sure = np.zeros((n, window), bool)
        for other in (first[run] - 1, np.append(first[1:], n)[run]):
            there = np.flatnonzero((other >= 0) & (other < n))
            there = there[key[other[there]] == key[there]]
            o = other[there]
            right, left = _agreement(after[there], after[o]), _agreement(before[there], before[o])
            lo, hi = np.maximum(low[there], width - right), np.minimum(high[there], left)
            good = lo <= hi
            there, lo, hi = there[good], lo[good], hi[good]
            sure[there] |= (l >= lo[:, None]) & (l <= hi[:, None])
            yield out(0, key[there], id_[there], place[there] - hi, place[there] - lo)
        prints = mix(sums(before, up) + sums(after, down)[:, ::-1] * np.uint64(0x9E3779B97F4A7C15) + key.view(np.uint64)[:, None])
        i, j = np.nonzero(wanted & ~sure)
        yield out(1, prints[i, j].view(np.int64), id_[i], place[i] - j, place[i] - j)
        known = np.unique(prints[sure]).view(np.int64)
        yield out(2, known, np.full(len(known), _CONFIRMED), np.zeros(len(known)), np.zeros(len(known)))

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                yield from make(b.slice(lo, 4096))
        release()

    return run_all


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; out: kind 0, rows whose key another id has too; kind 1 or 2, the first and last (key, id) of the task, not
    or already so; such rows of kind 1 stand for all their places."""
    held: list[np.ndarray] | None = None
    before: int | None = None  # the key of the (key, id) run before the held one
    begun = False

    def out(key, id_, place, kind):
        return pa.record_batch([pa.array(key), pa.array(id_), pa.array(place), pa.array(np.broadcast_to(np.int32(kind), key.shape))], names=["key", "id", "place", "kind"])

    def decide(key, id_, place, after: int | None, last: bool):
        """All rows given; the key of the run after them."""
        nonlocal before, begun
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])])
        run = np.cumsum(new) - 1
        keys = key[new]
        prev = np.concatenate([[False], keys[1:] == keys[:-1]])
        prev[0] = before is not None and before == keys[0]
        follow = np.concatenate([keys[1:] == keys[:-1], [after is not None and after == keys[-1]]])
        twin = (prev | follow)[run]
        edge = np.zeros(len(keys), bool)
        if not begun:
            edge[0], begun = True, True
        if last:
            edge[-1] = True
        before = int(keys[-1])
        if twin.any():
            yield out(key[twin], id_[twin], place[twin], 0)
        for e in np.flatnonzero(edge):
            mine = run == e
            if twin[mine][0]:
                mine = np.flatnonzero(mine)[:1]
                yield out(key[mine], id_[mine], place[mine], 2)
            else:
                yield out(key[mine], id_[mine], place[mine], 1)

    for b in batches:
        got = [b.column(c).to_numpy() for c in ("key", "id", "place")]
        if not len(got[0]):
            continue
        if held is not None:
            got = [np.concatenate(x) for x in zip(held, got, strict=True)]
        key, id_, place = got
        cut = int(np.flatnonzero((key != key[-1]) | (id_ != id_[-1]))[-1]) + 1 if (key[0] != key[-1] or id_[0] != id_[-1]) else 0
        held = [key[cut:], id_[cut:], place[cut:]]
        if cut:
            yield from decide(key[:cut], id_[:cut], place[:cut], int(key[cut]), False)
    if held is not None:
        yield from decide(*held, None, True)


def shared_rows(rows: DataFrame, name: str) -> DataFrame:
    """id and place of the rows of (key, id, place) whose key stands under another id too."""
    ordered = rows.repartitionByRange("key", "id", "place").sortWithinPartitions("key", "id", "place")
    marked = written(ordered.mapInArrow(_neighbours, "key long, id long, place int, kind int"), name)
    edges = marked.where("kind > 0")
    # a row of kind 2 proves its key shared, though the other id may stand inside that task only
    twice = edges.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("kind").alias("k")).where("a <> b OR k = 2").select("key")
    return marked.where("kind = 0").select("id", "place").unionByName(edges.where("kind = 1").join(twice, "key", "left_semi").select("id", "place"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id, n_spans, n_words (in spans) and spans (start-end in words, end exclusive) of documents that share a passage."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    nameless = -(F.pmod(F.xxhash64(text), F.lit(_NAMELESS)) + F.lit(_NAMELESS))  # a hash below -_NAMELESS
    named = F.when(doc_id == _CONFIRMED, F.lit(_OF_THAT_ID)).otherwise(doc_id)
    texts = pick(docs, "doc_id", "text").where("text IS NOT NULL").select(F.coalesce(named, nameless).alias("id"), text.alias("text"))
    survivors = shared_rows(suffixes(texts, min_words, window), "suffixes")
    around = survivors.groupBy("id").agg(F.collect_set("place").alias("places"))
    ordered = contexts(texts.join(around, "id"), min_words, window).repartitionByRange("key", "after", "id", "place").sortWithinPartitions("key", "after", "id", "place")
    extended = written(ordered.mapInArrow(_extended(window), "kind int, key long, id long, low int, high int"), "extended")
    more = shared_rows(extended.where("kind > 0").select("key", "id", F.col("low").alias("place")), "passages")
    found = extended.where("kind = 0").select("id", "low", "high").unionByName(more.select("id", F.col("place").alias("low"), F.col("place").alias("high")))
    low = pick(docs, "doc_id").select(named.alias("id")).where(F.col("id") <= -_NAMELESS).distinct()  # ids in use that look nameless
    found = found.where(F.col("id") > -_NAMELESS).unionByName(found.where(F.col("id") <= -_NAMELESS).join(low, "id", "left_semi"))
    starts = found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("ranges"))

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, words, spans = [], [], []
        for r in batch.column("ranges"):
            low, high = (r.values.field(i).to_numpy() for i in (0, 1))
            high = np.maximum.accumulate(high) + min_words
            new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
            a, b = low[new], high[np.append(new[1:], len(low)) - 1]
            n.append(len(a))
            words.append(int((b - a).sum()))
            spans.append(",".join(f"{x}-{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)))
        return pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(spans, pa.string())], names=["doc_id", "n_spans", "n_words", "spans"])

    out = starts.mapInArrow(in_slices(merge, "ranges"), "doc_id long, n_spans long, n_words long, spans string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") == _OF_THAT_ID, F.lit(_CONFIRMED)).otherwise(F.col("doc_id")))
