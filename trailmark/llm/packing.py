"""Packing of tokenized documents into fixed-length sequences: first-fit decreasing with a tournament tree.

Every document becomes its token ids and an end id.  It is cut at multiples of the sequence length; all but its last piece fill a
sequence alone.  Documents are dealt at random into groups of about ``group_size``; in each group, independently, the last pieces
are sorted by length and each goes to the leftmost bin with room, which a tournament tree over the bins' free room finds in
logarithmic time.  Only piece lengths and checksums are shuffled, never texts.  Groups are dealt by a hash of the row's number in
the written table, so no document id, source or length can make one group large.

Null texts are empty: one piece, the end id alone.  Repeated rows and null doc_ids are documents of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of, bpe
from .common import in_slices, pick, written

PIECES = "doc_id long, doc_tokens long, pieces array<struct<start: long, length: long, ids_crc32: long>>"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its offset there.  Ties in length keep the given order."""
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * size)  # a tournament tree: each inner node has the larger room of its two children
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < size:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - size, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """For each row its token count and its pieces of at most ``capacity`` ids."""
    end = np.array([end_id], "<u4").tobytes()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = bpe(tokenizer_path)
        counts, pieces = [], []
        for part in batches_of(batch.column("text").fill_null("").to_pylist()):
            for ids in tool.ids(part):
                ids += end
                n = len(ids) // 4
                counts.append(n)
                pieces.append([{"start": s, "length": min(capacity, n - s), "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + capacity)])} for s in range(0, n, capacity)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(pieces, kind)], names=["doc_id", "doc_tokens", "pieces"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(in_slices(make), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, group_size: int = 4096) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(tokenize_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_size))

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["pack_group"].iloc[0]) << 32
        flat = pdf.explode("pieces", ignore_index=True)
        out = pd.DataFrame({k: [p[k] for p in flat["pieces"]] for k in ("start", "length", "ids_crc32")}, dtype="int64")
        out.insert(0, "doc_id", flat["doc_id"].astype("Int64"))
        out["doc_tokens"] = flat["doc_tokens"].astype("int64")
        length = out["length"].to_numpy()
        part = length < capacity
        sequence, offset = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
        sequence[part], offset[part] = first_fit_decreasing(length[part], capacity)
        used = int(sequence[part].max()) + 1 if part.any() else 0
        sequence[~part] = used + np.arange(int((~part).sum()))
        out["sequence_id"], out["offset"] = base + sequence, offset
        return out

    dealt = pieces.withColumn("pack_row", F.monotonically_increasing_id()).withColumn("pack_group", F.pmod(F.xxhash64("pack_row"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(pack_group, PACKED)


def padding_share(lengths: Iterable[int], capacity: int = 1024) -> float:
    """Padding over all of the ids and padding, given the filled lengths of sequences; a power of two isn't padded."""
    filled = list(lengths)
    padding = sum(capacity - n for n in filled if n & (n - 1))
    return padding / max(1, sum(filled) + padding)
