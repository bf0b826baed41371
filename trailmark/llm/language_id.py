"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded sample of the labelled rows (``sample_rows``, chosen by a hash of doc_id, whole texts) and are
summed in Spark by language and bucket; the table of log-probabilities has languages x buckets numbers whatever the corpus, and
is broadcast.  Scoring is one narrow pass: the n-grams of a batch index the table, and sums over each row give its scores.

A null text, or one without a letter, is ``und`` with score 0; so is every text where nothing could be learned.  Ties go to the
language that sorts first.  Repeated rows and null doc_ids give a row each (a null doc_id is neither held out nor learned from).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GRAIN, in_slices, pick

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
_letter = regex.compile(r"\p{L}").search
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_AS = np.arange(128, dtype=np.uint32)
_AS[~np.array([chr(i).isalpha() for i in range(128)])] = 32  # digits and signs say little: one common blank


def ngram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the n-gram at each character; and where each text begins (two blanks follow each text)."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"{t}  " for t in lowered).encode("utf-32-le", "replace"), "<u4").copy()
    low = codes < 128
    codes[low] = _AS[codes[low]]
    first = np.concatenate([[0], np.cumsum([len(t) + 2 for t in lowered])]).astype(np.int64)
    out, h = [], np.zeros(len(codes), np.uint32)
    for k in ORDERS:
        part = codes * _FACTORS[k - 1]
        part ^= part >> np.uint32(15)
        h[: len(h) - k + 1] += part[k - 1 :] * np.uint32(2 * k + 1)
        g = h * np.uint32(0x27D4EB2F) + np.uint32(k)
        out.append((g ^ (g >> np.uint32(16))) % np.uint32(BUCKETS))
    return out, first


def training_rows(docs: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` labelled rows at most, none of them held out."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    kept = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(GRAIN)) < int(share * GRAIN)
    return pick(docs, "doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & kept).select("text", "lang")


def train(docs: DataFrame, sample_rows: int = 6000) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and their log-probabilities by bucket: languages x BUCKETS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                grams, first = ngram_buckets([text])
                mine = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in grams:
                    mine += np.bincount(g[: first[1] - 2], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = training_rows(docs, sample_rows).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        mine = counts[counts["lang"] == lang]
        table[i, mine["bucket"].to_numpy()] += mine["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def score_texts(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Log-likelihoods: texts x languages."""
    grams, first = ngram_buckets(texts)
    out = np.zeros((len(texts), len(table)))
    for g in grams:
        for i, logp in enumerate(table):
            s = logp[g]
            s[first[1:] - 1] = s[first[1:] - 2] = 0.0
            out[:, i] += np.add.reduceat(s, first[:-1])
    return out


def identify(docs: DataFrame, sample_rows: int = 6000) -> DataFrame:
    """For each row: doc_id, held_out, lang_pred, score (the posterior of lang_pred)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), held, F.col("text").cast("string"))
    return predict(rows, *train(docs, sample_rows)).drop("text")


def predict(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """The rows with lang_pred and score by a trained table; rows have a column text and none of these two names."""
    model = rows.sparkSession.sparkContext.broadcast((langs, table))
    kept = rows.columns

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, table = model.value
        texts = batch.column("text").fill_null("").to_pylist()
        known = np.array([bool(langs) and _letter(t) is not None for t in texts])
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if known.any():
            ll = score_texts([t for t, k in zip(texts, known, strict=True) if k], table)
            best = ll.argmax(axis=1)
            pred[known] = np.array(langs, object)[best]
            score[known] = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
        return pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(in_slices(make, step=1 << 19), schema)
