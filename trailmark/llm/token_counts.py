"""Token counts by the whole-token shortcut.

Proven offline, once for each process that opens the tokenizer file: which vocabulary strings, alone, are one pre-token and
encode as one id.  A text's pre-tokens among these count one each without any merge; only the rest are merged, each distinct one
once (see ``bpe``).  One narrow pass over the documents: no shuffle, nothing broadcast, nothing collected.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows and null doc_ids give a row each.  Extra columns are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of, bpe
from .common import in_slices, pick

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """For each row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = bpe(tokenizer_path)
        texts = batch.column("text").fill_null("").to_pylist()
        n = [x for part in batches_of(texts) for x in tool.count(part)]
        return pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string"))
    return rows.mapInArrow(in_slices(make), SCHEMA)
