"""Names that stand in texts as whole words (P13), by an automaton of all names: one pass over the texts, however many names there are.

An Aho-Corasick automaton finds every name at once, those that begin alike or hold one another too.  Names are dealt into automata of at
most ``most_chars`` characters, which bounds what is sent to tasks and what these hold; each is one pass over the texts, which stay where
they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 4_000_000
_built: dict[int, object] = {}


def _lower(text: str) -> str:
    """The text in small letters, as long as it was."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _automaton(shared):
    """Built once in a worker process and kept for its later tasks; only the last one is."""
    if shared.id not in _built:
        import ahocorasick

        _built.clear()
        out = ahocorasick.Automaton()
        for name in shared.value:
            low = _lower(name)
            out.add_word(low, (*out.get(low, ()), name))
        out.make_automaton()
        _built[shared.id] = out
    return _built[shared.id]


class _Shared:
    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self) -> list[str]:
        return self.broadcast.value


def found_names(text: str, automaton) -> set[str]:
    """Names whose both ends don't go on as words."""
    low, out = _lower(text), set()
    for end, names in automaton.iter(low):
        n = len(names[0])
        begin = end - n + 1
        before, after = (begin > 0 and _is_word(low[begin - 1])), (end + 1 < len(low) and _is_word(low[end + 1]))
        if not before and not after:
            out.update(names)
    return out


def mentioned_names(texts: DataFrame, names: DataFrame, key: str, text: str, name: str = "company", most_chars: int = MOST_CHARS) -> DataFrame:
    """key, name: each name that stands in a text as whole words, whatever its case.  Null and blank names stand nowhere.

    Equal keys are one text's; names that differ in case are names of their own."""
    spark = texts.sparkSession
    known = names.select(F.col(name).alias("name")).where("trim(name) <> ''").distinct()
    size = known.agg(F.sum(F.char_length("name"))).first()[0] or 0
    shards = max(1, -(-size // max(1, most_chars // 2)))
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int"))
    kind = texts.schema[key].dataType
    out = None
    for shard in range(shards):
        mine = [r["name"] for r in dealt.where(F.col("shard") == shard).select("name").toLocalIterator()]  # most_chars characters, about half of it on average
        if not mine and out is not None:
            continue
        broadcast = spark.sparkContext.broadcast(mine)
        shared = _Shared(broadcast, uuid.uuid4().int)

        def find(batches: Iterator[pa.RecordBatch], shared=shared, empty=not mine) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, found = [], []
                for i, t in enumerate(b.column("said").to_pylist() if not empty else ()):
                    for n in sorted(found_names(t, _automaton(shared))):
                        rows.append(i)
                        found.append(n)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["key", "name"])

        part = texts.select(F.col(key).alias("key"), F.col(text).alias("said")).where("said IS NOT NULL").mapInArrow(find, f"key {kind.simpleString()}, name string")
        out = part if out is None else out.unionByName(part)
    return out.distinct().select(F.col("key").alias(key), F.col("name").alias(name))
