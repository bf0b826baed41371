"""Groups of spelling variants: words that one inserted, deleted or replaced character makes of each other.

Even-partition pigeonhole join.  A word of l characters is cut into two segments, of l // 2 characters and the rest.  One edit leaves one of
them whole: if two words of l characters are near, they share a segment in place; if a word of l + 1 characters is near one of l, it has
the first segment at its start, or the second one moved by one place, at its end.  So each word is indexed by its two segments
and probes with its own segments (equal length) and with two substrings for the length below its own.

Candidates share a segment.  Where more than ``crowd`` words do, they aren't compared: as they agree in that segment, they
differ in the other one, which is cut in two again and must agree in one of its halves, and so on.  Segments of one character end
this: as many words as there are characters.  So no group of candidates grows with the table, and no link is lost.
Candidates are verified by an edit distance of exactly one, and pairs that were found by both segments are taken once.

Null texts have no words; an empty table gives no rows; repeated rows count again; a null doc_id is written as an empty string.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, release, written

#: Distinct words that a task holds before it hands its counts on, and characters from which a text's words aren't listed at once.
HELD = 1 << 18
LONG = 1 << 20


def _spelt(doc_id: int | None, run: str, every: int) -> str:
    """The run, lower-cased; of one in ``every`` (by checksum with its document) one character is left out."""
    run = run.encode().lower().decode()  # of bytes, only A-Z
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted_words(docs: DataFrame, least_length: int = 5, least_times: int = 3, every: int = 97) -> DataFrame:
    """word, n: the words of at least ``least_length`` characters that stand ``least_times`` times or more in all texts."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")  # what is shorter makes no word

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                text = text.as_py()
                own = Counter(runs.findall(text) if len(text) < LONG else (m.group() for m in runs.finditer(text)))
                doc_id = doc_id.as_py()
                for run, n in own.items():
                    word = _spelt(doc_id, run, every)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield handed_on()
                    held.clear()
        yield handed_on()
        release()

    counts = pick(docs, "doc_id", "text").where("text IS NOT NULL").mapInArrow(make, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def _halves(rows: DataFrame) -> DataFrame:
    """rows: word, n, longer, at, size: a word whose characters agree with a neighbour's but for ``size`` (one more if it is the longer
    one) from ``at`` on.  Each half of these may be the one that agrees, too; ``key`` tells what then agrees."""
    first = F.expr("size div 2")
    left = F.struct((F.col("at") + first).alias("at"), (F.col("size") - first).alias("size"))  # the first half agrees
    right = F.struct(F.col("at").alias("at"), first.alias("size"))
    cut = rows.select("word", "n", "longer", F.explode(F.array(left, right)).alias("h")).select("word", "n", "longer", "h.*")
    extra = F.col("longer").cast("int")
    before = F.substring("word", F.lit(1), F.col("at"))
    after = F.expr("substring(word, at + size + 1 + CAST(longer AS INT))")
    return cut.withColumn("key", F.xxhash64(F.char_length("word") - extra, "at", "size", before, after))


def _candidates(rows: DataFrame) -> DataFrame:
    """word, n, near, near_n of words with one key, each pair once for the key; verified."""
    indexed = rows.where("NOT longer").select("key", "word", "n")
    probes = rows.select("key", "longer", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = indexed.join(probes, "key").where(F.col("longer") | (F.col("word") < F.col("near")))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def near_words(words: DataFrame, crowd: int = 256) -> DataFrame:
    """word, n, near, near_n: each pair of words that differ by one edit, in both directions.  words: word, n, each word once."""
    own = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    length: Column = F.char_length("word") - F.col("longer").cast("int")
    rows = own.select("word", "n", "longer", F.lit(0).alias("at"), length.cast("int").alias("size")).where("size > 0")
    found = []
    while rows is not None:
        cut = _halves(rows)
        crowded = cut.where("size > 1").groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > crowd).select("key")
        crowded = written(crowded, "crowded")
        many = not crowded.isEmpty()
        few = cut.join(crowded, "key", "left_anti") if many else cut
        found.append(written(_candidates(few), "near"))
        rows = written(cut.join(crowded, "key", "left_semi").drop("key"), "crowds") if many else None
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.distinct().select(F.explode(both).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows of forms (word, form): forms are followed to the last.  As counts double at least from word to
    form, chains end; each round doubles the steps that are followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_groups(docs: DataFrame, least_length: int = 5, least_times: int = 3, every: int = 97, crowd: int = 256) -> DataFrame:
    """word, form, root, n, n_near, form_n for every counted word.

    form is the near word of largest n (ties: the smallest word), if that n is twice the word's at least; root follows forms to the last."""
    words = written(counted_words(docs, least_length, least_times, every), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, crowd).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = F.col("best.less") <= -2 * F.col("n")
    near = written(near.select("word", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")), "chosen")
    roots = _roots(near.where("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
