"""Cleaning a corpus: language, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import language_id, order_minhash, packing, pii, tiling
from trailmark.llm.common import pick, table, written
from trailmark.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Files whose list is broadcast, some 10 MB.
MOST_FILES = 1 << 16


def is_scan(docs: DataFrame) -> bool:
    """Is docs just a table of files, so that each row has a place in a file that is its own?"""
    plan = getattr(docs, "_jdf", None) and docs._jdf.queryExecution().analyzed()
    return bool(plan) and plan.getClass().getSimpleName() == "LogicalRelation"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row that is the same whenever it is read: doc_ids may be null or repeated, and decisions are on rows.

    Rows of a table of files are numbered by file and place in it, if the files are ``MOST_FILES`` at most (their list is broadcast).  Rows
    of more files, or of a DataFrame that is more than a table, are written with their numbers once."""
    if is_scan(docs):
        placed = docs.select(*[F.col(f"`{c}`") for c in COLUMNS], F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        files = [r["file"] for r in placed.select("file").distinct().limit(MOST_FILES + 1).collect()]
        if len(files) <= MOST_FILES:
            of_file = docs.sparkSession.createDataFrame(list(enumerate(sorted(files))), "number long, file string")
            return placed.join(F.broadcast(of_file), "file").select(*COLUMNS, (F.shiftleft("number", 44) + F.col("place")).alias("doc_row"))
    return written(pick(docs, *COLUMNS).withColumn("doc_row", F.monotonically_increasing_id()), "numbered")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of numbered docs but those in gone (doc_row).  As gone is written, Spark knows its size, and broadcasts it instead of
    shuffling texts while it is small (spark.sql.autoBroadcastJoinThreshold); beyond that both sides are shuffled."""
    return docs.join(written(gone.select("doc_row"), "gone"), "doc_row", "left_anti").select(*COLUMNS)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null or letterless texts, and those of no clear language (below 0.5)."""
    docs = pick(docs, *COLUMNS)
    return language_id.predict(docs, *language_id.train(docs)).where("lang_pred <> 'und' AND score >= 0.5").select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each class of near-duplicates, one row: that of least doc_id, or any where all are null.  Null texts are no copies."""
    docs = numbered(docs)
    classes = order_minhash.near_duplicates(docs.select(F.col("doc_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("doc_row"), "class_id")
    placed = written(classes.join(docs.select("doc_row", "doc_id"), "doc_row"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_row"))
    kept = placed.groupBy("class_id").agg(first.alias("m")).select(F.col("m.doc_row").alias("doc_row"))
    return without(docs, placed.join(kept, "doc_row", "left_anti"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    docs = numbered(docs)
    leaks = tiling.find_leaks(docs.select(F.col("doc_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.select(F.col("doc_id").alias("doc_row")).distinct())


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by the kind's name."""
    return pii.redacted(pick(docs, *COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token ids into sequences of 1024."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontaminate", decontaminated),
    ("pii", redacted),
    ("packing", packed),
]

#: Trained models, alignments and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
