"""Ingestion as Structured Streaming: a paged, resumable source of mail metadata and bucketed snapshot sinks (S05-S06, streaming concepts).

Pages are files in a folder, or what a mail provider hands out (mailbox.py).  The checkpoint is the cursor: it moves only when a
micro-batch is written, so a restart takes up after the last whole page, and a batch that is replayed writes the same version of the
table again (tables.py).  Rows of any age are taken: repeats are told by their ids against the table, not by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.streaming.tables import Sink, current, into_buckets, query_id  # noqa: F401  (current and into_buckets are used from here)

PAGE = "id string, provider string, thread_id string, from_addr string, to_addr string, subject string, sent_at timestamp_ntz, received_at timestamp_ntz, labels array<string>"


def pages(spark: SparkSession, folder: str, schema: str = PAGE, pages_per_batch: int = 1, bytes_per_batch: str | None = None) -> DataFrame:
    """New page files in the order of their modification times, ``pages_per_batch`` at a time, or as many as have ``bytes_per_batch``."""
    source = spark.readStream.schema(schema)
    limit = ("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else ("maxFilesPerTrigger", str(pages_per_batch))
    return source.option(*limit).json(folder)


def first_added(batch: DataFrame, known: DataFrame | None = None, order: tuple[str, ...] = ("received_at", "sent_at")) -> DataFrame:
    """Incremental history: of messages added twice the first counts, and none that the table has already (S06), however old it is."""
    w = Window.partitionBy("id").orderBy(*[F.asc_nulls_last(c) for c in order if c in batch.columns])
    new = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return new if known is None else new.join(known.select("id"), "id", "left_anti").select(*batch.columns)


def metadata_rows(page: DataFrame) -> DataFrame:
    """Page rows as mails without bodies."""
    plain = page.withColumn("sent_at", F.coalesce("sent_at", "received_at")).drop("received_at")
    return plain.withColumn("body_text", F.lit(None).cast("string")).withColumn("body_retention_state", F.lit("metadata_only"))


class DeadLetters:
    """A sink that puts rows which aren't sound into a side table, one folder a checkpoint and batch, and hands the others on."""

    def __init__(self, sink: Sink, sound: Column, folder: str, checkpoint: str | None = None):
        self.sink, self.sound, self.folder, self.checkpoint = sink, sound, folder, checkpoint

    def of(self, checkpoint: str) -> DeadLetters:
        return DeadLetters(bound(self.sink, checkpoint), self.sound, self.folder, checkpoint)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        good = F.coalesce(self.sound, F.lit(False))
        source = query_id(batch.sparkSession, self.checkpoint) if self.checkpoint else "none"
        batch.where(~good).write.mode("overwrite").parquet(f"{self.folder}/source={source}/batch={batch_id}")
        self.sink(batch.where(good), batch_id)


def with_dead_letters(sink: Sink, sound: Column, folder: str) -> DeadLetters:
    return DeadLetters(sink, sound, folder)


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


#: What sources call the fault that a position is no longer there.
EXPIRED = ("OffsetExpired", "OffsetOutOfRangeException", "OFFSETS_OUT_OF_RANGE")


def has_expired(fault: StreamingQueryException) -> bool:
    return any(name in str(fault) for name in EXPIRED)


def resume_or_reload(resume: Callable[[], StreamingQuery], reload: Callable[[], StreamingQuery], expired: Callable[[StreamingQueryException], bool] = has_expired) -> StreamingQuery:
    """Takes a stream up from its checkpoint; where the source no longer has what that names (an expired offset), loads all again.

    Any other fault, of the sink for one, is raised."""
    try:
        return resume()
    except StreamingQueryException as fault:
        if not expired(fault):
            raise
        return reload()


def bound(sink: Sink, checkpoint: str) -> Sink:
    """The sink as it writes for this checkpoint, if that matters to it."""
    return sink.of(checkpoint) if hasattr(sink, "of") else sink


def run_available(stream: DataFrame, sink: Sink, checkpoint: str) -> StreamingQuery:
    """Everything there is now, then stop: what a scheduler calls again and again."""
    query = stream.writeStream.foreachBatch(bound(sink, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_until_idle(stream: DataFrame, sink: Sink, checkpoint: str) -> StreamingQuery:
    """Batch after batch until the source has nothing new, then stop: for sources that tell their next position one page at a time."""
    query = stream.writeStream.foreachBatch(bound(sink, checkpoint)).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def run_every(stream: DataFrame, sink: Sink, checkpoint: str, seconds: int = 900) -> StreamingQuery:
    return stream.writeStream.foreachBatch(bound(sink, checkpoint)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def activity(stream: DataFrame, window: str = "1 day", lateness: str = "3 days", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Event counts by tumbling window and type; rows later than the watermark are left out."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return timed.groupBy(F.window(at, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), kind, "n")


def late_threads(batch: DataFrame, decisions: DataFrame, emails: DataFrame) -> DataFrame:
    """Rejected mails that count after all, as a later mail of their thread is a candidate: id (late data)."""
    passed = decisions.where("outcome = 'candidate'").select("id").join(batch.select("id"), "id", "left_semi")
    threads = emails.select("id", "provider", "thread_id").join(passed, "id", "left_semi").where("thread_id IS NOT NULL").select("provider", "thread_id").distinct()
    rejected = emails.join(decisions.where("outcome = 'rejected'").select("id"), "id", "left_semi")
    return rejected.join(threads, ["provider", "thread_id"], "left_semi").select("id")
