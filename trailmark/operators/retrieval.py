"""Vector and lexical retrieval over e-mail chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schema


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def padded(embedding: Column, dimensions: int = schema.VECTOR_DIMENSIONS) -> Column:
    """Zeros put behind a shorter vector; a longer one is an error."""
    short = F.array_repeat(F.lit(0.0).cast("float"), (F.lit(dimensions) - F.size(embedding)).cast("int"))
    return F.when(F.size(embedding) > dimensions, F.raise_error(F.lit("the embedding has too many dimensions"))).otherwise(F.concat(embedding, short))


def nearest(chunks: DataFrame, vector: list[float], k: int, max_distance: float | None = None) -> DataFrame:
    """The k nearest chunks; a cut-off is applied after the k are chosen, so fewer may be left."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    top = chunks.withColumn("distance", distance(F.col("embedding"), q)).orderBy("distance", "email_id", "chunk_index").limit(k)
    return top if max_distance is None else top.where(F.col("distance") <= max_distance)


def first_mention(chunks: DataFrame, term: str) -> DataFrame:
    """The first chunk of each mail that holds the term, whatever its case."""
    hits = chunks.where(F.lower("content").contains(term.lower()))
    first = F.min(F.struct("chunk_index", "content")).alias("c")
    return hits.groupBy("email_id").agg(first).select("email_id", "c.*")


def mentions(chunks: DataFrame, emails: DataFrame, classes: DataFrame, term: str, category: str | None = None) -> DataFrame:
    """All classified mails that mention the term, newest first."""
    c = classes if category is None else classes.where(F.col("category") == category)
    m = emails.select(F.col("id").alias("email_id"), "subject", "from_addr", "sent_at")
    return first_mention(chunks, term).join(c.select("email_id"), "email_id", "left_semi").join(m, "email_id").orderBy(F.desc("sent_at"), "email_id")


def eligible(emails: DataFrame, classes: DataFrame) -> DataFrame:
    """Mails that may be indexed: job-related, with a retained body that isn't blank (P10)."""
    related = classes.where("is_job_related").select(F.col("email_id").alias("id"))
    return emails.where("body_retention_state = 'retained' AND trim(body_text) <> ''").join(related, "id", "left_semi")


def applications_of_threads(apps: DataFrame, events: DataFrame, emails: DataFrame) -> DataFrame:
    """provider, thread_id and each application of that thread, once."""
    return thread_applications(events, emails).join(apps.withColumnRenamed("id", "application_id"), "application_id")


def thread_applications(events: DataFrame, emails: DataFrame) -> DataFrame:
    """Which applications a thread's mails gave events to."""
    m = emails.where("trim(thread_id) <> ''").select(F.col("id").alias("email_id"), "provider", "thread_id")
    return events.select("email_id", "application_id").join(m, "email_id").select("provider", "thread_id", "application_id").distinct()


def as_of(first_seen: Column, sent: Column) -> list[Column]:
    """The application last seen before the mail; failing that, the first one after it."""
    before = first_seen <= sent
    return [F.when(before, 0).otherwise(1), F.desc(F.when(before, first_seen)), F.asc(F.when(~before, first_seen))]


def companies_mentioning(chunks: DataFrame, emails: DataFrame, events: DataFrame, apps: DataFrame, term: str) -> DataFrame:
    """The newest mail with the term for each company, by events of the mail itself or else by its thread."""
    m = emails.select(F.col("id").alias("email_id"), "provider", "thread_id", "sent_at")
    hits = first_mention(chunks, term).join(m, "email_id").drop("content")
    a = apps.select(F.col("id").alias("application_id"), "company", "first_seen_at", "last_activity_at")
    keep = ["application_id", "company", "email_id", "chunk_index", "sent_at"]
    direct = hits.join(events.select("email_id", "application_id").distinct(), "email_id").join(a, "application_id").select(*keep)
    best = Window.partitionBy("email_id", F.lower(F.trim("company"))).orderBy(*as_of(F.col("first_seen_at"), F.col("sent_at")), F.desc("last_activity_at"), "application_id")
    loose = hits.join(events.where("email_id IS NOT NULL").select("email_id"), "email_id", "left_anti")
    by_thread = loose.join(thread_applications(events, emails), ["provider", "thread_id"]).join(a, "application_id").withColumn("r", F.row_number().over(best)).where("r = 1").select(*keep)
    newest = Window.partitionBy(F.lower(F.trim("company"))).orderBy(F.desc("sent_at"), "chunk_index", "email_id", "application_id")
    return direct.union(by_thread).distinct().withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r").orderBy(F.lower("company"), "company")


def latest_company_email(chunks: DataFrame, emails: DataFrame, events: DataFrame, apps: DataFrame, companies: list[str], own_addresses: list[str]) -> DataFrame:
    """The newest indexed mail of the named companies that wasn't sent by oneself."""
    a = apps.where(F.col("company").isin(*companies)).select(F.col("id").alias("application_id"), "last_activity_at")
    linked = events.join(a.select("application_id"), "application_id", "left_semi")
    by_thread = emails.select(F.col("id").alias("email_id"), "provider", "thread_id").join(thread_applications(linked, emails), ["provider", "thread_id"]).select("email_id", "application_id")
    pairs = linked.where("email_id IS NOT NULL").select("email_id", "application_id").union(by_thread).distinct()
    sender = F.lower(F.trim("from_addr"))
    own = F.lit(False)
    for address in own_addresses:
        own = own | (sender == address.strip().lower()) | sender.endswith(f"<{address.strip().lower()}>")
    kept = emails.where(~F.exists("labels", lambda x: F.upper(F.trim(x)) == "SENT") & ~F.coalesce(own, F.lit(False))).withColumnRenamed("id", "email_id")
    found = kept.join(pairs, "email_id").join(a, "application_id").join(chunks.select("email_id").distinct(), "email_id", "left_semi")
    return found.orderBy(F.desc("sent_at"), F.desc("last_activity_at"), "email_id", "application_id").limit(1).select("email_id", "application_id", "sent_at", "body_text")


def linked_applications(hits: DataFrame, emails: DataFrame, events: DataFrame, apps: DataFrame) -> DataFrame:
    """Applications of each hit: all that its mail gave events to, else the as-of pick in its thread."""
    h = hits.select("email_id").distinct()
    direct = h.join(events.select("email_id", "application_id").distinct(), "email_id")
    m = emails.select(F.col("id").alias("email_id"), "provider", "thread_id", "sent_at")
    a = apps.select(F.col("id").alias("application_id"), "first_seen_at", "last_activity_at")
    best = Window.partitionBy("email_id").orderBy(*as_of(F.col("first_seen_at"), F.col("sent_at")), F.desc("last_activity_at"), "application_id")
    rest = h.join(direct.select("email_id"), "email_id", "left_anti").join(m, "email_id").join(thread_applications(events, emails), ["provider", "thread_id"]).join(a, "application_id")
    return direct.unionByName(rest.withColumn("r", F.row_number().over(best)).where("r = 1").select("email_id", "application_id"))


def content_hash(chunks: DataFrame) -> DataFrame:
    """One SHA-256 for each mail over its chunks in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n")
    return chunks.groupBy("email_id").agg(F.sha2(text, 256).alias("content_hash"))


def reconcile(wanted: DataFrame, state: DataFrame, provider: str, model: str) -> DataFrame:
    """What an index lacks or has too much (V08): delete, embed or keep for each mail; wanted: email_id, content_hash."""
    both = wanted.join(state.select("email_id", F.col("content_hash").alias("had"), "provider", "model"), "email_id", "full")
    same = (F.col("content_hash") == F.col("had")) & (F.col("provider") == provider) & (F.col("model") == model)
    action = F.when(F.col("content_hash").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "keep").otherwise("embed")
    return both.select("email_id", action.alias("action"))
