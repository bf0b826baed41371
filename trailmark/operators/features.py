"""One row of facts for each application: metrics and diagnostics are single aggregates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.operators.filters import is_general, is_lifecycle
from trailmark.sources.shared import dealt, parts_of


def event_key() -> Column:
    """The canonical order of events: event time, mail time, classification time, id."""
    return F.struct("event_at", "email_sent_at", "classified_at", "id")


def ordered_events(events: DataFrame, emails: DataFrame, classes: DataFrame, *more: str | Column) -> DataFrame:
    """Events with their mail's and classification's times, each falling back to the one before, and ``more`` of the classification.

    Events without a mail are dealt out by their ids, to no task alone, and all into so many parts that none grows with the tables."""
    parts = parts_of(events)
    m = emails.select(F.col("id").alias("mail"), "sent_at")
    c = classes.select(F.col("email_id").alias("told"), F.col("classified_at").alias("c_at"), *more)
    sent = F.coalesce("sent_at", "event_at")
    of = lambda key: (F.col("met") == F.col(key)) & F.col("email_id").isNotNull()
    spread = dealt(events.withColumn("met", F.coalesce("email_id", F.concat(F.lit("none of "), "id"))), parts, "met")
    met = spread.join(dealt(m, parts, "mail"), of("mail"), "left").join(dealt(c, parts, "told"), of("told"), "left")
    return met.withColumn("email_sent_at", sent).withColumn("classified_at", F.coalesce("c_at", sent)).drop("sent_at", "c_at", "met", "mail", "told")


def features(apps: DataFrame, events: DataFrame, emails: DataFrame, classes: DataFrame) -> DataFrame:
    """apps with flags and keys from their events: one join and one aggregate, both on the application's id."""
    return _with_facts(apps, ordered_events(events, emails, classes), [])


def submitted_features(apps: DataFrame, events: DataFrame, emails: DataFrame, classes: DataFrame) -> DataFrame:
    """``features`` of ``filters.submitted``: events meet mails and classifications once, and applications once, for both."""
    told = ordered_events(events, emails, classes, "is_job_related", "category", F.lit(True).alias("is_classified"))
    told = told.withColumns({"is_general": F.coalesce(is_general(), F.lit(False)), "is_lifecycle": F.coalesce(is_lifecycle("is_classified"), F.lit(False))})
    flags = [F.max("is_general").alias("is_general"), F.max("is_lifecycle").alias("is_lifecycle")]
    out = _with_facts(apps, told.drop("is_job_related", "category", "is_classified"), flags)
    return out.where(~F.coalesce(F.col("is_general") & ~F.col("is_lifecycle"), F.lit(False))).drop("is_general", "is_lifecycle")


def _with_facts(apps: DataFrame, told: DataFrame, more: list[Column]) -> DataFrame:
    """apps with the facts of their events; told: of ordered_events."""
    kind = F.col("event_type")
    of = lambda *t: kind.isin(*t)
    responded, key = of(*schema.RESPONSE_EVENTS), event_key()
    after = F.col("event_at") >= F.col("first_seen_at")
    wide = told.join(apps.select(F.col("id").alias("application_id"), "first_seen_at"), "application_id")
    flag = lambda c, n: F.max(c).alias(n)
    facts = wide.groupBy("application_id").agg(
        flag(responded, "has_response"),
        flag(of("interview_scheduled"), "has_interview"),
        flag(of("offer"), "has_offer"),
        flag(of("rejection"), "has_rejection"),
        flag(of(*schema.SUCCESS_EVENTS), "has_success"),
        F.sum(of("interview_scheduled").cast("long")).alias("interviews"),
        F.min(F.when(responded & after, F.col("event_at"))).alias("first_response_at"),
        F.min(F.when(of("rejection") & after, F.col("event_at"))).alias("first_rejection_at"),
        F.max(F.when(of("applied"), key)).alias("latest_applied"),
        F.max(F.when(responded, key)).alias("latest_response"),
        F.max(F.when(kind != "ghost_inferred", key)).alias("latest_non_ghost"),
        F.min(F.when(of("interview_scheduled"), key)).alias("first_interview"),
        F.max(F.when(of("offer"), key)).alias("latest_offer"),
        *more,
    )
    none = F.lit(False)
    flags = ["has_response", "has_interview", "has_offer", "has_rejection", "has_success"]
    return (
        apps.join(facts.withColumnRenamed("application_id", "id"), "id", "left")
        .withColumns({f: F.coalesce(f, none) for f in flags})
        .withColumn("interviews", F.coalesce("interviews", F.lit(0)))
        .withColumn("answered", F.coalesce(F.col("latest_response") > F.col("latest_applied"), none))
        .withColumn("offer_after_interview", F.coalesce(F.col("latest_offer") > F.col("first_interview"), none))
    )
