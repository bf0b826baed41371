"""Ordered lists, latest-row picks and attention lists (T*, W*, L18-L19, L23).

Each "latest per group" is one window rank or max-by over the group's key; each bounded list is a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import schema


def bounded(limit: int) -> int:
    if not 1 <= limit <= schema.LIST_MAXIMUM:
        raise ValueError(f"limit must be 1 to {schema.LIST_MAXIMUM}")
    return limit


def ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def application_list(apps: DataFrame, limit: int = schema.LIST_LIMIT) -> DataFrame:
    return apps.orderBy(F.desc("first_seen_at"), F.lower("company"), F.lower("role_title"), "id").limit(bounded(limit))


def recent_previews(emails: DataFrame, limit: int = schema.LIST_LIMIT, by: str = "sent_at") -> DataFrame:
    """Newest mails, without content: domains only, whether there is a subject and a retained body."""
    domain = lambda c: F.lower(F.regexp_extract(c, r"@([^@\s<>]+?)[>.]*$", 1))
    receivers = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("to_addr", ","), domain), lambda d: d != "")))
    top = emails.orderBy(F.desc(by), F.desc("id")).limit(bounded(limit))
    return top.select(
        "id", "sent_at", F.nullif(domain(F.col("from_addr")), F.lit("")).alias("from_domain"), F.array_join(receivers, ",").alias("to_domains"),
        (F.trim(F.coalesce("subject", F.lit(""))) != "").alias("subject_present"),
        (F.col("body_retention_state").isin("retained", "debugging") & F.col("body_text").isNotNull()).alias("has_retained_body"),
    )


def page(emails: DataFrame, start: str, end: str, number: int, size: int) -> DataFrame:
    """One page of a half-open window of mails, newest first, with the number of pages."""
    kept = emails.where((F.col("sent_at") >= ts(start)) & (F.col("sent_at") < ts(end)))
    pages = kept.agg(F.ceil(F.count("*") / size).cast("long").alias("total_pages"))
    return kept.orderBy(F.desc("sent_at"), F.desc("id")).offset((number - 1) * size).limit(size).select("id", "sent_at").join(F.broadcast(pages))  # one row is broadcast


def recent_events(events: DataFrame, apps: DataFrame, limit: int = schema.LIST_LIMIT) -> DataFrame:
    """The newest events with their application: the top-k is taken before the join."""
    top = events.orderBy(F.desc("event_at"), F.desc("id")).limit(bounded(limit))
    a = apps.select(F.col("id").alias("application_id"), "company", "role_title")
    named = a.join(F.broadcast(top.select("id", "application_id", "event_type", "event_at")), "application_id")  # LIST_MAXIMUM rows are broadcast
    return named.orderBy(F.desc("event_at"), F.desc("id"))


def timeline(events: DataFrame, emails: DataFrame, classes: DataFrame, application_id: str) -> DataFrame:
    """One application's events by the raw four-part key, nulls first."""
    m, c = emails.select(F.col("id").alias("email_id"), "sent_at"), classes.select("email_id", "classified_at")
    own = events.where(F.col("application_id") == application_id).join(m, "email_id", "left").join(c, "email_id", "left")
    return own.orderBy(*[F.asc_nulls_first(x) for x in ("event_at", "sent_at", "classified_at", "id")]).select("id", "event_type", "event_at", "sent_at", "classified_at")


def candidates_to_classify(emails: DataFrame, classes: DataFrame, model: str, prompt_version: str, limit: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Retained, non-blank mails without a classification by this model and prompt; oldest first."""
    done = classes.where((F.col("model") == model) & (F.col("prompt_version") == prompt_version)).select(F.col("email_id").alias("id"))
    kept = emails.where("body_retention_state = 'retained' AND trim(body_text) <> ''").join(done, "id", "left_anti")
    if exclude is not None:
        kept = kept.join(exclude.select("id"), "id", "left_anti")
    ordered = kept.orderBy("sent_at", "id")
    return ordered if limit is None else ordered.limit(limit)


def latest_event(events: DataFrame) -> DataFrame:
    """The newest event of each application by (event_at, id)."""
    best = F.max(F.struct("event_at", "id", "event_type", "email_id")).alias("e")
    return events.groupBy("application_id").agg(best).select("application_id", "e.*")


def follow_up_states(events: DataFrame, emails: DataFrame, now: str) -> DataFrame:
    """The newest event's direction, and whether an interview is to come."""
    last = latest_event(events)
    sent = emails.select(F.col("id").alias("email_id"), F.exists("labels", lambda x: F.upper(F.trim(x)) == "SENT").alias("outbound"))
    coming = events.groupBy("application_id").agg(F.max((F.col("event_type") == "interview_scheduled") & (F.col("event_at") > ts(now))).alias("has_future_interview"))
    way = F.when(F.col("email_id").isNull(), "unknown").when(F.col("outbound"), "outbound").otherwise("inbound").alias("latest_direction")
    return last.join(sent, "email_id", "left").join(coming, "application_id").select("application_id", F.col("event_at").alias("latest_event_at"), F.col("event_type").alias("latest_event_type"), way, "has_future_interview")


def live_applications(apps: DataFrame, states: DataFrame, now: str, follow_up_days: int = schema.FOLLOW_UP_DAYS) -> DataFrame:
    """Waiting applications without an interview to come: days waited, and whether a follow-up is due."""
    s = states.withColumnRenamed("application_id", "id")
    kept = apps.where(F.col("current_status").isin("applied", "in_review", "interview")).join(s, "id", "left").where(~F.coalesce("has_future_interview", F.lit(False)))
    since = F.coalesce("latest_event_at", "last_activity_at")
    days = F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", since, ts(now)) / 86400)).cast("long")
    due = (days >= follow_up_days) & (F.coalesce("latest_direction", F.lit("unknown")) != "inbound")
    return kept.select("id", "company", "current_status", days.alias("days_waiting"), due.alias("follow_up_due"))


def latest_interviews(apps: DataFrame, events: DataFrame, completions: DataFrame) -> DataFrame:
    """The newest interview of each company (W04), with its task's completion."""
    e = events.where("event_type = 'interview_scheduled'").select(F.col("id").alias("interview_event_id"), F.col("application_id").alias("id"), F.col("event_at").alias("interview_at"))
    joined = apps.where("trim(company) <> ''").join(e, "id").join(completions, "interview_event_id", "left")
    best = Window.partitionBy(F.lower(F.trim("company"))).orderBy(F.desc("interview_at"), F.desc("interview_event_id"), F.desc("id"))
    return joined.withColumn("company_rank", F.row_number().over(best)).where("company_rank = 1").drop("company_rank")


def attention(latest: DataFrame, events: DataFrame, active_after: str, follow_up_before: str) -> dict[str, DataFrame]:
    """Interviews to prepare, all interviewed companies, and interviews to follow up (no later news)."""
    name = F.collate("company", "UTF8_LCASE")
    recent = latest.where((F.col("current_status") == "interview") & (F.col("interview_at") >= ts(active_after)))
    later = events.where(F.col("event_type").isin(*schema.RESPONSE_EVENTS)).groupBy("application_id").agg(F.max("event_at").alias("news_at")).withColumnRenamed("application_id", "id")
    open_ = recent.where(F.col("completed_at").isNotNull() & (F.col("interview_at") <= ts(follow_up_before))).join(later, "id", "left").where("news_at IS NULL OR news_at <= interview_at")
    return {
        "interviewed": latest.orderBy(F.desc("interview_at"), name),
        "prepare": recent.where("completed_at IS NULL").orderBy("interview_at", name),
        "follow_up": open_.drop("news_at").orderBy("interview_at", name),
    }


def latest_messages(chat: DataFrame, conversation_id: str, limit: int) -> DataFrame:
    """The last messages of a conversation, in order."""
    return chat.where(F.col("conversation_id") == conversation_id).orderBy(F.desc("turn")).limit(limit).orderBy("turn")


def derive_status(events: DataFrame, emails: DataFrame, classes: DataFrame) -> DataFrame:
    """Each application's status, folded over its events in order (W08, L11): two aggregates, whatever the number of its events."""
    from trailmark.operators.attempts import STATUS_OF_EVENT, folded_status, later
    from trailmark.operators.features import ordered_events
    from trailmark.sources.shared import dealt, parts_of

    status = F.create_map(*[F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair])
    to = F.when(F.col("event_type") == "feedback", F.col("extracted_status")).otherwise(F.try_element_at(status, F.col("event_type")))
    setting, response = folded_status(["event_at", "email_sent_at", "classified_at", "id"], "event_type", to)
    told = dealt(ordered_events(events, emails, classes), parts_of(events), "application_id")
    folded = told.groupBy("application_id").agg(setting.alias("setting"), response.alias("replied"))
    return folded.select("application_id", later("setting", "replied").alias("status"))
