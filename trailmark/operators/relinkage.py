"""Later batches of extractions against the applications that are there.

A batch may repeat mails, tell the same mails anew (reclassified) or add mails to known applications.  Mails that an application owns
stay with its attempt; stale automatic events go; applications locked or edited by hand are left alone, and what a batch would have
changed there is reported as a conflict.  Everything here is a join or an aggregate by a key of the batch; only the attempts
themselves are folded in order (see ``linkage.attempts``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import normalized_company, normalized_role, ordinal_bucket
from trailmark.operators import linkage, lists, snapshots
from trailmark.sources.shared import cut

_EVENT = ("id", "application_id", "email_id", "event_type", "event_at", "extracted_status")


@dataclass(frozen=True)
class Relinked:
    """The next tables; outcome of each proposed application; conflict_key, conflict_type, application_id, evidence_email_id."""

    applications: DataFrame
    events: DataFrame
    outcomes: DataFrame
    conflicts: DataFrame


def application_threads(events: DataFrame, emails: DataFrame) -> DataFrame:
    """application_id, thread of the threads whose mails gave it events."""
    mails = emails.where("trim(thread_id) <> ''").select(F.col("id").alias("email_id"), F.trim("thread_id").alias("thread"))
    return events.where("email_id IS NOT NULL").select("application_id", "email_id").join(mails, "email_id").select("application_id", "thread").distinct()


def known_identities(apps: DataFrame, threads: DataFrame) -> DataFrame:
    """What ``linkage.inherit_identity`` takes of known applications: thread_id, company, role_title, at."""
    a = apps.select(F.col("id").alias("application_id"), "company", "role_title", F.col("first_seen_at").alias("at"))
    return a.join(threads, "application_id").select(F.col("thread").alias("thread_id"), "company", "role_title", "at")


def existing_attempts(apps: DataFrame, events: DataFrame, threads: DataFrame) -> DataFrame:
    """Known applications as attempts of their keys: by each thread of theirs, and by the bucket that they were first seen in."""
    named = apps.select(
        F.col("id").alias("application_id"), F.nullif(normalized_company("company"), F.lit("")).alias("company_key"), normalized_role("role_title").alias("role_key"),
        F.col("current_status").alias("status"), F.col("first_seen_at").alias("first_at"), F.col("last_activity_at").alias("last_at"),
    )
    by_thread = named.join(threads, "application_id").withColumn("bucket", F.lit(None).cast("date"))
    by_bucket = named.withColumn("thread", F.lit(None).cast("string")).withColumn("bucket", ordinal_bucket(F.to_date("first_at")))
    mails = events.where("email_id IS NOT NULL").groupBy("application_id").agg(F.collect_set("email_id").alias("email_ids"))
    both = by_thread.unionByName(by_bucket).join(mails, "application_id", "left").withColumn("email_ids", F.coalesce("email_ids", F.array().cast("array<string>")))
    first = both.withColumn("attempt_started_at", F.lit(None).cast("timestamp_ntz")).withColumn("base_id", linkage.application_id())
    started = F.when(F.col("base_id") != F.col("application_id"), F.col("first_at"))
    return first.withColumn("attempt_started_at", started).select(*linkage.GROUP, "attempt_started_at", "status", "first_at", "last_at", "email_ids")


def stale_events(events: DataFrame, batch: DataFrame, apps: DataFrame, corrections: DataFrame) -> DataFrame:
    """What becomes of the events of mails that are told anew (L10): id, application_id, email_id, action.

    batch: email_id, and event_id and application_id of its proposal, null where the mail gives no event now.  An event that is
    proposed again isn't stale.  Under a locked application a stale event stays, as a conflict where its mail now belongs elsewhere;
    events edited by hand are conflicts; others are deleted.
    """
    new = batch.select("email_id", F.col("event_id").alias("proposed"), F.col("application_id").alias("proposed_application"))
    locks = apps.where("manual_lock").select(F.col("id").alias("application_id"), F.lit(True).alias("locked"))
    guard = snapshots.protected_events(corrections)
    by_id = guard.select(F.col("event_id").alias("id"), F.lit(True).alias("edited")).where("id IS NOT NULL").distinct()
    by_mail = guard.select("email_id", F.lit(True).alias("mail_edited")).where("email_id IS NOT NULL").distinct()
    stale = events.select("id", "application_id", "email_id").join(new, "email_id").where(~F.col("id").eqNullSafe(F.col("proposed")))
    wide = stale.join(locks, "application_id", "left").join(by_id, "id", "left").join(by_mail, "email_id", "left")
    same = F.coalesce(F.col("proposed_application") == F.col("application_id"), F.lit(False))
    action = F.when(F.col("locked") & same, "keep").when(F.coalesce("locked", "edited", "mail_edited", F.lit(False)), "manual_conflict").otherwise("delete")
    return wide.select("id", "application_id", "email_id", action.alias("action"))


def _events_of(x: DataFrame) -> DataFrame:
    """Proposed mails as events."""
    return x.select(F.col("event_id").alias("id"), "application_id", "email_id", F.col("event").alias("event_type"), F.col("at").alias("event_at"), F.col("status").alias("extracted_status"))


def summaries(events: DataFrame, emails: DataFrame, classes: DataFrame) -> DataFrame:
    """id, bounds and folded status of each application that has events."""
    bounds = events.groupBy("application_id").agg(F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at"))
    return bounds.join(lists.derive_status(events, emails, classes), "application_id").withColumnRenamed("application_id", "id")


def proposed_applications(x: DataFrame, apps: DataFrame, events: DataFrame, emails: DataFrame, classes: DataFrame) -> DataFrame:
    """What the batch makes of each application (L08): known fields stay, bounds widen, new skills come after known ones."""
    rolled = linkage.roll_up(x.drop("event_id"), ("application_id",)).withColumnRenamed("application_id", "id")
    mine = _events_of(x)
    touched = mine.select("application_id").distinct()
    all_events = snapshots.replaced(events.select(*_EVENT).join(touched, "application_id", "left_semi").select(*_EVENT), mine.dropDuplicates(["id"]), ["id"])
    old = apps.select("id", F.struct(*apps.columns).alias("o"))
    wide = rolled.select("id", F.struct(*rolled.columns).alias("n")).join(old, "id", "left").join(summaries(all_events, emails, classes), "id")
    has = lambda c: c in rolled.columns
    other_than = lambda c, nothing: F.when(F.coalesce(F.col(f"o.{c}"), F.lit(nothing)) == nothing, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    made = {
        "first_seen_at": F.col("first_at"), "last_activity_at": F.col("last_at"), "created_at": F.col("first_at"), "current_status": F.col("status"), "manual_lock": F.lit(False),
        "salary_min": F.least("o.salary_min", "n.salary_min"), "salary_max": F.greatest("o.salary_max", "n.salary_max"),
        "sponsorship": other_than("sponsorship", "unknown"), "source": other_than("source", "other"), "company": F.col("n.company"), "role_title": F.col("n.role_title"), "id": F.col("id"),
        "tech_stack": F.array_union(F.coalesce("o.tech_stack", F.array().cast("array<string>")), "n.tech_stack") if "tech_stack" in apps.columns else None,
    }
    known = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if has(c) else F.col(f"o.{c}")
    return wide.select(*[(made[c] if c in made else known(c)).alias(c) for c in apps.columns])


def refreshed(apps: DataFrame, events: DataFrame, emails: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """Applications that lost events: deleted without any left, else with bounds and status of what is left; locked ones stay."""
    mine = apps.join(ids.select("id").distinct(), "id", "left_semi").where("NOT manual_lock")
    facts = summaries(events.select(*_EVENT).join(mine.select(F.col("id").alias("application_id")), "application_id", "left_semi"), emails, classes)
    new = {"first_seen_at": F.col("first_at"), "last_activity_at": F.col("last_at"), "current_status": F.col("status")}
    fresh = mine.join(facts, "id").select(*[(new.get(c, F.col(c))).alias(c) for c in apps.columns])
    return apps.join(mine.select("id"), "id", "left_anti").select(*apps.columns).unionByName(fresh)


def relink(x: DataFrame, told: DataFrame, apps: DataFrame, events: DataFrame, emails: DataFrame, classes: DataFrame, corrections: DataFrame) -> Relinked:
    """A batch of extractions x over the tables that are there; told: email_id of all mails of the batch, also unrelated ones.

    apps and events have the columns of the application and event tables; corrections: correction_type, before_json, after_json.
    """
    threads = cut(application_threads(events, emails), "threads")
    proposed = cut(linkage.proposals(x, known_identities(apps, threads), threads.select(F.col("thread").alias("thread_id")), existing_attempts(apps, events, threads)), "proposed")
    batch = told.select("email_id").distinct().join(proposed.select("email_id", "event_id", "application_id"), "email_id", "left")
    judged = cut(stale_events(events, batch, apps, corrections), "stale")
    blocked = judged.where("action = 'manual_conflict'")
    left = events.join(judged.where("action = 'delete'").select("id"), "id", "left_anti").select(*events.columns)
    kept = proposed.join(blocked.select("email_id"), "email_id", "left_anti").select(*proposed.columns)
    wanted = cut(proposed_applications(kept, apps, left, emails, classes), "wanted")
    next_apps, outcomes = (cut(df, "upserted") for df in snapshots.upsert_applications(apps, wanted, snapshots.merge_tombstones(corrections)))
    taken = outcomes.where("outcome IN ('upserted', 'locked_unchanged')").select(F.col("id").alias("application_id"))
    new_events = _events_of(kept).dropDuplicates(["id"]).join(taken, "application_id", "left_semi")
    filled = new_events.select(*[F.col(c) if c in new_events.columns else F.lit(None).cast(k).alias(c) for c, k in events.dtypes])
    next_events, judged_events = (cut(df, "upserted") for df in snapshots.upsert_events(left, filled, corrections))
    lost = judged.where("action = 'delete'").select(F.col("application_id").alias("id")).join(kept.select(F.col("application_id").alias("id")), "id", "left_anti")
    key = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *parts)
    of_stale = blocked.select(key("application_event", "application_id", "email_id").alias("conflict_key"), F.lit("application_event").alias("conflict_type"), "application_id", F.col("email_id").alias("evidence_email_id"))
    mails = kept.groupBy("application_id").agg(F.array_join(F.array_sort(F.collect_set("email_id")), ",").alias("mails"), F.min_by("email_id", "seq").alias("evidence_email_id"))
    of_apps = outcomes.where("outcome = 'manual_conflict'").withColumnRenamed("id", "application_id").join(mails, "application_id")
    of_apps = of_apps.select(key("application_summary", "application_id", "mails").alias("conflict_key"), F.lit("application_summary").alias("conflict_type"), "application_id", "evidence_email_id")
    of_events = new_events.join(judged_events.where("outcome = 'manual_conflict'").select("id"), "id", "left_semi")
    of_events = of_events.select(key("application_event", "application_id", F.coalesce("email_id", "id")).alias("conflict_key"), F.lit("application_event").alias("conflict_type"), "application_id", F.col("email_id").alias("evidence_email_id"))
    return Relinked(refreshed(next_apps, next_events, emails, classes, lost), next_events, outcomes, of_stale.unionByName(of_apps).unionByName(of_events).dropDuplicates(["conflict_key"]))
