"""Manual corrections: merges, splits, edits, lock resets (L14-L17), on whole tables of such requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The status a merged application takes: the first of these that either had (fixed values).
STATUS_PRIORITY = ("offer", "rejected", "withdrawn", "interview", "assessment", "in_review", "ghosted", "applied")


def stronger_status(a: Column, b: Column) -> Column:
    order = F.array(*[F.lit(s) for s in STATUS_PRIORITY])
    return F.when(F.array_position(order, a) <= F.array_position(order, b), a).otherwise(b)


def merged(apps: DataFrame, pairs: DataFrame) -> DataFrame:
    """apps after merging each pair (target, source): bounds widen, the target's fields come first, the target is locked, sources go."""
    a = apps.select(F.col("id").alias("target"), F.struct(*apps.columns).alias("t"))
    b = apps.select(F.col("id").alias("source_id"), F.struct(*apps.columns).alias("s"))
    both = pairs.where("target <> source").select("target", F.col("source").alias("source_id")).join(a, "target").join(b, "source_id")
    least, most = (lambda c: F.least(f"t.{c}", f"s.{c}")), (lambda c: F.greatest(f"t.{c}", f"s.{c}"))
    special = {
        "first_seen_at": least("first_seen_at"),
        "last_activity_at": most("last_activity_at"),
        "salary_min": least("salary_min"),
        "salary_max": most("salary_max"),
        "current_status": stronger_status(F.col("t.current_status"), F.col("s.current_status")),
        "sponsorship": F.when(F.col("t.sponsorship") == "unknown", F.col("s.sponsorship")).otherwise(F.col("t.sponsorship")),
        "manual_lock": F.lit(True),
        "id": F.col("t.id"),
        "created_at": F.col("t.created_at"),
    }
    one = both.select(*[special.get(c, F.coalesce(f"t.{c}", f"s.{c}")).alias(c) for c in apps.columns])
    gone = pairs.select(F.explode(F.array("target", "source")).alias("id")).distinct()
    return apps.join(gone, "id", "left_anti").select(*apps.columns).unionByName(one)


def merge_records(pairs: DataFrame, at: str) -> DataFrame:
    """The correction row of each merge; its after_json is the tombstone that keeps the source from coming back."""
    gone = F.to_json(F.struct(F.col("source").alias("deleted_source_application_id")))
    return pairs.where("target <> source").select(
        F.concat(F.lit("merge-"), F.substring(F.sha2(F.concat_ws("\0", "target", "source"), 256), 1, 16)).alias("id"), F.col("target").alias("application_id"), F.lit("merge").alias("correction_type"),
        F.to_json(F.struct(F.col("source").alias("source_application_id"), F.col("target").alias("target_application_id"))).alias("before_json"), gone.alias("after_json"), F.lit(at).cast("timestamp_ntz").alias("created_at"),
    )


def moved_events(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events of merged sources now belong to their targets."""
    to = pairs.select(F.col("source").alias("application_id"), "target")
    return events.join(to, "application_id", "left").withColumn("application_id", F.coalesce("target", "application_id")).select(*events.columns)


def split_ids(selection: DataFrame) -> DataFrame:
    """selection: application_id, event id.  Adds the new application's id, a hash of the source and its sorted events."""
    key = F.concat_ws("\0", "application_id", F.array_join(F.array_sort(F.collect_list("id")), "\0"))
    ids = selection.groupBy("application_id").agg(key.alias("k"))
    return ids.select("application_id", F.concat(F.lit("manual-split-"), F.substring(F.sha2("k", 256), 1, 16)).alias("split_id"))


def split(apps: DataFrame, events: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, events) after moving the selected events to new applications; one event at least must stay.

    Both sides get their bounds from their own events and are locked.
    """
    ids = split_ids(selection)
    chosen = events.join(selection.select("application_id", "id", F.lit(True).alias("chosen")), ["application_id", "id"], "left").join(ids, "application_id", "left")
    left = chosen.where("split_id IS NOT NULL").groupBy("application_id").agg(F.sum(F.when(F.col("chosen"), 0).otherwise(1)).alias("stay")).where("stay > 0").select("application_id")
    valid = ids.join(left, "application_id", "left_semi")
    sorted_out = chosen.drop("split_id").join(valid, "application_id", "left").withColumn("application_id", F.when(F.col("chosen") & F.col("split_id").isNotNull(), F.col("split_id")).otherwise(F.col("application_id")))
    bounds = sorted_out.groupBy("application_id").agg(F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at")).withColumnRenamed("application_id", "id")
    touched = valid.select(F.col("application_id").alias("id"), F.col("application_id").alias("from")).unionByName(valid.select(F.col("split_id").alias("id"), F.col("application_id").alias("from")))
    base = apps.withColumnRenamed("id", "from").join(touched, "from").join(bounds, "id")
    fresh = base.withColumns({"first_seen_at": F.col("first_at"), "last_activity_at": F.col("last_at"), "manual_lock": F.lit(True)})
    rest = apps.join(touched.select("id"), "id", "left_anti")
    return rest.select(*apps.columns).unionByName(fresh.select(*apps.columns)), sorted_out.select(*events.columns)


def reset_locks(apps: DataFrame, statuses: DataFrame, events: DataFrame, ids: DataFrame) -> DataFrame:
    """Unlocks applications; bounds and status come from their events again.  statuses: application_id, status."""
    bounds = events.groupBy("application_id").agg(F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at"))
    facts = bounds.join(statuses, "application_id", "left").withColumnRenamed("application_id", "id").join(ids.select("id").distinct(), "id", "left_semi")
    wide = apps.join(facts.withColumn("reset", F.lit(True)), "id", "left")
    on = F.coalesce("reset", F.lit(False))
    new = {"manual_lock": F.lit(False), "first_seen_at": F.col("first_at"), "last_activity_at": F.col("last_at"), "current_status": F.coalesce("status", "current_status")}
    return wide.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in new.items()}).select(*apps.columns)


def edited_statuses(apps: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next applications, id and outcome of each edit): edited and locked, no_change, or not_found.  edits: id, status."""
    e = edits.dropDuplicates(["id"]).select("id", F.col("status").alias("wanted"))
    judged = e.join(apps.select("id", "current_status"), "id", "left").select("id", "wanted", F.when(F.col("current_status").isNull(), "not_found").when(F.col("current_status") == F.col("wanted"), "no_change").otherwise("edited").alias("outcome"))
    wide = apps.join(judged.where("outcome = 'edited'").select("id", "wanted"), "id", "left")
    on = F.col("wanted").isNotNull()
    return wide.withColumns({"current_status": F.coalesce("wanted", "current_status"), "manual_lock": F.col("manual_lock") | on}).select(*apps.columns), judged.select("id", "outcome")


def renamed_events(events: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edited events whose identity (type or time) changes get the id of that identity.

    Returns (next events, id, new_id and outcome of each edit): edited, no_change, not_found, or duplicate where that id is taken."""
    from trailmark.operators.linkage import event_id

    changed = edited_events(events, edits).join(edits.select("id"), "id", "left_semi")
    e = changed.select("id", "application_id", "email_id", F.col("event_type").alias("event"), F.col("event_at").alias("at"))
    ids = e.select("id", event_id().alias("named"))
    now = events.select("id", F.struct("event_type", "event_at").alias("was")).join(changed.select("id", F.struct("event_type", "event_at").alias("is")), "id").select("id", (F.col("was") != F.col("is")).alias("differs"))
    taken = events.select(F.col("id").alias("named"), F.lit(True).alias("taken"))
    judged = edits.select("id").distinct().join(now, "id", "left").join(ids, "id", "left").join(taken, "named", "left")
    other = F.col("named") != F.col("id")
    outcome = F.when(F.col("differs").isNull(), "not_found").when(~F.col("differs"), "no_change").when(F.col("taken") & other, "duplicate").otherwise("edited")
    judged = judged.select("id", F.when(outcome == "edited", F.col("named")).alias("new_id"), outcome.alias("outcome"))
    good = edits.join(judged.where("outcome = 'edited'").select("id"), "id", "left_semi")
    renamed = edited_events(events, good).join(judged.where("outcome = 'edited'").select("id", "new_id"), "id", "left")
    return renamed.withColumn("id", F.coalesce("new_id", "id")).select(*events.columns), judged


def edited_events(events: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: id, event_type, event_at (null: unchanged).  A new type clears extracted_status; edits that change nothing are left out."""
    e = edits.select("id", F.col("event_type").alias("new_type"), F.col("event_at").alias("new_at"))
    wide = events.join(e, "id", "left")
    retyped = F.coalesce(F.col("new_type") != F.col("event_type"), F.lit(False))
    new = wide.withColumn("extracted_status", F.when(retyped, F.lit(None)).otherwise(F.col("extracted_status")))
    return new.withColumn("event_type", F.coalesce("new_type", "event_type")).withColumn("event_at", F.coalesce("new_at", "event_at")).select(*events.columns)
