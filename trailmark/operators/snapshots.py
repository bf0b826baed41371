"""Mutations as snapshots: each takes the old table and a batch of changes and returns the next table.

Parquet has no row-level merge, so a change is a keyed join of old and new rows; the caller writes the result as a new version (see
``trailmark.sources.tables``).  Batches may repeat a key: the row of greatest ``seq`` (or, without one, any single row) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BODY_KEPT = ("retained", "debugging")
SUMMARY = ("company", "role_title", "source", "current_status", "salary_min", "salary_max", "work_mode", "seniority", "sponsorship")


def last_of(batch: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row for each key: the last of the batch."""
    if order not in batch.columns:
        return batch.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", order)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key: last write wins, old rows of other keys stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def first_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert only rows whose key isn't there."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def removed(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Without the rows of these ids: for every child table of a deleted row."""
    return old.join(ids.select(ids.columns[0]).distinct().withColumnRenamed(ids.columns[0], key), key, "left_anti").select(*old.columns)


def _both(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key, F.struct(*old.columns).alias("o")).join(new.select(key, F.struct(*new.columns).alias("n")), key, "full")


def upsert_emails(old: DataFrame, batch: DataFrame) -> DataFrame:
    """A new metadata-only row never takes away a kept body; rows of another provider aren't touched."""
    new = last_of(batch, ["id"])
    keeps = F.col("o.body_retention_state").isin(*BODY_KEPT) & (F.col("n.body_retention_state") == "metadata_only")
    foreign = F.col("o.provider") != F.col("n.provider")
    old_wins = F.col("n").isNull() | F.coalesce(foreign, F.lit(False))

    def value(c: str) -> Column:
        taken = F.col(f"n.{c}")
        if c in ("body_text", "body_retention_state"):
            taken = F.when(F.coalesce(keeps, F.lit(False)), F.col(f"o.{c}")).otherwise(taken)
        return F.when(old_wins, F.col(f"o.{c}")).otherwise(taken).alias(c)

    return _both(old, new, "id").select(*[value(c) for c in old.columns])


def attach_bodies(old: DataFrame, bodies: DataFrame) -> DataFrame:
    """Body and state are replaced; unknown mails come in as stubs.  bodies: id, provider, body_text, body_retention_state."""
    new = last_of(bodies, ["id"])
    fresh = [c for c in old.columns if c in new.columns and c not in ("id", "provider")]
    pick = [F.coalesce("o.id", "n.id").alias("id") if c == "id" else F.coalesce("o.provider", "n.provider").alias(c) if c == "provider" else (F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in fresh else F.col(f"o.{c}")).alias(c) for c in old.columns]
    return _both(old, new, "id").select(*pick)


def upsert_applications(old: DataFrame, batch: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next table, outcome of each proposed row).  tombstones: id of applications that were merged away.

    A locked application stays as it is; first_seen_at and created_at of an existing one never change.
    """
    new = last_of(batch, ["id"]).join(tombstones.select("id", F.lit(True).alias("merged")), "id", "left")
    wide = _both(old, new, "id")
    locked = F.coalesce(F.col("o.manual_lock"), F.lit(False))
    same = F.lit(True)
    for c in (c for c in SUMMARY if c in old.columns):
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    outcome = F.when(F.col("n.merged"), "merged_source").when(locked & same, "locked_unchanged").when(locked, "manual_conflict").otherwise("upserted")
    marked = wide.withColumn("outcome", F.when(F.col("n").isNotNull(), outcome))
    old_wins = F.coalesce(F.col("outcome") != "upserted", F.lit(True))
    kept = ("first_seen_at", "created_at", "manual_lock")
    pick = [F.when(old_wins, F.col(f"o.{c}")).otherwise(F.coalesce(f"o.{c}", f"n.{c}") if c in kept else F.col(f"n.{c}")).alias(c) for c in old.columns]
    return marked.where(~(F.col("o").isNull() & (F.col("outcome") == "merged_source"))).select(*pick), marked.where("n IS NOT NULL").select("id", "outcome")


def protected_events(corrections: DataFrame) -> DataFrame:
    """Events and source mails that a manual event edit names: event_id, email_id (X04's tombstones are read alike)."""
    edits = corrections.where("correction_type = 'event_edit'")
    return edits.select(F.get_json_object("before_json", "$.event.id").alias("event_id"), F.get_json_object("before_json", "$.event.email_id").alias("email_id"))


def merge_tombstones(corrections: DataFrame) -> DataFrame:
    return corrections.where("correction_type = 'merge'").select(F.get_json_object("after_json", "$.deleted_source_application_id").alias("id")).where("id IS NOT NULL").distinct()


def upsert_events(old: DataFrame, batch: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next table, outcomes); events edited by hand, by their id or their mail, are left alone."""
    new, guard = last_of(batch, ["id"]), protected_events(corrections)
    by_id = guard.select(F.col("event_id").alias("id"), F.lit(True).alias("edited")).where("id IS NOT NULL").distinct()
    by_mail = guard.select("email_id", F.lit(True).alias("mail_edited")).where("email_id IS NOT NULL").distinct()
    marked = new.join(by_id, "id", "left").join(by_mail, "email_id", "left")
    outcome = F.when(F.coalesce("edited", "mail_edited", F.lit(False)), "manual_conflict").otherwise("upserted")
    judged = marked.withColumn("outcome", outcome)
    return replaced(old, judged.where("outcome = 'upserted'"), ["id"]), judged.select("id", "outcome")


def reassigned(events: DataFrame, source: str, target: str, ids: list[str] | None = None) -> DataFrame:
    """Moves all, or the named, events of one application to another."""
    moves = F.col("application_id") == source
    if ids is not None:
        moves = moves & F.col("id").isin(*ids)
    return events.withColumn("application_id", F.when(moves, F.lit(target)).otherwise(F.col("application_id")))


def moved(events: DataFrame, moves: DataFrame) -> DataFrame:
    """Events go where a table of moves says: source, target, and event_id, null for all events of the source."""
    some = moves.where("event_id IS NOT NULL").select(F.col("source").alias("application_id"), F.col("event_id").alias("id"), F.col("target").alias("to_one"))
    all_ = moves.where("event_id IS NULL").select(F.col("source").alias("application_id"), F.col("target").alias("to_all"))
    wide = events.join(some, ["application_id", "id"], "left").join(all_, "application_id", "left")
    return wide.withColumn("application_id", F.coalesce("to_one", "to_all", "application_id")).select(*events.columns)


def updated_events(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates: id, new_id (null: unchanged), event_type, event_at, extracted_status; rows of unknown ids change nothing."""
    u = updates.select("id", F.struct("new_id", "event_type", "event_at", "extracted_status").alias("u"))
    wide = events.join(u, "id", "left")
    at = lambda c: F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)).alias(c)
    return wide.select(*[F.coalesce("u.new_id", "id").alias("id") if c == "id" else at(c) if c in ("event_type", "event_at", "extracted_status") else F.col(c) for c in events.columns])


def delete_events(events: DataFrame, wanted: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next table, outcome of each wanted application_id and id): deleted, not_found, or manual_conflict for edited events."""
    guard = protected_events(corrections)
    by_id = guard.select(F.col("event_id").alias("id"), F.lit(True).alias("edited")).where("id IS NOT NULL").distinct()
    by_mail = guard.select("email_id", F.lit(True).alias("mail_edited")).where("email_id IS NOT NULL").distinct()
    own = events.select("application_id", "id", "email_id", F.lit(True).alias("there"))
    judged = wanted.select("application_id", "id").distinct().join(own, ["application_id", "id"], "left").join(by_id, "id", "left").join(by_mail, "email_id", "left")
    outcome = F.when(F.col("there").isNull(), "not_found").when(F.coalesce("edited", "mail_edited", F.lit(False)), "manual_conflict").otherwise("deleted")
    judged = judged.select("application_id", "id", outcome.alias("outcome"))
    return removed(events, judged.where("outcome = 'deleted'").select("id"), "id"), judged


def delete_ghosts(events: DataFrame, ids: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next table, application_id and outcome): an application loses its ghosts unless one of them was edited by hand."""
    guard = protected_events(corrections).select(F.col("event_id").alias("id"), F.lit(True).alias("edited")).where("id IS NOT NULL").distinct()
    ghosts = events.where("event_type = 'ghost_inferred'").select("application_id", "id").join(guard, "id", "left")
    by_app = ghosts.groupBy("application_id").agg(F.max(F.coalesce("edited", F.lit(False))).alias("edited"))
    wanted = ids.select(F.col(ids.columns[0]).alias("application_id")).distinct().join(by_app, "application_id", "left")
    judged = wanted.select("application_id", F.when(F.col("edited").isNull(), "not_found").when(F.col("edited"), "manual_conflict").otherwise("deleted").alias("outcome"))
    gone = judged.where("outcome = 'deleted'").select("application_id", F.lit("ghost_inferred").alias("event_type"))
    return events.join(gone, ["application_id", "event_type"], "left_anti").select(*events.columns), judged


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """An audit log or chat grows; an id that is there already isn't taken again."""
    return first_wins(log, new, ["id"])


def reassigned_corrections(corrections: DataFrame, moves: DataFrame) -> DataFrame:
    """Corrections of merged applications now belong to their targets; moves: source, target."""
    to = moves.select(F.col("source").alias("application_id"), "target")
    return corrections.join(to, "application_id", "left").withColumn("application_id", F.coalesce("target", "application_id")).select(*corrections.columns)


def completed_turn(chat: DataFrame, turns: DataFrame) -> DataFrame:
    """Answers that are there already for (conversation_id, turn): the assistant's message after that user turn."""
    answers = chat.where("role = 'assistant'").select("conversation_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer"))
    return turns.select("conversation_id", "turn").join(answers, ["conversation_id", "turn"])


def upsert_states(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Run records, cursors and progress by key; counters never go back, a cursor that is null leaves the known one."""
    new = last_of(batch, ["id"])
    kept = {"cursor": F.coalesce("n.cursor", "o.cursor"), "pages": F.greatest("o.pages", "n.pages"), "messages": F.greatest("o.messages", "n.messages"), "started_at": F.coalesce("o.started_at", "n.started_at")}
    pick = [F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(kept.get(c, F.col(f"n.{c}"))).alias(c) for c in old.columns]
    return _both(old, new, "id").select(*pick)


def mark_stale(insights: DataFrame, current_hash: str) -> DataFrame:
    """Every insight of another input is stale."""
    return insights.withColumn("is_stale", F.col("is_stale") | (F.col("inputs_hash") != current_hash))


def changed_rows(old: DataFrame, new: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """Key and what happened to it, by a null-safe comparison of the tracked columns."""
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    kind = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(differs, "update")
    return _both(old, new, key).select(key, kind.alias("change")).where("change IS NOT NULL")


def upsert_profiles(old: DataFrame, batch: DataFrame) -> DataFrame:
    """By lower-cased, trimmed company; created_at stays."""
    new = last_of(batch.withColumn("normalized_company", F.lower(F.trim("display_company"))), ["normalized_company"])
    pick = [(F.coalesce(f"o.{c}", f"n.{c}") if c == "created_at" else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in old.columns]
    return _both(old, new, "normalized_company").select(*pick)


def replace_chunks(old: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the given mails are replaced."""
    return replaced(old, chunks, ["email_id"])
