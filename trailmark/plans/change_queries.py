"""Registered snapshot, correction and pipeline-status queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import corrections, lists, snapshots, status
from trailmark.plans.catalog import query
from trailmark.sources.testdata import JobSearch

_E = "id, provider, thread_id, subject, body_retention_state, body_text, sent_at"
#: A batch of mails: every third known one, as metadata only or of another provider, and some new ones.
_BATCH = {
    "mail_batch": f"""
        SELECT id, CASE WHEN CAST(id AS BIGINT) % 15 = 0 THEN 'other' ELSE provider END AS provider, thread_id, 'new: ' || subject AS subject,
               CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'metadata_only' ELSE 'retained' END AS body_retention_state,
               CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN NULL ELSE 'new body' END AS body_text, sent_at FROM <raw_emails> WHERE CAST(id AS BIGINT) % 3 = 0
        UNION ALL SELECT 'new-' || id, provider, thread_id, subject, 'metadata_only', NULL, sent_at FROM <raw_emails> WHERE CAST(id AS BIGINT) % 50 = 0
    """
}


def _mails(j: JobSearch):
    n = F.col("id").cast("long")
    old = j.emails.select("id", "provider", "thread_id", "subject", "body_retention_state", "body_text", "sent_at")
    known = old.where(n % 3 == 0).select(
        "id", F.when(n % 15 == 0, "other").otherwise(F.col("provider")).alias("provider"), "thread_id", F.concat(F.lit("new: "), "subject").alias("subject"),
        F.when(n % 2 == 0, "metadata_only").otherwise("retained").alias("body_retention_state"), F.when(n % 2 != 0, "new body").alias("body_text"), "sent_at",
    )
    fresh = old.where(n % 50 == 0).select(F.concat(F.lit("new-"), "id").alias("id"), "provider", "thread_id", "subject", F.lit("metadata_only").alias("body_retention_state"), F.lit(None).cast("string").alias("body_text"), "sent_at")
    return old, known.unionByName(fresh)


query(
    "k01_k02_upsert_emails",
    """SELECT coalesce(o.id, n.id) AS id, CASE WHEN u THEN n.provider ELSE o.provider END AS provider, CASE WHEN u THEN n.thread_id ELSE o.thread_id END AS thread_id, CASE WHEN u THEN n.subject ELSE o.subject END AS subject,
              CASE WHEN u AND NOT k THEN n.body_retention_state ELSE o.body_retention_state END AS body_retention_state, CASE WHEN u AND NOT k THEN n.body_text ELSE o.body_text END AS body_text,
              CASE WHEN u THEN n.sent_at ELSE o.sent_at END AS sent_at
       FROM (SELECT o.*, n.id AS nid, n.id IS NOT NULL AND coalesce(o.provider = n.provider, true) AS u, coalesce(o.body_retention_state IN ('retained', 'debugging') AND n.body_retention_state = 'metadata_only', false) AS k
             FROM <mail_batch> n FULL JOIN <raw_emails> o ON o.id = n.id) o LEFT JOIN <mail_batch> n ON n.id = o.nid""",
    _BATCH,
)(lambda j: snapshots.upsert_emails(*_mails(j)))
query(
    "k03_attach_bodies",
    f"""SELECT {_E} FROM <raw_emails> WHERE CAST(id AS BIGINT) % 10 > 1
        UNION ALL SELECT id, provider, thread_id, subject, 'retained', 'fetched', sent_at FROM <raw_emails> WHERE CAST(id AS BIGINT) % 10 <= 1
        UNION ALL SELECT 'stub', 'gmail', NULL, NULL, 'retained', 'fetched', NULL""",
)(
    lambda j: snapshots.attach_bodies(
        _mails(j)[0],
        j.emails.where(F.col("id").cast("long") % 10 <= 1).select("id", "provider").unionByName(j.spark.createDataFrame([("stub", "gmail")], "id string, provider string")).withColumns({"body_retention_state": F.lit("retained"), "body_text": F.lit("fetched")}),
    )
)
query(
    "k04_upsert_classifications",
    """SELECT email_id, category, confidence, 'model-2' AS model FROM <email_classifications> WHERE CAST(email_id AS BIGINT) % 4 = 0
       UNION ALL SELECT email_id, category, confidence, model FROM <email_classifications> WHERE CAST(email_id AS BIGINT) % 4 <> 0""",
)(lambda j: (lambda c: snapshots.replaced(c, c.where(F.col("email_id").cast("long") % 4 == 0).withColumn("model", F.lit("model-2")), ["email_id"]))(j.classes.select("email_id", "category", "confidence", "model")))
_A = "id, company, role_title, source, first_seen_at, current_status, salary_min, salary_max, work_mode, seniority, sponsorship, last_activity_at, manual_lock, created_at"
#: Proposals: every fourth application, a status later for those of odd id, seen a day later; and rows of merged ones.
_PROPOSED = {
    "proposed": """
        SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'withdrawn' ELSE current_status END AS current_status, first_seen_at + INTERVAL '1' DAY AS first_seen_at) FROM <applications> WHERE CAST(id AS BIGINT) % 2 = 0
        UNION ALL SELECT * REPLACE ('again-' || id AS id) FROM <applications> WHERE CAST(id AS BIGINT) % 100 = 0
    """,
    "judged": """
        SELECT p.*, CASE WHEN p.id IN ('again-100', 'again-200') THEN 'merged_source' WHEN o.manual_lock AND p.current_status = o.current_status THEN 'locked_unchanged' WHEN o.manual_lock THEN 'manual_conflict' ELSE 'upserted' END AS outcome,
               o.first_seen_at AS old_seen FROM <proposed> p LEFT JOIN <applications> o ON o.id = p.id
    """,
}


def _upserted(j: JobSearch):
    n = F.col("id").cast("long")
    known = j.apps.where(n % 2 == 0).withColumn("current_status", F.when(n % 3 == 0, "withdrawn").otherwise(F.col("current_status"))).withColumn("first_seen_at", F.col("first_seen_at") + F.expr("INTERVAL '1' DAY"))
    again = j.apps.where(n % 100 == 0).withColumn("id", F.concat(F.lit("again-"), "id"))
    return snapshots.upsert_applications(j.apps, known.unionByName(again), j.spark.createDataFrame([("again-100",), ("again-200",)], "id string"))


query("k06_application_outcomes", "SELECT id, outcome FROM <judged>", _PROPOSED)(lambda j: _upserted(j)[1])
query(
    "k06_upsert_applications",
    "SELECT id, current_status, coalesce(old_seen, first_seen_at) AS first_seen_at FROM <judged> WHERE outcome = 'upserted' UNION ALL SELECT id, current_status, first_seen_at FROM <applications> WHERE id NOT IN (SELECT id FROM <judged> WHERE outcome = 'upserted')",
    _PROPOSED,
)(lambda j: _upserted(j)[0].select("id", "current_status", "first_seen_at"))


def _edited(j: JobSearch):
    return j.events.where("right(id, 1) = '5'").select(F.lit("event_edit").alias("correction_type"), F.to_json(F.struct(F.struct("id", F.when(F.col("event_type") == "offer", F.col("email_id")).alias("email_id")).alias("event"))).alias("before_json"))


query(
    "k07_event_outcomes",
    """SELECT DISTINCT e.id, CASE WHEN right(e.id, 1) = '5' OR e.email_id IN (SELECT email_id FROM <application_events> WHERE right(id, 1) = '5' AND event_type = 'offer') THEN 'manual_conflict' ELSE 'upserted' END AS outcome FROM <application_events> e""",
)(lambda j: snapshots.upsert_events(j.events, j.events, _edited(j))[1])
query("k08_k13_cascade", "SELECT id, application_id FROM <application_events> WHERE application_id NOT IN (SELECT id FROM <applications> WHERE current_status = 'withdrawn')")(
    lambda j: snapshots.removed(j.events, j.apps.where("current_status = 'withdrawn'").select("id"), "application_id").select("id", "application_id")
)
_MOVES = {
    "moves": """SELECT id AS source, CAST(CAST(id AS BIGINT) + 1 AS STRING) AS target, CAST(NULL AS STRING) AS event_id FROM <applications> WHERE CAST(id AS BIGINT) % 20 = 1
        UNION ALL SELECT application_id, '2', id FROM <application_events> WHERE CAST(application_id AS BIGINT) % 20 = 4 AND event_type = 'offer'""",
    "updates": "SELECT id, 'new-' || id AS new_id, 'offer' AS event_type, event_at + INTERVAL '1' DAY AS event_at, CAST(NULL AS STRING) AS extracted_status FROM <application_events> WHERE right(id, 1) = '3' UNION ALL SELECT 'none', NULL, 'offer', CAST('1998-01-01' AS {TS}), NULL",
    "wanted_events": "SELECT DISTINCT application_id, id FROM <application_events> WHERE event_type = 'feedback' UNION ALL SELECT 'x', 'y'",
    "edited_ids": "SELECT DISTINCT id AS event_id, email_id FROM <application_events> WHERE right(id, 1) = '5'",
    "log": "SELECT CAST(doc_id AS STRING) AS id, CAST(doc_id % 50 AS STRING) AS application_id, quality FROM <labels> WHERE doc_id % 3 <> 0",
    "log_new": "SELECT CAST(doc_id AS STRING) AS id, CAST(doc_id % 50 AS STRING) AS application_id, 7 AS quality FROM <labels> WHERE doc_id % 2 = 0",
    "log_moves": "SELECT DISTINCT CAST(doc_id % 50 AS STRING) AS source, 'm' AS target FROM <labels> WHERE doc_id % 10 = 3",
    "runs": "SELECT DISTINCT CAST(event_id % 40 AS STRING) AS id, 'p' AS provider, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'c' || CAST(event_id % 40 AS STRING) END AS cursor, event_id % 40 AS pages, 10 AS messages, CAST('1998-01-01' AS {TS}) AS started_at, CAST('1998-01-02' AS {TS}) AS updated_at FROM <events> WHERE event_id % 40 < 30",
    "runs_new": "SELECT DISTINCT CAST(event_id % 40 AS STRING) AS id, 'p' AS provider, CASE WHEN (event_id % 40) % 3 = 0 THEN NULL ELSE 'n' END AS cursor, 20 AS pages, 5 AS messages, CAST('1999-01-01' AS {TS}) AS started_at, CAST('1999-01-02' AS {TS}) AS updated_at FROM <events> WHERE event_id % 40 >= 10",
}


def _guard(j: JobSearch):
    return j.view("edited_ids", _MOVES).select(F.lit("event_edit").alias("correction_type"), F.to_json(F.struct(F.struct(F.col("event_id").alias("id")).alias("event"))).alias("before_json"))


query(
    "k10_moved_events",
    "SELECT e.id, coalesce(o.target, a.target, e.application_id) AS application_id FROM <application_events> e LEFT JOIN <moves> o ON o.event_id = e.id AND o.source = e.application_id LEFT JOIN <moves> a ON a.event_id IS NULL AND a.source = e.application_id",
    _MOVES,
)(lambda j: snapshots.moved(j.events, j.view("moves", _MOVES)).select("id", "application_id"))
query(
    "k11_updated_events",
    "SELECT coalesce(u.new_id, e.id) AS id, coalesce(u.event_type, e.event_type) AS event_type, coalesce(u.event_at, e.event_at) AS event_at, CASE WHEN u.id IS NULL THEN e.extracted_status END AS extracted_status FROM <application_events> e LEFT JOIN <updates> u ON u.id = e.id",
    _MOVES,
)(lambda j: snapshots.updated_events(j.events, j.view("updates", _MOVES)).select("id", "event_type", "event_at", "extracted_status"))
query(
    "k08_delete_outcomes",
    """SELECT w.application_id, w.id, CASE WHEN e.id IS NULL THEN 'not_found' WHEN w.id IN (SELECT event_id FROM <edited_ids>) THEN 'manual_conflict' ELSE 'deleted' END AS outcome
       FROM <wanted_events> w LEFT JOIN (SELECT DISTINCT application_id, id FROM <application_events>) e ON e.id = w.id AND e.application_id = w.application_id""",
    _MOVES,
)(lambda j: snapshots.delete_events(j.events, j.view("wanted_events", _MOVES), _guard(j))[1].distinct())
query(
    "k09_delete_ghosts",
    """SELECT application_id, id, event_type FROM <application_events> e WHERE NOT (event_type = 'ghost_inferred' AND CAST(application_id AS BIGINT) % 3 = 0
       AND application_id NOT IN (SELECT application_id FROM <application_events> WHERE event_type = 'ghost_inferred' AND right(id, 1) = '5'))""",
    _MOVES,
)(lambda j: snapshots.delete_ghosts(j.events, j.apps.where(F.col("id").cast("long") % 3 == 0).select("id"), _guard(j))[0].select("application_id", "id", "event_type"))
query(
    "k05_k16_replaced",
    "SELECT id, application_id, quality FROM <log> WHERE id NOT IN (SELECT id FROM <log_new>) UNION ALL SELECT id, application_id, quality FROM <log_new>",
    _MOVES,
)(lambda j: snapshots.replaced(j.view("log", _MOVES), j.view("log_new", _MOVES), ["id"]))
query(
    "k15_k22_appended",
    "SELECT l.id, coalesce(m.target, l.application_id) AS application_id, l.quality FROM (SELECT * FROM <log> UNION ALL SELECT * FROM <log_new> WHERE id NOT IN (SELECT id FROM <log>)) l LEFT JOIN <log_moves> m ON m.source = l.application_id",
    _MOVES,
)(lambda j: snapshots.reassigned_corrections(snapshots.appended(j.view("log", _MOVES), j.view("log_new", _MOVES)), j.view("log_moves", _MOVES)))
query("k18_removed_chunks", "SELECT email_id, chunk_index FROM <email_chunks> WHERE right(email_id, 1) <> '4'")(
    lambda j: snapshots.removed(j.chunks, j.emails.where("right(id, 1) = '4'").select("id"), "email_id").select("email_id", "chunk_index")
)
query(
    "k17_replaced_chunks",
    "SELECT email_id, chunk_index, CASE WHEN right(email_id, 1) = '4' THEN 'new' ELSE content END AS content FROM <email_chunks> WHERE right(email_id, 1) <> '4' OR chunk_index = 0",
)(lambda j: (lambda c: snapshots.replace_chunks(c, c.where("right(email_id, 1) = '4' AND chunk_index = 0").withColumn("content", F.lit("new"))))(j.chunks.select("email_id", "chunk_index", "content")))
query(
    "k22_completed_turns",
    "SELECT u.conversation_id, u.turn, a.content AS answer FROM <chat_messages> u JOIN <chat_messages> a ON a.conversation_id = u.conversation_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'",
)(lambda j: snapshots.completed_turn(j.chat, j.chat.where("role = 'user'")))
query(
    "k24_run_states",
    """SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.cursor ELSE coalesce(n.cursor, o.cursor) END AS cursor, CASE WHEN n.id IS NULL THEN o.pages ELSE greatest(o.pages, n.pages) END AS pages,
              coalesce(o.started_at, n.started_at) AS started_at, coalesce(n.updated_at, o.updated_at) AS updated_at FROM <runs> o FULL JOIN <runs_new> n ON n.id = o.id""",
    _MOVES,
)(lambda j: snapshots.upsert_states(j.view("runs", _MOVES), j.view("runs_new", _MOVES)).select("id", "cursor", "pages", "started_at", "updated_at"))
query(
    "k20_stale_insights", "SELECT id, is_stale OR inputs_hash <> 'h1' AS is_stale FROM <insights>"
)(lambda j: snapshots.mark_stale(j.view("insights"), "h1").select("id", "is_stale"))
query(
    "x04_merge_tombstones", "SELECT source AS id FROM <merge_pairs>", {"merge_pairs": "SELECT id AS target, CAST(CAST(id AS BIGINT) + 1 AS STRING) AS source FROM <applications> WHERE CAST(id AS BIGINT) % 40 = 4 AND CAST(CAST(id AS BIGINT) + 1 AS STRING) IN (SELECT id FROM <applications>)"}
)(lambda j: snapshots.merge_tombstones(corrections.merge_records(_pairs(j), "1998-09-01")))
query(
    "k21_changed_rows",
    """SELECT id, CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN 'delete' ELSE 'update' END AS change FROM <applications> WHERE CAST(id AS BIGINT) % 9 = 0 OR (CAST(id AS BIGINT) % 5 = 0 AND work_mode IS NOT NULL)
       UNION ALL SELECT 'new', 'insert'""",
)(
    lambda j: snapshots.changed_rows(
        j.apps.select("id", "work_mode"),
        j.apps.where(F.col("id").cast("long") % 9 != 0).select("id", F.when(F.col("id").cast("long") % 5 != 0, F.col("work_mode")).alias("work_mode")).unionByName(j.spark.createDataFrame([("new", "remote")], "id string, work_mode string")),
        "id",
        ["work_mode"],
    )
)
query(
    "k23_first_wins",
    "SELECT id, application_id, event_type FROM <application_events> WHERE event_type = 'interview_scheduled' UNION ALL SELECT id, application_id, 'new' FROM <application_events> WHERE event_type = 'offer'",
)(lambda j: (lambda e: snapshots.first_wins(e.where("event_type = 'interview_scheduled'"), e.where("event_type IN ('interview_scheduled', 'offer')").withColumn("event_type", F.lit("new")), ["id"]))(j.events.select("id", "application_id", "event_type")))
query("k25_upsert_profiles", "SELECT normalized_company, CASE WHEN company_type = 'building' THEN 'construction' ELSE company_type END AS company_type FROM <company_profiles>")(
    lambda j: snapshots.upsert_profiles(
        j.profiles.withColumn("created_at", F.lit(1)), j.profiles.where("company_type = 'building'").select(F.upper("display_company").alias("display_company"), F.lit("construction").alias("company_type"), "industry", F.lit(2).alias("created_at"))
    ).select("normalized_company", "company_type")
)
_PAIRS = {"merge_pairs": "SELECT id AS target, CAST(CAST(id AS BIGINT) + 1 AS STRING) AS source FROM <applications> WHERE CAST(id AS BIGINT) % 40 = 4 AND CAST(CAST(id AS BIGINT) + 1 AS STRING) IN (SELECT id FROM <applications>)"}


def _pairs(j: JobSearch):
    p = j.apps.where(F.col("id").cast("long") % 40 == 4).select(F.col("id").alias("target"), (F.col("id").cast("long") + 1).cast("string").alias("source"))
    return p.join(j.apps.select(F.col("id").alias("source")), "source", "left_semi")


query(
    "l14_f27_merged",
    """SELECT t.id, least(t.first_seen_at, s.first_seen_at) AS first_seen_at, least(t.salary_min, s.salary_min) AS salary_min, greatest(t.salary_max, s.salary_max) AS salary_max, coalesce(t.work_mode, s.work_mode) AS work_mode,
              CASE WHEN list_position(p, t.current_status) <= list_position(p, s.current_status) THEN t.current_status ELSE s.current_status END AS current_status, true AS manual_lock
       FROM <merge_pairs> m JOIN <applications> t ON t.id = m.target JOIN <applications> s ON s.id = m.source CROSS JOIN (SELECT ['offer', 'rejected', 'withdrawn', 'interview', 'assessment', 'in_review', 'ghosted', 'applied'] AS p) x
       UNION ALL SELECT id, first_seen_at, salary_min, salary_max, work_mode, current_status, manual_lock FROM <applications> WHERE id NOT IN (SELECT target FROM <merge_pairs> UNION ALL SELECT source FROM <merge_pairs>)""",
    _PAIRS,
)(lambda j: corrections.merged(j.apps, _pairs(j)).select("id", "first_seen_at", "salary_min", "salary_max", "work_mode", "current_status", "manual_lock"))
query("l14_moved_events", "SELECT e.id, coalesce(m.target, e.application_id) AS application_id FROM <application_events> e LEFT JOIN <merge_pairs> m ON m.source = e.application_id", _PAIRS)(
    lambda j: corrections.moved_events(j.events, _pairs(j)).select("id", "application_id")
)
_PICKED = {
    "picked": "SELECT application_id, id FROM <application_events> WHERE event_type IN ('rejection', 'offer') AND CAST(application_id AS BIGINT) % 10 = 0",
    "split_to": """SELECT application_id, 'manual-split-' || substring(sha256(application_id || chr(0) || string_agg(id, chr(0) ORDER BY id)), 1, 16) AS split_id FROM <picked> p GROUP BY 1
                   HAVING count(*) < (SELECT count(*) FROM <application_events> e WHERE e.application_id = p.application_id)""",
}
_selection = lambda j: j.events.where("event_type IN ('rejection', 'offer')").where(F.col("application_id").cast("long") % 10 == 0).select("application_id", "id")
query(
    "l15_split_events",
    "SELECT e.id, CASE WHEN p.id IS NOT NULL AND s.split_id IS NOT NULL THEN s.split_id ELSE e.application_id END AS application_id FROM <application_events> e LEFT JOIN <picked> p ON p.id = e.id AND p.application_id = e.application_id LEFT JOIN <split_to> s ON s.application_id = e.application_id",
    _PICKED,
)(lambda j: corrections.split(j.apps, j.events, _selection(j))[1].select("id", "application_id"))
query(
    "l15_split_applications",
    """SELECT x.new_id AS id, min(e.event_at) AS first_seen_at, max(e.event_at) AS last_activity_at, true AS manual_lock FROM (
           SELECT e.*, CASE WHEN p.id IS NOT NULL THEN s.split_id ELSE e.application_id END AS new_id FROM <application_events> e JOIN <split_to> s ON s.application_id = e.application_id LEFT JOIN <picked> p ON p.id = e.id AND p.application_id = e.application_id) x
       JOIN <application_events> e ON e.id = x.id GROUP BY 1
       UNION ALL SELECT id, first_seen_at, last_activity_at, manual_lock FROM <applications> WHERE id NOT IN (SELECT application_id FROM <split_to>)""",
    _PICKED,
)(lambda j: corrections.split(j.apps, j.events, _selection(j))[0].select("id", "first_seen_at", "last_activity_at", "manual_lock"))
query(
    "l16_reset_locks",
    """SELECT a.id, CASE WHEN r THEN false ELSE a.manual_lock END AS manual_lock, CASE WHEN r THEN e.f ELSE a.first_seen_at END AS first_seen_at FROM <applications> a
       LEFT JOIN (SELECT application_id, min(event_at) AS f, true AS r FROM <application_events> GROUP BY 1) x ON x.application_id = a.id AND a.manual_lock LEFT JOIN (SELECT application_id, min(event_at) AS f FROM <application_events> GROUP BY 1) e ON e.application_id = a.id""",
)(lambda j: corrections.reset_locks(j.apps, lists.derive_status(j.events, j.emails, j.classes), j.events, j.apps.where("manual_lock")).select("id", "manual_lock", "first_seen_at"))
query(
    "l17_edited_events",
    "SELECT id, CASE WHEN right(id, 1) = '1' THEN 'offer' ELSE event_type END AS event_type, CASE WHEN right(id, 1) = '1' AND event_type <> 'offer' THEN NULL ELSE extracted_status END AS extracted_status FROM <application_events>",
)(
    lambda j: corrections.edited_events(j.events, j.events.where("right(id, 1) = '1'").select("id", F.lit("offer").alias("event_type"), F.lit(None).cast("timestamp_ntz").alias("event_at"))).select("id", "event_type", "extracted_status")
)

_MODEL = ("model-1", "v2")
query(
    "a31_candidate_stats",
    """SELECT count(*) AS candidates, sum(length(body_text))::BIGINT AS characters FROM <raw_emails> m LEFT JOIN <email_classifications> c ON c.email_id = m.id
       WHERE body_retention_state = 'retained' AND trim(body_text) <> '' AND (c.email_id IS NULL OR c.model <> 'model-1' OR c.prompt_version <> 'v2')""",
)(lambda j: status.candidate_stats(j.emails, j.classes, *_MODEL))
query(
    "a32_reprocessing",
    """SELECT count(*) AS retained, count(*) FILTER (WHERE c.model = 'model-1' AND c.prompt_version = 'v2') AS up_to_date, count(*) FILTER (WHERE c.email_id IS NULL) AS unclassified,
              count(*) FILTER (WHERE c.model <> 'model-1') AS stale_model, count(*) FILTER (WHERE c.model = 'model-1' AND c.prompt_version <> 'v2') AS stale_prompt,
              count(*) FILTER (WHERE c.email_id IS NULL OR c.model <> 'model-1' OR c.prompt_version <> 'v2') AS reprocess
       FROM <raw_emails> m LEFT JOIN <email_classifications> c ON c.email_id = m.id WHERE m.body_retention_state = 'retained' AND m.body_text IS NOT NULL""",
)(lambda j: status.reprocessing(j.emails, j.classes, *_MODEL))
_KEY = " ".join(f"WHEN s LIKE '%{k}%' THEN '{k}'" for k in status.KEYWORDS)
_DECIDED = {
    "signals": f"""SELECT id, thread_id, CASE WHEN len([x FOR x IN labels IF lower(trim(x)) = 'spam']) > 0 THEN 'spam' END AS label, CASE WHEN from_addr LIKE '%@src3.example' THEN 'src3.example' END AS domain, CASE {_KEY} END AS keyword
                   FROM (SELECT *, lower(coalesce(subject, '')) AS s FROM <raw_emails>) x""",
    "decided": """SELECT id, CASE WHEN label IS NULL AND score >= 2 THEN 'candidate' ELSE 'rejected' END AS outcome, CASE WHEN label IS NULL THEN score ELSE 0 END AS score,
                         CASE WHEN label IS NOT NULL THEN 'excluded_label:' || label WHEN score < 2 THEN 'no_filter_signal' WHEN domain IS NOT NULL THEN 'sender_domain:' || domain WHEN keyword IS NOT NULL THEN 'subject_keyword:' || keyword ELSE 'candidate_thread' END AS reason
                  FROM (SELECT *, CAST(CASE WHEN domain IS NULL THEN 0 ELSE 2 END + CASE WHEN keyword IS NULL THEN 0 ELSE 2 END
                               + CASE WHEN thread_id IN (SELECT thread_id FROM <signals> WHERE label IS NULL AND (domain IS NOT NULL OR keyword IS NOT NULL) AND thread_id IS NOT NULL) THEN 2 ELSE 0 END AS INTEGER) AS score FROM <signals>) y""",
}
_decisions = lambda j: status.filter_decisions(j.emails, ("src3.example",))
query("p14_filter_decisions", "SELECT id, outcome, reason, score FROM <decided>", _DECIDED)(_decisions)
_DOMAINS = " ".join(f"WHEN d = '{x}' OR d LIKE '%.{x}' THEN '{x}'" for x in status.SENDER_DOMAINS)
_LABELS = " ".join(f"WHEN len([x FOR x IN labels IF lower(trim(x)) = '{k}']) > 0 THEN '{k}'" for k in status.EXCLUDED_LABELS)
_BY_DEFAULT = {
    "signals": f"""SELECT id, thread_id, CASE {_LABELS} END AS label, CASE {_DOMAINS} END AS domain, CASE {_KEY} END AS keyword
                   FROM (SELECT *, lower(coalesce(subject, '')) AS s, lower(split_part(from_addr, '@', 2)) AS d FROM <raw_emails>) x""",
    "decided": _DECIDED["decided"],
}
query("p15_default_filter", "SELECT id, outcome, reason, score FROM <decided>", _BY_DEFAULT)(lambda j: status.filter_decisions(j.emails))
query(
    "a33_stage_counts",
    """SELECT 'raw_emails' AS stage, count(*) AS rows FROM <raw_emails> UNION ALL SELECT 'metadata_only', count(*) FROM <raw_emails> WHERE body_retention_state = 'metadata_only'
       UNION ALL SELECT 'retained_bodies', count(*) FROM <raw_emails> WHERE body_retention_state IN ('retained', 'debugging') UNION ALL SELECT 'decisions', count(*) FROM <decided>
       UNION ALL SELECT 'candidates', count(*) FROM <decided> WHERE outcome = 'candidate' UNION ALL SELECT 'rejected', count(*) FROM <decided> WHERE outcome = 'rejected' UNION ALL SELECT 'classified', count(*) FROM <email_classifications>
       UNION ALL SELECT 'job_related', count(*) FROM <email_classifications> WHERE is_job_related UNION ALL SELECT 'applications', count(*) FROM <applications> UNION ALL SELECT 'events', count(*) FROM <application_events>""",
    _DECIDED,
)(lambda j: status.stage_counts(j.emails, _decisions(j), j.classes, j.apps, j.events))
query(
    "a35_reconciliation",
    """SELECT (SELECT count(*) FROM <provider_ids>) AS provider_messages, (SELECT count(DISTINCT id) FROM <provider_ids>) AS provider_unique, (SELECT count(*) FROM <raw_emails>) AS local,
              (SELECT count(DISTINCT id) FROM <provider_ids> WHERE id NOT IN (SELECT id FROM <raw_emails>)) AS missing, (SELECT count(*) FROM <raw_emails> WHERE id NOT IN (SELECT id FROM <provider_ids>)) AS extra,
              (SELECT count(*) - count(DISTINCT id) FROM <provider_ids>) AS duplicates, false AS reconciled""",
    {"provider_ids": "SELECT CAST(doc_id AS STRING) AS id FROM <documents> WHERE doc_id % 7 <> 0 UNION ALL SELECT CAST(doc_id AS STRING) FROM <documents> WHERE doc_id % 5 = 1 UNION ALL SELECT 'gone'"},
)(
    lambda j: status.reconciliation(
        j.emails.where(F.col("id").cast("long") % 7 != 0).select("id").union(j.emails.where(F.col("id").cast("long") % 5 == 1).select("id")).union(j.spark.createDataFrame([("gone",)], "id string")), j.emails
    )
)
query(
    "a34_email_counts",
    "SELECT count(*) AS total, count(*) FILTER (WHERE sent_at >= CAST('1998-01-02' AS TIMESTAMP) AND sent_at < CAST('1998-01-09' AS TIMESTAMP)) AS in_window FROM <raw_emails>",
)(lambda j: j.emails.agg(F.count("*").alias("total"), F.count(F.when((F.col("sent_at") >= lists.ts("1998-01-02")) & (F.col("sent_at") < lists.ts("1998-01-09")), 1)).alias("in_window")))
query(
    "a38_token_costs",
    """SELECT event_type AS model, count(*) AS runs, sum(greatest(event_id % 100, user_id % 60 + event_id % 50))::BIGINT AS tokens, CAST(sum(CAST(event_id % 97 AS DECIMAL(18,6)) / 1000000) AS DECIMAL(18,6)) AS cost_usd
       FROM <events> GROUP BY 1""",
)(
    lambda j: status.token_costs(
        j.view("events").select(F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("total_tokens"), (F.col("user_id") % 60).alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), ((F.col("event_id") % 97).cast("decimal(18,6)") / 1000000).alias("cost_usd"))
    )
)
query(
    "a39_confusion",
    """SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tp / (tp + fp) >= 0.9 AND tp / (tp + fn) >= 0.85 AS passed FROM (
           SELECT count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn, count(*) FILTER (WHERE NOT e AND NOT p) AS tn
           FROM (SELECT is_job_related AS e, confidence >= 0.1 AS p FROM <email_classifications>) x) y""",
)(lambda j: status.confusion(j.classes.select(F.col("is_job_related").alias("expected"), (F.col("confidence") >= 0.1).alias("predicted"))))

_EDITS = {"status_edits": "SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'withdrawn' ELSE current_status END AS status FROM <applications> WHERE CAST(id AS BIGINT) % 5 = 0 UNION ALL SELECT 'none', 'offer'"}
query(
    "l17_edited_statuses",
    "SELECT a.id, coalesce(e.status, a.current_status) AS current_status, a.manual_lock OR coalesce(e.status <> a.current_status, false) AS manual_lock FROM <applications> a LEFT JOIN <status_edits> e ON e.id = a.id",
    _EDITS,
)(lambda j: corrections.edited_statuses(j.apps, j.view("status_edits", _EDITS))[0].select("id", "current_status", "manual_lock"))
query(
    "l17_status_outcomes",
    "SELECT e.id, CASE WHEN a.id IS NULL THEN 'not_found' WHEN a.current_status = e.status THEN 'no_change' ELSE 'edited' END AS outcome FROM <status_edits> e LEFT JOIN <applications> a ON a.id = e.id",
    _EDITS,
)(lambda j: corrections.edited_statuses(j.apps, j.view("status_edits", _EDITS))[1])
_STATE = {
    "pipeline_state": """SELECT event_id AS id, event_id % 11 <> 0 AS connected, event_id % 13 = 0 AS reauth_required, event_id % 7 = 0 AS sync_running, event_id % 17 = 0 AS sync_failed,
        CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 5 = 1 THEN 'running' WHEN event_id % 5 = 2 THEN NULL ELSE 'completed' END AS backfill_state, event_id % 9 AS raw_emails, event_id % 4 AS retained_bodies,
        event_id % 6 AS unclassified, event_id % 8 AS applications, CASE WHEN event_id % 2 = 0 THEN 'timeout' END AS last_error FROM <events>""",
    "sync_runs": "SELECT event_id AS id, event_id % 70 AS processed, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 50 END AS target, event_id % 2 = 0 AS finished, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 60 END AS max_messages FROM <events>",
    "sync_states": "SELECT CAST(event_id AS STRING) AS id, event_type AS provider, 'c' || CAST(event_id % 5 AS STRING) AS cursor, CAST('1998-01-01' AS {TS}) + (event_id % 100) * INTERVAL '1' DAY AS updated_at FROM <events>",
}
query(
    "f26_next_action",
    """SELECT id, CASE WHEN reauth_required OR NOT connected THEN 'connect_mail' WHEN sync_running THEN 'wait_for_sync' WHEN sync_failed OR backfill_state = 'failed' THEN 'inspect_error' WHEN raw_emails = 0 THEN 'run_sync'
              WHEN coalesce(backfill_state, '') <> 'completed' THEN 'continue_backfill' WHEN unclassified > 0 THEN 'run_classification' ELSE 'review_dashboard' END AS next_action FROM <pipeline_state>""",
    _STATE,
)(lambda j: status.next_action(j.view("pipeline_state", _STATE)).select("id", "next_action"))
query(
    "f28_sync_progress",
    "SELECT id, CASE WHEN target IS NULL THEN CASE WHEN finished THEN 1.0 ELSE 0.0 END WHEN target = 0 THEN 1.0 ELSE least(1.0, processed / target) END::DOUBLE AS progress, CASE WHEN max_messages IS NOT NULL THEN greatest(1, max_messages - processed) END AS remaining FROM <sync_runs>",
    _STATE,
)(lambda j: status.sync_progress(j.view("sync_runs", _STATE)).select("id", "progress", "remaining"))
query(
    "f29_prompt_estimate",
    """SELECT candidates, (ceil(characters / 4) + candidates * 300)::BIGINT AS prompt_tokens, candidates * 500 AS completion_tokens, (ceil(characters / 4) + candidates * 800)::BIGINT AS total_tokens FROM (
        SELECT count(*) AS candidates, coalesce(sum(length(body_text)), 0)::BIGINT AS characters FROM <raw_emails> m LEFT JOIN <email_classifications> c ON c.email_id = m.id
        WHERE body_retention_state = 'retained' AND trim(body_text) <> '' AND (c.email_id IS NULL OR c.model <> 'model-1' OR c.prompt_version <> 'v2')) x""",
)(lambda j: status.prompt_estimate(status.candidate_stats(j.emails, j.classes, *_MODEL)).drop("cost_usd"))
query("x05_pending_bodies", "SELECT id, thread_id FROM <raw_emails> WHERE body_retention_state = 'metadata_only' AND id IN (SELECT id FROM <decided> WHERE outcome = 'candidate') ORDER BY id", _DECIDED)(
    lambda j: status.pending_bodies(j.emails, _decisions(j), "gmail")
)
query("x06_x07_newest_states", "SELECT id, provider, cursor, updated_at FROM <sync_states> QUALIFY row_number() OVER (PARTITION BY provider ORDER BY updated_at DESC, id DESC) = 1", _STATE)(
    lambda j: status.newest_state(j.view("sync_states", _STATE))
)
query(
    "p19_x35_readable",
    "SELECT id, CASE WHEN body_retention_state IN ('retained', 'debugging') THEN body_text END AS body_text, NOT (body_retention_state IN ('retained', 'debugging') AND body_text IS NOT NULL) AS must_fetch FROM <raw_emails>",
)(lambda j: status.readable(j.emails).select("id", "body_text", "must_fetch"))
query(
    "p20_shown_names",
    "SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'Unknown company' ELSE company END AS company, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'Role not available' ELSE role_title END AS role_title FROM <applications>",
)(
    lambda j: status.shown(
        j.apps.withColumns({"company": F.when(F.col("id").cast("long") % 2 == 0, "  ").otherwise(F.col("company")), "role_title": F.when(F.col("id").cast("long") % 3 != 0, F.col("role_title"))})
    ).select("id", "company", "role_title")
)
query(
    "x31_x33_sync_stats",
    "SELECT count(*) AS mails, count(*) FILTER (WHERE body_retention_state IN ('retained', 'debugging')) AS retained, (SELECT count(*) FROM <decided> WHERE outcome = 'candidate') AS candidates, min(sent_at) AS oldest, max(sent_at) AS newest FROM <raw_emails>",
    _DECIDED,
)(lambda j: status.sync_stats(j.emails, _decisions(j)))
query(
    "x36_pipeline_status",
    """SELECT (SELECT count(*) FROM <raw_emails>) AS raw_emails, (SELECT count(*) FROM <applications>) AS applications, u.candidates AS unclassified, CASE WHEN u.candidates > 0 THEN 'run_classification' ELSE 'review_dashboard' END AS next_action
       FROM (SELECT count(*) AS candidates FROM <raw_emails> m LEFT JOIN <email_classifications> c ON c.email_id = m.id
             WHERE body_retention_state = 'retained' AND trim(body_text) <> '' AND (c.email_id IS NULL OR c.model <> 'model-1' OR c.prompt_version <> 'v2')) u""",
)(
    lambda j: status.pipeline_status(
        status.stage_counts(j.emails, j.emails.select("id", F.lit("candidate").alias("outcome")), j.classes, j.apps, j.events),
        status.candidate_stats(j.emails, j.classes, *_MODEL),
        j.spark.createDataFrame([(True, False, False, False, "completed", None)], "connected boolean, reauth_required boolean, sync_running boolean, sync_failed boolean, backfill_state string, last_error string"),
    ).select("raw_emails", "applications", "unclassified", "next_action")
)
query("x30_normalized_terms", "SELECT DISTINCT lower(source) || '.example' AS term FROM <documents> WHERE source IS NOT NULL")(
    lambda j: status.normalized_terms(j.view("documents").where("source IS NOT NULL").select(F.concat(F.lit(" @"), F.upper("source"), F.lit(".Example. ")).alias("term")).union(j.spark.createDataFrame([(" ",), ("@",)], "term string")))
)


def _optional(j: JobSearch):
    """Counts of a table that the catalogue has and of one that it lacks."""
    j.view("documents").createOrReplaceTempView("trailmark_there")
    counted = [status.table_or_none(j.spark, f"trailmark_{name}", "doc_id long").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name in ("there", "missing")]
    return counted[0].unionByName(counted[1])


query("p21_optional_tables", "SELECT 'there' AS name, count(*) AS rows FROM <documents> UNION ALL SELECT 'missing', 0")(_optional)
