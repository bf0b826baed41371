"""Registered insight, extraction, question and relinkage queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import extraction, insights, questions, relinkage
from trailmark.plans.catalog import query
from trailmark.sources.testdata import JobSearch

_EVIDENCE = {
    "cited": """
        SELECT a.id AS application_id, a.role_title, a.current_status AS application_status, e.id AS event_id, e.email_id, e.event_type, e.event_at, coalesce(e.event_at, a.first_seen_at) AS "at", m.sent_at AS email_sent_at,
               CASE WHEN m.body_retention_state = 'retained' THEN m.body_text END AS email_body_text,
               'application:' || a.id || CASE WHEN e.id IS NULL THEN '' ELSE '|event:' || e.id END || CASE WHEN e.email_id IS NULL THEN '' ELSE '|email:' || e.email_id END AS citation_id
        FROM <applications> a LEFT JOIN <application_events> e ON e.application_id = a.id LEFT JOIN <raw_emails> m ON m.id = e.email_id
    """
}
_evidence = lambda j, kind: insights.scoped(kind, j.apps, j.events, j.emails)
_dated = lambda j: insights.dated_events(j.apps, j.events, insights.SCOPES["role_fit"])
query("l20_f18_evidence", "SELECT application_id, citation_id, event_type, email_body_text FROM <cited> WHERE event_type = 'rejection'", _EVIDENCE)(
    lambda j: _evidence(j, "why_rejected").select("application_id", "citation_id", "event_type", "email_body_text")
)
query(
    "l20_chosen_evidence",
    """SELECT citation_id, "at" FROM <cited> WHERE application_status IN ('applied', 'in_review', 'assessment', 'interview') ORDER BY "at" DESC, application_id, event_id NULLS FIRST LIMIT 100""",
    _EVIDENCE,
)(lambda j: insights.chosen("weekly_actions", _evidence(j, "weekly_actions")).select("citation_id", "at"))
query(
    "l21_story_window",
    "SELECT citation_id, event_at FROM <cited> WHERE coalesce(event_at, email_sent_at) >= (SELECT max(coalesce(event_at, email_sent_at)) - INTERVAL '366' DAY FROM <cited>)",
    _EVIDENCE,
)(lambda j: _evidence(j, "story").select("citation_id", "event_at"))
query("j10_t10_latest_insights", "SELECT type, id, content FROM <insights> WHERE NOT is_stale QUALIFY row_number() OVER (PARTITION BY type ORDER BY generated_at DESC, id DESC) = 1")(
    lambda j: insights.latest(j.view("insights")).select("type", "id", "content")
)
_WANTED = {"wanted_insights": "SELECT 'why_rejected' AS type, 'h0' AS inputs_hash, 'model-1' AS model UNION ALL SELECT 'story', NULL, NULL UNION ALL SELECT 'role_fit', 'h9', 'model-1' UNION ALL SELECT 'unheard_of', NULL, NULL UNION ALL SELECT 'skill_gaps', NULL, NULL"}
query(
    "v09_cached_insights",
    """SELECT type, status, CASE WHEN status = 'available' THEN content END AS content FROM (
        SELECT w.type, l.content, CASE WHEN l.id IS NULL THEN 'missing' WHEN coalesce(w.inputs_hash <> l.inputs_hash OR w.model <> l.model, false) OR l.is_stale THEN 'stale' ELSE 'available' END AS status
        FROM <wanted_insights> w LEFT JOIN (SELECT * FROM <insights> QUALIFY row_number() OVER (PARTITION BY type ORDER BY generated_at DESC, id DESC) = 1) l ON l.type = w.type) x""",
    _WANTED,
)(lambda j: insights.cached(j.view("insights"), j.view("wanted_insights", _WANTED)))
query(
    "k19_saved_insights",
    """SELECT id, type, content FROM <insights> WHERE type <> 'story' UNION ALL
       SELECT id, type, 'told anew' AS content FROM <insights> WHERE type = 'story' QUALIFY row_number() OVER (PARTITION BY type ORDER BY generated_at DESC, id DESC) = 1""",
)(lambda j: (lambda i: insights.saved(i, i.where("type = 'story'").limit(1).withColumns({"id": F.lit("new"), "content": F.lit("told anew")})).select("id", "type", "content"))(j.view("insights")))
query(
    "a30_role_outcomes",
    """SELECT role, sum(n)::BIGINT AS applications, coalesce(sum(n) FILTER (WHERE s IN ('interview', 'offer')), 0)::BIGINT AS wins, coalesce(sum(n) FILTER (WHERE s IN ('rejected', 'ghosted')), 0)::BIGINT AS losses,
              string_agg(s || '=' || n, ',' ORDER BY s) AS statuses FROM (SELECT trim(role_title) AS role, current_status AS s, count(*) AS n FROM <applications> WHERE trim(role_title) <> '' GROUP BY 1, 2) x GROUP BY 1""",
)(lambda j: insights.role_outcomes(_dated(j)))
query(
    "a30_role_citations",
    """SELECT trim(role_title) AS role, CAST(row_number() OVER (PARTITION BY trim(role_title) ORDER BY "at", application_id, event_id NULLS FIRST) AS INTEGER) AS place, citation_id FROM <cited> QUALIFY place <= 100""",
    _EVIDENCE,
)(lambda j: insights.cited_roles(_dated(j), j.emails))
query("l22_f11_cache_identity")(lambda j: insights.cache_identity("story", "v1", insights.role_outcomes(_dated(j)), _evidence(j, "story")))

#: Written insights of known shapes, with what may be cited.
_WRITTEN = {
    "written": """
        SELECT CAST(doc_id AS STRING) AS id, doc_id % 7 AS kind, CASE doc_id % 7
            WHEN 0 THEN '1. Ask for feedback [a:1]' || chr(10) || '2. Write to two teams [a:2, a:1]' || chr(10) || '3. Rest on Sunday [a:1; a:2]'
            WHEN 1 THEN '1. Ask [a:1]' || chr(10) || '2. Write [a:2]' WHEN 2 THEN '1. Ask [a:1]' || chr(10) || '2. Write [b:9]' || chr(10) || '3. Rest [a:1]'
            WHEN 3 THEN '1. Ask [a:1]' || chr(10) || '2. [a:2]' || chr(10) || '3. Rest [a:1]' WHEN 4 THEN 'Replies came late.' || chr(10) || '[a:1]' || chr(10) || 'Offers came later still [a:2].'
            WHEN 5 THEN 'Replies came late [a:1]. Offers came later still. Nobody knows why.' ELSE 'Nothing is cited here.' END AS content FROM <labels>"""
}
_allowed = lambda: F.array(F.lit("a:1"), F.lit("a:2"))
query("f19_action_problems", "SELECT id, CASE kind WHEN 0 THEN NULL WHEN 2 THEN 'a line is not numbered, cited and said' WHEN 3 THEN 'a line is not numbered, cited and said' WHEN 4 THEN 'a line is not numbered, cited and said' ELSE 'not three lines' END AS problem FROM <written>", _WRITTEN)(
    lambda j: j.view("written", _WRITTEN).select("id", insights.actions_problem(F.col("content"), _allowed()).alias("problem"))
)
query("f18_x20_grounding_problems", "SELECT id, CASE kind WHEN 2 THEN 'unknown_citation' WHEN 5 THEN 'uncited_claim' WHEN 6 THEN 'no_citation' END AS problem FROM <written>", _WRITTEN)(
    lambda j: j.view("written", _WRITTEN).select("id", insights.grounding_problem(F.col("content"), _allowed()).alias("problem"))
)
query(
    "q09_x42_ungrounded_claims",
    "SELECT id AS answer_id, 'c' AS claim, 'b:9' AS citation_id FROM <written> WHERE kind = 2 UNION ALL SELECT id, 'c', 'a:2' FROM <written> WHERE kind IN (0, 1, 3, 4) AND CAST(id AS BIGINT) % 2 = 0",
    _WRITTEN,
)(
    lambda j: (
        lambda w: questions.ungrounded(
            w.select(F.col("id").alias("answer_id"), F.lit("c").alias("claim"), insights.cited(F.col("content")).alias("citation_ids")),
            w.select(F.col("id").alias("answer_id"), F.explode(F.when(F.col("id").cast("long") % 2 == 0, F.array(F.lit("a:1"))).otherwise(_allowed())).alias("citation_id")),
        )
    )(j.view("written", _WRITTEN))
)

#: Raw model answers of known shapes; braces are written as chr(123) and chr(125).
_KIND = "doc_id % 12"
_ANSWERS = {
    "answers": f"""
        SELECT CAST(doc_id AS STRING) AS email_id, {_KIND} AS kind, CASE WHEN doc_id % 13 = 1 THEN 'length' ELSE 'stop' END AS finish_reason, 'model-1' AS model, 'v2' AS prompt_version, CAST('1998-01-01' AS {{TS}}) AS classified_at,
               doc_id % 100 AS prompt_tokens, 10 AS completion_tokens, 50 AS total_tokens,
               chr(123) || '"is_job_related": ' || CASE WHEN {_KIND} = 0 THEN 'false' ELSE 'true' END
               || ', "category": ' || CASE {_KIND} WHEN 0 THEN '"other"' WHEN 2 THEN '"rejection"' WHEN 9 THEN '"follow_up"' ELSE '"application_confirmation"' END || ', "confidence": 0.9'
               || ', "company": ' || CASE WHEN {_KIND} = 0 THEN 'null' ELSE '" Acme "' END || ', "role_title": ' || CASE WHEN {_KIND} = 0 THEN 'null' ELSE '"Engineer"' END
               || ', "application_status": ' || CASE {_KIND} WHEN 0 THEN 'null' WHEN 2 THEN '"rejected"' WHEN 5 THEN '"offer"' WHEN 9 THEN 'null' ELSE '"applied"' END
               || ', "event_type": ' || CASE {_KIND} WHEN 0 THEN 'null' WHEN 2 THEN '"rejection"' WHEN 9 THEN '"feedback"' ELSE '"applied"' END
               || ', "event_at": ' || CASE {_KIND} WHEN 0 THEN 'null' WHEN 1 THEN '"2024-03-01T10:00:00+02:00"' WHEN 11 THEN '"20240301"' ELSE '"2024-03-01"' END
               || ', "salary_min": ' || CASE {_KIND} WHEN 2 THEN '90000' WHEN 6 THEN '"90000"' WHEN 10 THEN '150000' ELSE 'null' END || ', "salary_max": ' || CASE {_KIND} WHEN 2 THEN '120000' WHEN 10 THEN '100000' ELSE 'null' END
               || ', "currency": null, "location": null, "work_mode": null, "seniority": null' || CASE WHEN {_KIND} = 8 THEN '' ELSE ', "sponsorship": "unknown"' END
               || ', "tech_stack": ' || CASE WHEN {_KIND} = 1 THEN '["sql", " go "]' ELSE '[]' END || CASE {_KIND} WHEN 4 THEN ', "company": "Beta"' WHEN 7 THEN ', "more": 1' ELSE '' END
               || ', "rejection_reason": null' || CASE WHEN {_KIND} = 3 THEN '' ELSE chr(125) END AS content FROM <labels>""",
    "answers_judged": """SELECT *, CASE WHEN finish_reason <> 'stop' THEN 'incomplete_generation' WHEN kind = 3 THEN 'invalid_json' WHEN kind = 4 THEN 'duplicate_json_key' WHEN kind IN (5, 6, 7, 8, 10, 11) THEN 'invalid_schema' END AS reason FROM <answers>""",
}
_answers = lambda j: j.view("answers", _ANSWERS)
query("l01_f20_quarantined", "SELECT email_id, model, reason FROM <answers_judged> WHERE reason IS NOT NULL", _ANSWERS)(lambda j: extraction.split(_answers(j)).malformed.select("email_id", "model", "reason"))
query(
    "l01_f21_f22_accepted",
    """SELECT email_id, kind <> 0 AS is_job_related, CASE kind WHEN 0 THEN 'other' WHEN 2 THEN 'rejection' WHEN 9 THEN 'follow_up' ELSE 'application_confirmation' END AS category, CASE WHEN kind <> 0 THEN 'Acme' END AS company,
              CASE kind WHEN 0 THEN NULL WHEN 2 THEN 'rejected' WHEN 9 THEN NULL ELSE 'applied' END AS status, CASE kind WHEN 0 THEN NULL WHEN 1 THEN CAST('2024-03-01 08:00:00' AS TIMESTAMP) ELSE CAST('2024-03-01' AS TIMESTAMP) END AS event_at,
              CASE WHEN kind = 2 THEN 90000 END AS salary_min, CASE WHEN kind = 1 THEN 'sql|go' ELSE '' END AS skills FROM <answers_judged> WHERE reason IS NULL""",
    _ANSWERS,
)(lambda j: extraction.split(_answers(j)).accepted.select("email_id", "is_job_related", "category", "company", "status", "event_at", "salary_min", F.array_join("tech_stack", "|").alias("skills")))
query(
    "l01_x22_run_record",
    """SELECT count(*) AS candidates, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason = 'incomplete_generation') AS incomplete_generation, count(*) FILTER (WHERE reason = 'invalid_json') AS invalid_json,
              count(*) FILTER (WHERE reason = 'duplicate_json_key') AS duplicate_json_key, count(*) FILTER (WHERE reason = 'invalid_schema') AS invalid_schema, sum(greatest(total_tokens, prompt_tokens + completion_tokens))::BIGINT AS tokens FROM <answers_judged>""",
    _ANSWERS,
)(lambda j: extraction.run_record(_answers(j)))

#: Questions of known kinds.
_ASKED = {
    "asked": """
        SELECT event_id AS id, event_id % 8 AS kind, CASE event_id % 8 WHEN 0 THEN 'Show applications with a salary between $90k and 120,000 in 1997' WHEN 1 THEN 'List 15 companies from last month'
            WHEN 2 THEN 'Applications of the past 45 days with salary at least 80k' WHEN 3 THEN 'Which emails from every rejection mentioned "visa"?' WHEN 4 THEN 'Name every company that mentioned relocation.'
            WHEN 5 THEN 'What was the latest email from Customer#000000001?' WHEN 6 THEN 'salary under £95.5k this week' ELSE 'salary 90k to 80k' END AS question FROM <events>"""
}
query(
    "f24_q05_question_facets",
    """SELECT id, CASE kind WHEN 0 THEN 'calendar_year' WHEN 1 THEN 'last_month' WHEN 2 THEN 'rolling_days' WHEN 6 THEN 'this_week' END AS window_kind, CASE WHEN kind = 2 THEN 45 END AS window_days, CASE WHEN kind = 0 THEN 1997 END AS window_year,
              CASE kind WHEN 0 THEN 90000 WHEN 2 THEN 80000 END AS salary_min, CASE kind WHEN 0 THEN 120000 WHEN 6 THEN 95500 END AS salary_max,
              CASE kind WHEN 1 THEN 15 WHEN 2 THEN 45 WHEN 0 THEN 100 WHEN 6 THEN 95 ELSE 20 END AS list_limit FROM <asked>""",
    _ASKED,
)(lambda j: questions.facets(j.view("asked", _ASKED)).select("id", "window_kind", "window_days", "window_year", "salary_min", "salary_max", "list_limit"))
query(
    "v07_retrieval_modes",
    """SELECT id, CASE kind WHEN 3 THEN 'exhaustive_mentions' WHEN 4 THEN 'exhaustive_companies' WHEN 5 THEN 'latest_company_email' ELSE 'semantic' END AS mode, CASE kind WHEN 3 THEN 'visa' WHEN 4 THEN 'relocation' END AS term,
              CASE WHEN kind = 3 THEN 'rejection' END AS category FROM <asked>""",
    _ASKED,
)(lambda j: questions.retrieval_modes(j.view("asked", _ASKED)).select("id", "mode", "term", "category"))
_SAID = {
    "said": """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'mail from CUSTOMER#000000001, again' WHEN 1 THEN 'Customer#0000000012 and xCustomer#000000002' WHEN 2 THEN text ELSE 'about Customer#000000002 and customer#000000003.' END AS said FROM <documents>"""
}
query(
    "p13_mentioned_companies",
    """SELECT id, 'Customer#000000001' AS company FROM <said> WHERE id % 4 = 0 AND EXISTS (SELECT 1 FROM <applications> WHERE company = 'Customer#000000001')
       UNION ALL SELECT id, company FROM <said> JOIN (SELECT DISTINCT company FROM <applications> WHERE company IN ('Customer#000000002', 'Customer#000000003')) c ON id % 4 = 3""",
    _SAID,
)(lambda j: questions.mentioned_companies(j.view("said", _SAID), j.apps, "id", "said"))
_TALK = {
    "talk": """SELECT CAST(conv_id AS STRING) AS conversation_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
                      CASE WHEN turn % 2 = 1 THEN 'an answer' WHEN turn % 4 = 2 THEN 'and those of ' || CAST(turn AS STRING) ELSE 'question ' || CAST(turn AS STRING) END AS content FROM (SELECT DISTINCT conv_id, turn FROM <conversations>) c"""
}
query(
    "l25_questions_in_context",
    """SELECT u.conversation_id, u.turn, CASE WHEN u.turn % 4 = 2 AND p.turn IS NOT NULL THEN 'Previous user question: ' || p.content || chr(10) || 'Current user question: ' || u.content ELSE u.content END AS question
       FROM <talk> u LEFT JOIN <talk> p ON p.conversation_id = u.conversation_id AND p.turn = u.turn - 2 WHERE u.role = 'user'""",
    _TALK,
)(lambda j: questions.with_context(j.view("talk", _TALK)))

#: Mails told anew: some with the same event, some with another, some without any; and events edited by hand.
_ANEW = {
    "anew": """SELECT DISTINCT email_id, CASE CAST(email_id AS BIGINT) % 4 WHEN 0 THEN first_id WHEN 1 THEN first_id || '-new' ELSE NULL END AS event_id,
                      CASE CAST(email_id AS BIGINT) % 4 WHEN 0 THEN first_app WHEN 1 THEN first_app ELSE NULL END AS application_id
               FROM (SELECT email_id, min(id) AS first_id, min(application_id) AS first_app FROM <application_events> WHERE email_id IS NOT NULL GROUP BY 1) x WHERE CAST(email_id AS BIGINT) % 3 = 0""",
    "edited_ids": "SELECT DISTINCT id AS event_id FROM <application_events> WHERE right(id, 1) = '5'",
}


def _edits(j: JobSearch):
    return j.view("edited_ids", _ANEW).select(F.lit("event_edit").alias("correction_type"), F.to_json(F.struct(F.struct(F.col("event_id").alias("id")).alias("event"))).alias("before_json"))


query(
    "l10_stale_events",
    """SELECT e.id, e.application_id, e.email_id, CASE WHEN a.manual_lock AND n.application_id = e.application_id THEN 'keep' WHEN a.manual_lock OR e.id IN (SELECT event_id FROM <edited_ids>) THEN 'manual_conflict' ELSE 'delete' END AS action
       FROM <application_events> e JOIN <anew> n ON n.email_id = e.email_id LEFT JOIN <applications> a ON a.id = e.application_id WHERE n.event_id IS NULL OR n.event_id <> e.id""",
    _ANEW,
)(lambda j: relinkage.stale_events(j.events, j.view("anew", _ANEW), j.apps, _edits(j)))
query(
    "l10_refreshed_sources",
    """SELECT a.id, min(e.event_at) AS first_seen_at, max(e.event_at) AS last_activity_at FROM <applications> a JOIN <application_events> e ON e.application_id = a.id
       WHERE NOT a.manual_lock AND CAST(a.id AS BIGINT) % 4 = 0 AND e.event_type <> 'offer' GROUP BY 1
       UNION ALL SELECT id, first_seen_at, last_activity_at FROM <applications> WHERE manual_lock OR CAST(id AS BIGINT) % 4 <> 0""",
)(lambda j: relinkage.refreshed(j.apps, j.events.where("event_type <> 'offer'"), j.emails, j.classes, j.apps.where(F.col("id").cast("long") % 4 == 0)).select("id", "first_seen_at", "last_activity_at"))
query(
    "l07_existing_attempts",
    """SELECT company_key, thread, email_count, status FROM (
           SELECT DISTINCT a.id, lower(replace(a.company, '#', ' ')) AS company_key, m.thread_id AS thread, a.current_status AS status, (SELECT count(DISTINCT email_id) FROM <application_events> x WHERE x.application_id = a.id) AS email_count
           FROM <applications> a JOIN <application_events> e ON e.application_id = a.id JOIN <raw_emails> m ON m.id = e.email_id WHERE m.thread_id IS NOT NULL
           UNION ALL SELECT a.id, lower(replace(a.company, '#', ' ')), NULL, a.current_status, (SELECT count(DISTINCT email_id) FROM <application_events> x WHERE x.application_id = a.id) FROM <applications> a) y""",
)(
    lambda j: relinkage.existing_attempts(j.apps, j.events, relinkage.application_threads(j.events, j.emails)).select("company_key", "thread", F.size("email_ids").cast("long").alias("email_count"), "status")
)
