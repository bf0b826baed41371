"""Registered list, window and retrieval queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark import schema
from trailmark.operators import lists, retrieval
from trailmark.operators.filters import submitted
from trailmark.plans.catalog import query
from trailmark.plans.metric_queries import VIEWS
from trailmark.sources.testdata import CLOCK, JobSearch

_TS = lambda s: f"CAST('{s}' AS TIMESTAMP)"
_WEEK_AGO, _ACTIVE = "1998-08-25 12:00:00", "1997-09-01 12:00:00"
TERM = "and"

query("t01_application_list", "SELECT id, company, role_title, first_seen_at FROM <submitted> ORDER BY first_seen_at DESC, lower(company), lower(role_title), id LIMIT 20", VIEWS)(
    lambda j: lists.application_list(submitted(j.apps, j.events, j.classes)).select("id", "company", "role_title", "first_seen_at")
)
query("t02_all_applications", "SELECT id, first_seen_at FROM <applications> ORDER BY first_seen_at DESC, id")(lambda j: j.apps.orderBy(F.desc("first_seen_at"), "id").select("id", "first_seen_at"))
query(
    "t04_recent_previews",
    """SELECT id, sent_at, nullif(lower(regexp_extract(from_addr, '@([^@\\s<>]+?)[>.]*$', 1)), '') AS from_domain, 'home.example' AS to_domains, trim(coalesce(subject, '')) <> '' AS subject_present,
       body_retention_state IN ('retained', 'debugging') AND body_text IS NOT NULL AS has_retained_body FROM <raw_emails> ORDER BY sent_at DESC, id DESC LIMIT 20""",
)(lambda j: lists.recent_previews(j.emails))
query(
    "t05_page",
    f"""SELECT id, sent_at, (SELECT CAST(ceil(count(*) / 25) AS BIGINT) FROM <raw_emails> WHERE sent_at >= {_TS('1998-01-02')} AND sent_at < {_TS('1998-02-01')}) AS total_pages FROM <raw_emails>
        WHERE sent_at >= {_TS('1998-01-02')} AND sent_at < {_TS('1998-02-01')} ORDER BY sent_at DESC, id DESC LIMIT 25 OFFSET 50""",
)(lambda j: lists.page(j.emails, "1998-01-02", "1998-02-01", 3, 25))
query(
    "t06_recent_events",
    "SELECT e.application_id, a.company, a.role_title, e.id, e.event_type, e.event_at FROM (SELECT * FROM <application_events> ORDER BY event_at DESC, id DESC LIMIT 20) e JOIN <applications> a ON a.id = e.application_id",
)(lambda j: lists.recent_events(j.events, j.apps))
query(
    "t07_timeline",
    """SELECT e.id, e.event_type, e.event_at, m.sent_at, c.classified_at FROM <application_events> e LEFT JOIN <raw_emails> m ON m.id = e.email_id
       LEFT JOIN <email_classifications> c ON c.email_id = e.email_id WHERE e.application_id = '1'""",
)(lambda j: lists.timeline(j.events, j.emails, j.classes, "1"))
query(
    "t08_p09_candidates",
    """SELECT m.id, m.sent_at FROM <raw_emails> m LEFT JOIN <email_classifications> c ON c.email_id = m.id WHERE m.body_retention_state = 'retained' AND trim(m.body_text) <> ''
       AND (c.email_id IS NULL OR c.model <> 'model-1' OR c.prompt_version <> 'v2') ORDER BY m.sent_at, m.id LIMIT 500""",
)(lambda j: lists.candidates_to_classify(j.emails, j.classes, "model-1", "v2", 500).select("id", "sent_at"))
query("w05_latest_event", "SELECT application_id, event_at, id, event_type, email_id FROM <application_events> QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY event_at DESC, id DESC) = 1")(
    lambda j: lists.latest_event(j.events)
)
_STATES = f"""
    SELECT l.application_id, l.event_at AS latest_event_at, l.event_type AS latest_event_type,
           CASE WHEN l.email_id IS NULL THEN 'unknown' WHEN m.labels IS NOT NULL AND len([x FOR x IN m.labels IF upper(trim(x)) = 'SENT']) > 0 THEN 'outbound' ELSE 'inbound' END AS latest_direction,
           EXISTS (SELECT 1 FROM <application_events> f WHERE f.application_id = l.application_id AND f.event_type = 'interview_scheduled' AND f.event_at > {_TS(CLOCK)}) AS has_future_interview
    FROM (SELECT * FROM <application_events> QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY event_at DESC, id DESC) = 1) l LEFT JOIN <raw_emails> m ON m.id = l.email_id
"""
query("l18_follow_up_states", _STATES)(lambda j: lists.follow_up_states(j.events, j.emails, CLOCK))
query(
    "l19_live_applications",
    f"""SELECT id, company, current_status, days AS days_waiting, days >= {schema.FOLLOW_UP_DAYS} AND coalesce(latest_direction, 'unknown') <> 'inbound' AS follow_up_due FROM (
        SELECT a.*, s.latest_direction, greatest(0, CAST(floor(date_diff('second', coalesce(s.latest_event_at, a.last_activity_at), {_TS(CLOCK)}) / 86400) AS BIGINT)) AS days
        FROM <applications> a LEFT JOIN <states> s ON s.application_id = a.id WHERE a.current_status IN ('applied', 'in_review', 'interview') AND NOT coalesce(s.has_future_interview, false)) x""",
    {"states": _STATES},
)(lambda j: lists.live_applications(j.apps, lists.follow_up_states(j.events, j.emails, CLOCK), CLOCK))
#: Completed interview tasks, for the lists: every third interview event by line number and part.
_DONE = "SELECT id AS interview_event_id, event_at + INTERVAL '1' DAY AS completed_at FROM <application_events> WHERE event_type = 'interview_scheduled' AND substring(id, length(id), 1) IN ('1', '4', '7')"
_INTERVIEWS = """
    SELECT a.*, e.id AS interview_event_id, e.event_at AS interview_at, d.completed_at FROM <applications> a JOIN <application_events> e ON e.application_id = a.id AND e.event_type = 'interview_scheduled'
    LEFT JOIN <done> d ON d.interview_event_id = e.id WHERE trim(a.company) <> ''
    QUALIFY row_number() OVER (PARTITION BY lower(trim(a.company)) ORDER BY e.event_at DESC, e.id DESC, a.id DESC) = 1
"""


def _attention(j: JobSearch, which: str):
    e = j.events
    done = e.where("event_type = 'interview_scheduled' AND substring(id, length(id), 1) IN ('1', '4', '7')").select(F.col("id").alias("interview_event_id"), (F.col("event_at") + F.expr("INTERVAL '1' DAY")).alias("completed_at"))
    return lists.attention(lists.latest_interviews(j.apps, e, done), e, _ACTIVE, _WEEK_AGO)[which].select("id", "company", "interview_event_id", "interview_at", "completed_at")


_PICK = "SELECT id, company, interview_event_id, interview_at, completed_at FROM <interviews>"
for _name, _which, _where in (
    ("t09_w04_interviewed", "interviewed", "true"),
    ("t09_prepare", "prepare", f"current_status = 'interview' AND completed_at IS NULL AND interview_at >= {_TS(_ACTIVE)}"),
    (
        "t09_l23_follow_up",
        "follow_up",
        f"""current_status = 'interview' AND completed_at IS NOT NULL AND interview_at >= {_TS(_ACTIVE)} AND interview_at <= {_TS(_WEEK_AGO)} AND NOT EXISTS (SELECT 1 FROM <application_events> l
            WHERE l.application_id = interviews.id AND l.event_at > interviews.interview_at AND l.event_type IN ('response', 'assessment', 'feedback', 'rejection', 'offer', 'interview_scheduled'))""",
    ),
):
    query(_name, f"{_PICK} WHERE {_where}", {"done": _DONE, "interviews": _INTERVIEWS})(lambda j, w=_which: _attention(j, w))
query("w07_latest_messages", "SELECT * FROM (SELECT * FROM <chat_messages> WHERE conversation_id = '3' ORDER BY turn DESC LIMIT 4) x ORDER BY turn")(lambda j: lists.latest_messages(j.chat, "3", 4))
query(
    "w08_l11_status_fold",
    """SELECT application_id, last(status ORDER BY n) AS status FROM (
        WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY event_at, email_sent_at, classified_at, id) AS n FROM <ordered_with_status>),
        f(application_id, n, status) AS (
            SELECT application_id, CAST(0 AS BIGINT), 'applied' FROM e GROUP BY 1
            UNION ALL
            SELECT f.application_id, f.n + 1, CASE WHEN e.s IS NULL OR (e.event_type = 'response' AND f.status NOT IN ('applied', 'in_review', 'ghosted')) THEN f.status ELSE e.s END
            FROM f JOIN e ON e.application_id = f.application_id AND e.n = f.n + 1)
        SELECT * FROM f) x GROUP BY 1""",
    VIEWS
    | {
        "ordered_with_status": """
            SELECT o.*, CASE o.event_type WHEN 'applied' THEN 'applied' WHEN 'response' THEN 'in_review' WHEN 'assessment' THEN 'assessment' WHEN 'interview_scheduled' THEN 'interview'
                   WHEN 'feedback' THEN e.extracted_status WHEN 'rejection' THEN 'rejected' WHEN 'offer' THEN 'offer' ELSE 'ghosted' END AS s
            FROM <ordered> o JOIN <application_events> e ON e.id = o.id
        """
    },
)(lambda j: lists.derive_status(j.events, j.emails, j.classes))


def _vector(j: JobSearch) -> list[float]:
    return j.view("embeddings").where("vec_id = 0").first()["embedding"]


_KNN = """SELECT email_id, chunk_index, sqrt(list_sum([pow(CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE), 2) FOR i IN range(1, len(q) + 1)])) AS d
    FROM <email_chunks>, (SELECT embedding AS q FROM <embeddings> WHERE vec_id = 0) v ORDER BY d, email_id, chunk_index LIMIT 10"""
_found = lambda df: df.select("email_id", "chunk_index", F.round("distance", 6).alias("distance"))
query("v01_nearest_chunks", f"SELECT email_id, chunk_index, round(d, 6) AS distance FROM ({_KNN}) x")(lambda j: _found(retrieval.nearest(j.chunks, _vector(j), 10)))
query("v02_nearest_within", f"SELECT email_id, chunk_index, round(d, 6) AS distance FROM ({_KNN}) x WHERE d <= {schema.MAX_DISTANCE}")(lambda j: _found(retrieval.nearest(j.chunks, _vector(j), 10, schema.MAX_DISTANCE)))
query("f25_padding", "SELECT email_id, chunk_index, CAST(100 AS INTEGER) AS dimensions, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 4) AS total FROM <email_chunks>")(
    lambda j: j.chunks.withColumn("p", retrieval.padded(F.col("embedding"), 100)).select("email_id", "chunk_index", F.size("p").alias("dimensions"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
)
_HITS = f"SELECT email_id, chunk_index, content FROM <email_chunks> WHERE instr(lower(content), lower('{TERM}')) > 0 QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY chunk_index) = 1"
query(
    "v03_w01_mentions",
    "SELECT h.email_id, h.chunk_index, m.sent_at FROM <hits> h JOIN <email_classifications> c ON c.email_id = h.email_id JOIN <raw_emails> m ON m.id = h.email_id WHERE c.category = 'offer'",
    {"hits": _HITS},
)(lambda j: retrieval.mentions(j.chunks, j.emails, j.classes, TERM, "offer").select("email_id", "chunk_index", "sent_at"))
_THREADS = "SELECT DISTINCT m.provider, m.thread_id, e.application_id FROM <application_events> e JOIN <raw_emails> m ON m.id = e.email_id WHERE m.thread_id IS NOT NULL AND length(trim(m.thread_id)) > 0"
_AS_OF = "CASE WHEN a.first_seen_at <= m.sent_at THEN 0 ELSE 1 END, CASE WHEN a.first_seen_at <= m.sent_at THEN a.first_seen_at END DESC NULLS LAST, CASE WHEN a.first_seen_at > m.sent_at THEN a.first_seen_at END, a.last_activity_at DESC, a.id"
query(
    "v04_w02_w03_companies_mentioning",
    f"""SELECT application_id, company, email_id, chunk_index, sent_at FROM (
        SELECT DISTINCT a.id AS application_id, a.company, h.email_id, h.chunk_index, m.sent_at FROM <hits> h JOIN <raw_emails> m ON m.id = h.email_id JOIN <application_events> e ON e.email_id = h.email_id JOIN <applications> a ON a.id = e.application_id
        UNION
        SELECT application_id, company, email_id, chunk_index, sent_at FROM (
            SELECT a.id AS application_id, a.company, h.email_id, h.chunk_index, m.sent_at, row_number() OVER (PARTITION BY h.email_id, lower(trim(a.company)) ORDER BY {_AS_OF}) AS r
            FROM <hits> h JOIN <raw_emails> m ON m.id = h.email_id JOIN <threads> t ON t.provider = m.provider AND t.thread_id = m.thread_id JOIN <applications> a ON a.id = t.application_id
            WHERE h.email_id NOT IN (SELECT email_id FROM <application_events> WHERE email_id IS NOT NULL)) y WHERE r = 1) x
        QUALIFY row_number() OVER (PARTITION BY lower(trim(company)) ORDER BY sent_at DESC, chunk_index, email_id, application_id) = 1""",
    {"hits": _HITS, "threads": _THREADS},
)(lambda j: retrieval.companies_mentioning(j.chunks, j.emails, j.events, j.apps, TERM))
query(
    "v05_t11_latest_company_email",
    """SELECT m.id AS email_id, x.application_id, m.sent_at, m.body_text FROM (
        SELECT e.email_id, e.application_id FROM <application_events> e JOIN <applications> a ON a.id = e.application_id WHERE a.company IN ('Customer#000000001', 'Customer#000000004') AND e.email_id IS NOT NULL
        UNION SELECT m.id, t.application_id FROM <raw_emails> m JOIN <threads> t ON t.provider = m.provider AND t.thread_id = m.thread_id JOIN <applications> a ON a.id = t.application_id WHERE a.company IN ('Customer#000000001', 'Customer#000000004')) x
       JOIN <raw_emails> m ON m.id = x.email_id JOIN <applications> a ON a.id = x.application_id
       WHERE m.id IN (SELECT email_id FROM <email_chunks>) AND len([l FOR l IN m.labels IF upper(trim(l)) = 'SENT']) = 0 AND lower(trim(m.from_addr)) <> 'hr@src1.example'
       ORDER BY m.sent_at DESC, a.last_activity_at DESC, m.id, x.application_id LIMIT 1""",
    {"threads": _THREADS},
)(lambda j: retrieval.latest_company_email(j.chunks, j.emails, j.events, j.apps, ["Customer#000000001", "Customer#000000004"], ["hr@src1.example"]))
query(
    "v06_j09_linked_applications",
    f"""SELECT h.email_id, e.application_id FROM <hits> h JOIN (SELECT DISTINCT email_id, application_id FROM <application_events>) e ON e.email_id = h.email_id
        UNION ALL SELECT email_id, id FROM (SELECT h.email_id, a.id, row_number() OVER (PARTITION BY h.email_id ORDER BY {_AS_OF}) AS r FROM <hits> h JOIN <raw_emails> m ON m.id = h.email_id
            JOIN <threads> t ON t.provider = m.provider AND t.thread_id = m.thread_id JOIN <applications> a ON a.id = t.application_id
            WHERE h.email_id NOT IN (SELECT email_id FROM <application_events> WHERE email_id IS NOT NULL)) x WHERE r = 1""",
    {"hits": _HITS, "threads": _THREADS},
)(lambda j: retrieval.linked_applications(retrieval.first_mention(j.chunks, TERM), j.emails, j.events, j.apps))
query("k17_content_hash", "SELECT email_id, sha256(string_agg(content, chr(10) ORDER BY chunk_index)) AS content_hash FROM <email_chunks> GROUP BY 1")(lambda j: retrieval.content_hash(j.chunks))
query(
    "v08_reconcile",
    """SELECT coalesce(w.email_id, s.email_id) AS email_id, CASE WHEN w.email_id IS NULL THEN 'delete' WHEN w.h = s.h AND s.model = 'embed-2' THEN 'keep' ELSE 'embed' END AS action
       FROM (SELECT email_id, sha256(string_agg(content, chr(10) ORDER BY chunk_index)) AS h FROM <email_chunks> WHERE right(email_id, 1) <> '3' GROUP BY 1) w
       FULL JOIN (SELECT email_id, sha256(string_agg(content, chr(10) ORDER BY chunk_index)) AS h, CASE WHEN right(email_id, 1) = '5' THEN 'embed-1' ELSE 'embed-2' END AS model FROM <email_chunks>
                  WHERE right(email_id, 1) <> '7' GROUP BY 1) s ON s.email_id = w.email_id""",
)(
    lambda j: retrieval.reconcile(
        retrieval.content_hash(j.chunks.where("right(email_id, 1) <> '3'")),
        retrieval.content_hash(j.chunks.where("right(email_id, 1) <> '7'")).select("email_id", "content_hash", F.lit("fake").alias("provider"), F.when(F.col("email_id").endswith("5"), "embed-1").otherwise("embed-2").alias("model")),
        "fake",
        "embed-2",
    )
)
query(
    "p10_eligible_mails",
    "SELECT m.id FROM <raw_emails> m WHERE m.body_retention_state = 'retained' AND trim(m.body_text) <> '' AND m.id IN (SELECT email_id FROM <email_classifications> WHERE is_job_related)",
)(lambda j: retrieval.eligible(j.emails, j.classes).select("id"))
query(
    "j15_applications_of_threads",
    "SELECT DISTINCT m.provider, m.thread_id, a.id AS application_id, a.company FROM <applications> a JOIN <application_events> e ON e.application_id = a.id JOIN <raw_emails> m ON m.id = e.email_id WHERE m.thread_id IS NOT NULL AND length(trim(m.thread_id)) > 0",
)(lambda j: retrieval.applications_of_threads(j.apps, j.events, j.emails).select("provider", "thread_id", "application_id", "company"))
