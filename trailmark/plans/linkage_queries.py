"""Registered text, linkage and ghost queries with their oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark import schema
from trailmark.functions import text
from trailmark.functions.redaction import redacted_records
from trailmark.operators import linkage
from trailmark.operators.filters import not_submitted
from trailmark.operators.features import features
from trailmark.plans.catalog import query
from trailmark.plans.metric_queries import VIEWS as METRIC_VIEWS
from trailmark.sources.testdata import CLOCK, JobSearch

_L = "('application_confirmation', 'assessment', 'interview_invite', 'rejection', 'offer')"
VIEWS = {
    "evidence": f"SELECT * FROM <extractions> WHERE category IN {_L} OR (category IN ('follow_up', 'other') AND event_type IN ('feedback', 'response'))",
    "anchored": """
        SELECT * FROM <evidence> x WHERE coalesce(event_type, '') NOT IN ('feedback', 'response')
           OR thread_id IN (SELECT thread_id FROM <evidence> WHERE thread_id IS NOT NULL AND coalesce(event_type, '') NOT IN ('feedback', 'response'))
    """,
    "resolved": """SELECT *, coalesce(event_type, CASE status WHEN 'in_review' THEN 'response' END, 'applied') AS event, coalesce(event_at, sent_at, classified_at) AS "at" FROM <anchored>""",
    "keyed": """
        SELECT *, nullif(replace(replace(lower(company), ', inc.', ''), '  ', ' '), '') AS company_key, lower(role_title) AS role_key, thread_id AS thread,
               CASE WHEN thread_id IS NULL THEN CAST(DATE '0001-01-01' + CAST(greatest(1, ((date_diff('day', DATE '0001-01-01', CAST("at" AS DATE)) + 1) // 30) * 30) - 1 AS INTEGER) AS DATE) END AS bucket
        FROM <resolved>
    """,
}


def _resolved(j: JobSearch):
    none = j.spark.createDataFrame([], "thread_id string")
    return linkage.resolved(linkage.anchored(linkage.evidence(j.extractions), none))


_plain = lambda df, *c: df.select(*[F.col(x).cast("string") if x == "bucket" else F.col(x) for x in c])
query("l02_evidence", "SELECT email_id, category, event_type FROM <evidence>", VIEWS)(lambda j: linkage.evidence(j.extractions).select("email_id", "category", "event_type"))
query("l03_anchored", "SELECT email_id, thread_id FROM <anchored>", VIEWS)(lambda j: linkage.anchored(linkage.evidence(j.extractions), j.spark.createDataFrame([], "thread_id string")).select("email_id", "thread_id"))
query("l04_resolved_events", 'SELECT email_id, event, "at" FROM <resolved>', VIEWS)(lambda j: _resolved(j).select("email_id", "event", "at"))
query("l06_f08_grouping_keys", "SELECT email_id, company_key, role_key, thread, CAST(bucket AS VARCHAR) AS bucket FROM <keyed>", VIEWS)(
    lambda j: _plain(linkage.keyed(_resolved(j)), "email_id", "company_key", "role_key", "thread", "bucket")
)
_ROLLED = """
    SELECT company_key, role_key, thread, CAST(bucket AS VARCHAR) AS bucket, count(*) AS mails, min("at") AS first_seen_at, max("at") AS last_activity_at, min(salary_min) AS salary_min, max(salary_max) AS salary_max,
           first(currency ORDER BY seq) FILTER (WHERE currency IS NOT NULL) AS currency, first(work_mode ORDER BY seq) FILTER (WHERE work_mode IS NOT NULL) AS work_mode,
           coalesce(first(sponsorship ORDER BY seq) FILTER (WHERE sponsorship <> 'unknown'), 'unknown') AS sponsorship, coalesce(first(source ORDER BY seq) FILTER (WHERE source <> 'other'), 'other') AS source
    FROM <keyed> GROUP BY 1, 2, 3, 4
"""
query("l08_roll_up", _ROLLED, VIEWS)(
    lambda j: _plain(linkage.roll_up(linkage.keyed(_resolved(j)), linkage.GROUP), *linkage.GROUP, "mails", "first_seen_at", "last_activity_at", "salary_min", "salary_max", "currency", "work_mode", "sponsorship", "source")
)
query("l05_l07_l09_linked_applications")(lambda j: linkage.link(j.extractions)[0])
query("l09_linked_events")(lambda j: linkage.link(j.extractions)[1].select("event_id", "application_id", "email_id", "event", "at", "attempt_started_at"))
query("f01_company_keys", "SELECT id, lower(replace(company, '#', ' ')) AS company_key FROM <applications>")(lambda j: j.apps.select("id", text.normalized_company("company").alias("company_key")))
query(
    "f02_role_keys",
    "SELECT id, trim(regexp_replace(lower(regexp_replace(role_title, '^[0-9]-', '')), '(not specified|[a-z]+) engineer', '\\1 engineer')) AS role_key FROM <applications>",
)(lambda j: j.apps.select("id", text.normalized_role("role_title").alias("role_key")))
query("f14_page_text")(lambda j: j.view("pages").select("page_id", text.page_text("html").alias("body")))
#: The fold over paragraphs, a step each: what is closed, and the chunk that is still open.
_WINDOWS = f"list_filter([regexp_replace(substring(long, k * {schema.CHUNK_CHARS - schema.CHUNK_OVERLAP} + 1, {schema.CHUNK_CHARS}), '^\\s+|\\s+$', '', 'g') FOR k IN range(0, CAST(floor(greatest(0, length(long) - {schema.CHUNK_OVERLAP} - 1) / {schema.CHUNK_CHARS - schema.CHUNK_OVERLAP}) AS BIGINT) + 1)], lambda x: x <> '')"
_CHUNKED = f"""
    SELECT email_id, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_index, unnest(c) AS content FROM (
        WITH RECURSIVE p AS (
            SELECT id AS email_id, list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(regexp_replace(body_text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10) || chr(10))], lambda x: x <> '') AS ps
            FROM <raw_emails> WHERE trim(body_text) <> ''
        ), f(email_id, i, done, held) AS (
            SELECT email_id, 0, CAST([] AS VARCHAR[]), '' FROM p
            UNION ALL
            SELECT email_id, i + 1,
                   CASE WHEN kind = 'long' THEN done || (CASE WHEN held = '' THEN CAST([] AS VARCHAR[]) ELSE [held] END) || {_WINDOWS} WHEN kind = 'windows' THEN done || [held] || {_WINDOWS} WHEN kind = 'new' THEN done || [held] ELSE done END,
                   CASE kind WHEN 'long' THEN '' WHEN 'first' THEN x WHEN 'more' THEN held || chr(10) || chr(10) || x WHEN 'windows' THEN '' ELSE opened END
            FROM (SELECT *, CASE WHEN length(x) > {schema.CHUNK_CHARS} THEN 'long' WHEN held = '' THEN 'first' WHEN length(held) + 2 + length(x) <= {schema.CHUNK_CHARS} THEN 'more' WHEN length(opened) > {schema.CHUNK_CHARS} THEN 'windows' ELSE 'new' END AS kind,
                         CASE WHEN length(x) > {schema.CHUNK_CHARS} THEN x ELSE opened END AS long
                  FROM (SELECT f.email_id, i, done, held, ps[i + 1] AS x, right(held, {schema.CHUNK_OVERLAP}) || chr(10) || chr(10) || ps[i + 1] AS opened FROM f JOIN p ON p.email_id = f.email_id WHERE i < len(ps)) y) z
        )
        SELECT f.email_id, done || (CASE WHEN held = '' THEN CAST([] AS VARCHAR[]) ELSE [held] END) AS c FROM f JOIN p ON p.email_id = f.email_id WHERE i = len(ps)) w"""
query("f15_chunks", _CHUNKED)(lambda j: text.chunked(j.emails))
#: The same of pages of paragraphs of many lengths: empty ones, and longer ones than a chunk.
_PARAGRAPHS = {
    "raw_pages": """SELECT CAST(doc_id AS STRING) AS id, repeat(substring(text, 1, CAST(1 + doc_id % 900 AS INT)), CAST(1 + doc_id % 3 AS INT)) || chr(10) || chr(10) || '  ' || chr(13) || chr(10) || chr(13) || chr(10) || substring(text, 7, CAST(doc_id % 1300 AS INT))
                           || chr(10) || chr(10) || repeat(CAST(doc_id AS STRING) || ' é' || chr(10), CAST(doc_id % 70 AS INT)) || chr(10) || chr(10) || 'end ' AS body_text FROM <documents> WHERE length(text) > 0"""
}
query("f15_chunked_paragraphs", _CHUNKED.replace("<raw_emails>", "<raw_pages>"), _PARAGRAPHS)(lambda j: text.chunked(j.view("raw_pages", _PARAGRAPHS)))
#: Texts with each kind of secret or mail content, and named hard cases of company and role keys.
_SECRETS = {
    "secrets": """SELECT doc_id AS id, doc_id % 10 AS kind, CASE doc_id % 10 WHEN 0 THEN 'Authorization: Bearer abc.def' WHEN 1 THEN 'sent bearer xyz9, ok' WHEN 2 THEN 'api_key=abc123&x=1' WHEN 3 THEN '"password": "hunter2", "a": 1'
        WHEN 4 THEN 'client-secret: s3cr3t next' WHEN 5 THEN '"body_text": "a private mail", "b": 2' WHEN 6 THEN 'html_body = "x y" end' WHEN 7 THEN 'raw_body = all the rest' WHEN 8 THEN 'snippet: all the rest' ELSE 'nothing to hide' END AS said FROM <documents>"""
}
query(
    "f16_all_redactions",
    """SELECT id, CASE kind WHEN 0 THEN 'Authorization: Bearer [REDACTED]' WHEN 1 THEN 'sent bearer [REDACTED], ok' WHEN 2 THEN 'api_key=[REDACTED]&x=1' WHEN 3 THEN '"password": "[REDACTED]", "a": 1' WHEN 4 THEN 'client-secret: [REDACTED] next'
              WHEN 5 THEN '"body_text": "[REDACTED_EMAIL_CONTENT]", "b": 2' WHEN 6 THEN 'html_body = [REDACTED_EMAIL_CONTENT]' WHEN 7 THEN 'raw_body = [REDACTED_EMAIL_CONTENT]' WHEN 8 THEN 'snippet: [REDACTED_EMAIL_CONTENT]' ELSE said END AS body FROM <secrets>""",
    _SECRETS,
)(lambda j: j.view("secrets", _SECRETS).select("id", text.redacted(F.col("said")).alias("body")))


def _records(j: JobSearch):
    """The said texts as records: a struct with a secret field, a list of structs, a map and a field of mail content."""
    said = j.view("secrets", _SECRETS)
    user = F.struct(F.col("said").alias("note"), F.col("id").alias("api_key"), F.array(F.struct(F.col("said").alias("text"), F.lit("x").alias("Refresh-Token"))).alias("notes"))
    headers = F.create_map(F.lit("Accept"), F.col("said"), F.lit("X-Auth-Token"), F.lit("abc"), F.lit("raw_body"), F.col("said"))
    return said.select("id", user.alias("user"), headers.alias("headers"), F.col("said").alias("body_text"))


_HIDDEN = """CASE kind WHEN 0 THEN 'Authorization: Bearer [REDACTED]' WHEN 1 THEN 'sent bearer [REDACTED], ok' WHEN 2 THEN 'api_key=[REDACTED]&x=1' WHEN 3 THEN '\"password\": \"[REDACTED]\", \"a\": 1' WHEN 4 THEN 'client-secret: [REDACTED] next'
             WHEN 5 THEN '\"body_text\": \"[REDACTED_EMAIL_CONTENT]\", \"b\": 2' WHEN 6 THEN 'html_body = [REDACTED_EMAIL_CONTENT]' WHEN 7 THEN 'raw_body = [REDACTED_EMAIL_CONTENT]' WHEN 8 THEN 'snippet: [REDACTED_EMAIL_CONTENT]' ELSE said END"""
query(
    "x44_nested_redaction",
    """SELECT id, chr(123) || '"note":"' || escaped || '","api_key":"[REDACTED]","notes":[' || chr(123) || '"text":"' || escaped || '","Refresh-Token":"[REDACTED]"' || chr(125) || ']' || chr(125) AS "user",
              chr(123) || '"Accept":"' || escaped || '","X-Auth-Token":"[REDACTED]","raw_body":"[REDACTED_EMAIL_CONTENT]"' || chr(125) AS headers, '[REDACTED_EMAIL_CONTENT]' AS body_text FROM <hidden>""",
    _SECRETS | {"hidden": f"SELECT id, replace({_HIDDEN}, '\"', chr(92) || '\"') AS escaped FROM <secrets>"},
)(lambda j: redacted_records(_records(j)).select("id", F.to_json("user").alias("user"), F.to_json("headers").alias("headers"), "body_text"))
_NAMES = {
    "hard_names": """SELECT doc_id AS id, doc_id % 8 AS kind, CASE doc_id % 8 WHEN 0 THEN '  OpenAI, Inc.  ' WHEN 1 THEN 'The Example Group LLC' WHEN 2 THEN 'Johnson & Johnson' WHEN 3 THEN 'jobs.example.com LLC' WHEN 4 THEN 'Example S.A.R.L.'
        WHEN 5 THEN 'Müller & Co. KG' WHEN 6 THEN 'jobs&#46;example&#46;com' ELSE 'www.data.ai' END AS company, CASE doc_id % 8 WHEN 0 THEN '  Senior SWE II - Backend (Remote)  ' WHEN 1 THEN 'C++ Software Engineer' WHEN 2 THEN 'Machine Learning Software Engineer'
        WHEN 3 THEN 'Software Engineer - New York, NY' WHEN 4 THEN 'Staff Product Manager - Growth' WHEN 5 THEN 'Software Engineer IC4' WHEN 6 THEN '---' ELSE 'Frontend Engineer' END AS role FROM <documents>"""
}
query(
    "f01_f02_hard_names",
    """SELECT id, CASE kind WHEN 0 THEN 'openai' WHEN 1 THEN 'example group' WHEN 2 THEN 'johnson and johnson' WHEN 3 THEN 'example' WHEN 4 THEN 'example' WHEN 5 THEN 'muller and co kg' WHEN 6 THEN 'example' ELSE 'data' END AS company_key,
              CASE kind WHEN 0 THEN 'back end software engineer' WHEN 1 THEN 'c plus plus software engineer' WHEN 2 THEN 'machine learning engineer' WHEN 3 THEN 'software engineer' WHEN 4 THEN 'growth product manager' WHEN 5 THEN 'software engineer'
                        WHEN 7 THEN 'front end software engineer' END AS role_key FROM <hard_names>""",
    _NAMES,
)(lambda j: j.view("hard_names", _NAMES).select("id", text.normalized_company("company").alias("company_key"), text.normalized_role("role").alias("role_key")))
query("f16_redaction", "SELECT id, regexp_replace(body_text, '(token = )(\"?)([0-9a-f]+)(\"?)', '\\1\\2[REDACTED]\\4', 'g') AS body FROM <raw_emails> WHERE body_text IS NOT NULL")(
    lambda j: j.emails.where("body_text IS NOT NULL").select("id", text.redacted(F.col("body_text")).alias("body"))
)
_TERMS = "['position', 'the', 'they']"  # what counts of the question below
_AT = "coalesce(nullif(length(regexp_extract(lower({s}), '(?s)^(.*?)\\b' || t || '\\b', 0)) - length(t) + 1, 1 - length(t)), 0)"  # the place of t as a word, 0 if it isn't there
_EXCERPTS = f"""
    SELECT id, CASE WHEN length(flat) <= 280 THEN flat WHEN best IS NULL THEN substring(flat, 1, 280) WHEN length(best) <= 280 THEN best
                    ELSE (CASE WHEN first_at > 0 THEN '... ' ELSE '' END) || trim(substring(best, first_at + 1, 280)) || (CASE WHEN first_at + 280 < length(best) THEN ' ...' ELSE '' END) END AS excerpt
    FROM (
        SELECT id, flat, best, CAST(greatest(0, least(list_min(list_filter([{_AT.replace("{s}", "best")} FOR t IN {_TERMS}], lambda x: x > 0)) - 1 - 140, length(best) - 280)) AS BIGINT) AS first_at
        FROM (
            SELECT id, flat, list_max(list_filter([{{'weight': list_sum([CASE WHEN {_AT.replace("{s}", "sentences[i]")} > 0 THEN length(t) ELSE 0 END FOR t IN {_TERMS}]), 'at': -i, 'text': trim(sentences[i])}} FOR i IN range(1, len(sentences) + 1)], lambda x: x.weight > 0)).text AS best
            FROM (SELECT id, flat, regexp_extract_all(flat, '[^.!?]+[.!?]?') AS sentences FROM (SELECT id, trim(regexp_replace(body_text, '\\s+', ' ', 'g')) AS flat FROM <raw_emails> WHERE body_text IS NOT NULL) a) b) c) d"""
query("f17_excerpts", _EXCERPTS)(lambda j: j.emails.where("body_text IS NOT NULL").select("id", text.relevant_excerpt(F.col("body_text"), "What did they say about the position?").alias("excerpt")))
query(
    "f10_split_ids",
    "SELECT application_id, 'manual-split-' || substring(sha256(application_id || chr(0) || string_agg(id, chr(0) ORDER BY id)), 1, 16) AS split_id FROM <application_events> GROUP BY 1",
)(lambda j: j.events.groupBy("application_id").agg(F.concat(F.lit("manual-split-"), F.substring(F.sha2(F.concat_ws("\0", "application_id", F.array_join(F.array_sort(F.collect_list("id")), "\0")), 256), 1, 16)).alias("split_id")))
_BIG_CUTOFF = "1998-08-02 12:00:00"
_GHOSTS = f"""
    SELECT a.id, x.applied_at FROM <applications> a JOIN (SELECT application_id, max(event_at) FILTER (WHERE event_type = 'applied') AS applied_at, bool_or(event_type = 'ghost_inferred') AS g FROM <application_events> GROUP BY 1) x
    ON x.application_id = a.id WHERE x.applied_at <= CAST('{_BIG_CUTOFF}' AS TIMESTAMP) AND NOT x.g AND a.id IN (SELECT id FROM <submitted>)
"""
query("l12_ghost_candidates", _GHOSTS, METRIC_VIEWS)(lambda j: linkage.ghost_candidates(j.apps, j.events, not_submitted(j.events, j.classes), _BIG_CUTOFF).select("id", "applied_at"))
query(
    "l12_inferred_ghosts",
    f"""SELECT g.id AS application_id, 'ghost_inferred' AS event_type, n.event_at + INTERVAL '30' DAY AS event_at FROM <candidates> g JOIN <latest_non_ghost> n ON n.application_id = g.id
        WHERE g.id NOT IN (SELECT application_id FROM <answered>) AND n.event_at + INTERVAL '30' DAY <= CAST('{CLOCK}' AS TIMESTAMP)""",
    METRIC_VIEWS | {"candidates": _GHOSTS},
)(lambda j: linkage.infer_ghosts(features(j.apps, j.events, j.emails, j.classes), j.events, not_submitted(j.events, j.classes), CLOCK))
query(
    "l13_retracted_ghosts",
    """SELECT e.application_id, e.id, e.event_at, CASE WHEN l.application_id IS NULL OR e.application_id IN (SELECT application_id FROM <answered>) THEN 'retract'
              WHEN n.event_at + INTERVAL '30' DAY <> e.event_at THEN 'move' ELSE 'keep' END AS action
       FROM <application_events> e LEFT JOIN <latest_applied> l ON l.application_id = e.application_id LEFT JOIN <latest_non_ghost> n ON n.application_id = e.application_id WHERE e.event_type = 'ghost_inferred'""",
    METRIC_VIEWS,
)(lambda j: linkage.retract_ghosts(features(j.apps, j.events, j.emails, j.classes), j.events.where("event_type = 'ghost_inferred'")).select("application_id", "id", "event_at", "action"))
assert schema.GHOST_DAYS == 30, "the oracle SQL above says 30 days"
