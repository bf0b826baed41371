"""Registered metric and diagnostic queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.operators import diagnostics, metrics
from trailmark.operators.features import features
from trailmark.operators.filters import MetricsFilter, submitted
from trailmark.plans.catalog import query
from trailmark.sources.testdata import CLOCK, JobSearch

CUTOFF, ACTIVE = "1998-08-02 12:00:00", "1998-07-03 12:00:00"  # CLOCK less GHOST_DAYS and ACTIVE_DAYS
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_TS = lambda s: f"CAST('{s}' AS TIMESTAMP)"
_RESPONSE = _IN(schema.RESPONSE_EVENTS)
_NEWER = lambda a, b: f"({a}.event_at, {a}.email_sent_at, {a}.classified_at, {a}.id) > ({b}.event_at, {b}.email_sent_at, {b}.classified_at, {b}.id)"

#: Views of the oracle alone, written the direct way: existence tests and anti joins instead of one aggregate.
VIEWS = {
    "submitted": f"""
        SELECT a.* FROM <applications> a
        WHERE NOT EXISTS (SELECT 1 FROM <application_events> e JOIN <email_classifications> c ON c.email_id = e.email_id
                          WHERE e.application_id = a.id AND c.is_job_related AND c.category IN {_IN(schema.GENERAL_CATEGORIES)})
           OR EXISTS (SELECT 1 FROM <application_events> e LEFT JOIN <email_classifications> c ON c.email_id = e.email_id
                      WHERE e.application_id = a.id AND (c.email_id IS NULL OR c.category IN {_IN(schema.LIFECYCLE_CATEGORIES)}))
    """,
    "ordered": """
        SELECT e.id, e.application_id, e.event_type, e.event_at, coalesce(m.sent_at, e.event_at) AS email_sent_at,
               coalesce(c.classified_at, m.sent_at, e.event_at) AS classified_at
        FROM <application_events> e LEFT JOIN <raw_emails> m ON m.id = e.email_id LEFT JOIN <email_classifications> c ON c.email_id = e.email_id
    """,
    "latest_applied": """
        SELECT * FROM <ordered> WHERE event_type = 'applied'
        QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY event_at DESC, email_sent_at DESC, classified_at DESC, id DESC) = 1
    """,
    "latest_non_ghost": """
        SELECT * FROM <ordered> WHERE event_type <> 'ghost_inferred'
        QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY event_at DESC, email_sent_at DESC, classified_at DESC, id DESC) = 1
    """,
    "answered": f"""
        SELECT DISTINCT l.application_id FROM <latest_applied> l JOIN <ordered> r ON r.application_id = l.application_id
        WHERE r.event_type IN {_RESPONSE} AND {_NEWER("r", "l")}
    """,
    "ghosted": f"""
        SELECT a.id FROM <submitted> a JOIN <latest_applied> l ON l.application_id = a.id JOIN <latest_non_ghost> n ON n.application_id = a.id
        WHERE n.event_at <= {_TS(CUTOFF)} AND a.id NOT IN (SELECT application_id FROM <answered>)
    """,
    "offered_after_interview": f"""
        SELECT DISTINCT i.application_id FROM <ordered> i JOIN <ordered> o ON o.application_id = i.application_id
        WHERE i.event_type = 'interview_scheduled' AND o.event_type = 'offer' AND {_NEWER("o", "i")}
    """,
    "flagged": f"""
        SELECT a.*, coalesce(x.r, false) AS has_response, coalesce(x.i, false) AS has_interview, coalesce(x.o, false) AS has_offer,
               coalesce(x.j, false) AS has_rejection, coalesce(x.i, false) OR coalesce(x.o, false) AS has_success, coalesce(x.n, 0) AS interviews
        FROM <submitted> a LEFT JOIN (
            SELECT application_id, bool_or(event_type IN {_RESPONSE}) AS r, bool_or(event_type = 'interview_scheduled') AS i, bool_or(event_type = 'offer') AS o,
                   bool_or(event_type = 'rejection') AS j, count(*) FILTER (WHERE event_type = 'interview_scheduled') AS n
            FROM <application_events> GROUP BY 1) x ON x.application_id = a.id
    """,
    "dimensioned": """
        SELECT f.*, d.dimension, d.value FROM (
            SELECT f.*, p.company_type, p.industry, ' ' || replace(replace(replace(replace(lower(trim(coalesce(seniority, ''))), '.', ' '), '-', ' '), '/', ' '), '_', ' ') || ' ' AS s
            FROM <flagged> f LEFT JOIN <company_profiles> p ON p.normalized_company = lower(trim(f.company))) f
        CROSS JOIN LATERAL (VALUES
            ('role', coalesce(nullif(lower(trim(role_title)), ''), 'unknown')), ('source', coalesce(nullif(source, ''), 'unknown')),
            ('salary', CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN 'unknown' WHEN coalesce(salary_max, salary_min) < 100000 THEN 'under_100k'
                            WHEN coalesce(salary_min, salary_max) >= 150000 THEN '150k_plus' ELSE '100k_149k' END),
            ('company_type', coalesce(nullif(company_type, ''), 'unknown')), ('industry', coalesce(nullif(lower(trim(industry)), ''), 'unknown')),
            ('sponsorship', coalesce(nullif(sponsorship, ''), 'unknown')), ('work_mode', coalesce(nullif(work_mode, ''), 'unknown')),
            ('seniority', CASE WHEN trim(coalesce(seniority, '')) = '' THEN 'unknown'
                WHEN s LIKE '% lead %' OR s LIKE '% staff %' OR s LIKE '% principal %' THEN 'lead' WHEN s LIKE '% senior %' OR s LIKE '% sr %' THEN 'senior'
                WHEN s LIKE '% junior %' OR s LIKE '% jr %' OR s LIKE '% entry %' OR s LIKE '% intern %' OR s LIKE '% graduate %' THEN 'junior'
                WHEN s LIKE '% mid %' OR s LIKE '% intermediate %' THEN 'mid' ELSE 'unknown' END)
        ) d(dimension, value)
    """,
    "in_dimensions": """
        SELECT dimension, value, has_response, has_interview, has_offer, has_success, current_status FROM <dimensioned>
        UNION ALL
        SELECT 'tech', t.skill, has_response, has_interview, has_offer, has_success, current_status
        FROM <flagged> f JOIN (SELECT DISTINCT application_id, lower(trim(skill)) AS skill FROM <tech> WHERE trim(skill) <> '') t ON t.application_id = f.id
    """,
    "broken_down": f"""
        SELECT dimension, value, count(*) AS application_count, count(*) FILTER (WHERE has_response) AS response_count,
               count(*) FILTER (WHERE has_interview) AS interview_count, count(*) FILTER (WHERE has_offer) AS offer_count,
               count(*) FILTER (WHERE has_success) AS success_count, count(*) FILTER (WHERE current_status IN {_IN(schema.NEGATIVE_STATUSES)}) AS negative_count
        FROM <in_dimensions> GROUP BY 1, 2
    """,
    "segments": f"""
        SELECT b.*, response_count / application_count AS response_rate, interview_count / application_count AS interview_rate, offer_count / application_count AS offer_rate,
               success_count / application_count AS success_rate, negative_count / application_count AS negative_rate,
               response_count / application_count - br AS response_rate_lift, success_count / application_count - bs AS success_rate_lift,
               negative_count / application_count - bn AS negative_rate_lift
        FROM <broken_down> b CROSS JOIN (SELECT count(*) FILTER (WHERE has_response) / count(*) AS br, count(*) FILTER (WHERE has_success) / count(*) AS bs,
            count(*) FILTER (WHERE current_status IN {_IN(schema.NEGATIVE_STATUSES)}) / count(*) AS bn FROM <flagged>) x
        WHERE dimension NOT IN ('company_type', 'industry')
    """,
}


def facts(j: JobSearch, f: MetricsFilter | None = None) -> DataFrame:
    """The feature table of submitted applications."""
    return features(submitted(j.apps, j.events, j.classes, f), j.events, j.emails, j.classes)


def _metric(name: str, sql: str):
    return query(name, sql, VIEWS)


_metric("a01_count_between", f"SELECT count(*) AS applications FROM <submitted> WHERE first_seen_at >= {_TS('1998-01-01')} AND first_seen_at < {_TS('1999-01-01')}")(
    lambda j: metrics.count_between(submitted(j.apps, j.events, j.classes), "1998-01-01", "1999-01-01")
)
_metric("a02_total", "SELECT count(*) AS applications FROM <submitted>")(lambda j: submitted(j.apps, j.events, j.classes).agg(F.count("*").alias("applications")))
_metric(
    "p02_filtered_total",
    f"""SELECT count(*) AS applications FROM <submitted> WHERE source = 'linkedin' AND lower(role_title) LIKE '%high eng%' AND first_seen_at >= {_TS('1996-01-01')}
        AND coalesce(salary_max, salary_min) >= 90000 AND coalesce(salary_min, salary_max) <= 250000""",
)(lambda j: submitted(j.apps, j.events, j.classes, MetricsFilter(source="linkedin", role=" High Eng", first_seen_from="1996-01-01", salary_min=90000, salary_max=250000)).agg(F.count("*").alias("applications")))
_metric("p03_unsubmitted_list", "SELECT id, role_title FROM <applications> WHERE current_status = 'offer' AND work_mode = 'remote' ORDER BY first_seen_at DESC, id")(
    lambda j: MetricsFilter(status="offer", work_mode="remote").apply(j.apps).orderBy(F.desc("first_seen_at"), "id").select("id", "role_title")
)
_metric("a03_distinct_companies", "SELECT count(DISTINCT nullif(lower(trim(company)), '')) AS companies FROM <submitted>")(lambda j: metrics.distinct_companies(submitted(j.apps, j.events, j.classes)))
_metric(
    "a04_applications_with_event",
    """SELECT e.event_type, count(DISTINCT a.id) AS applications FROM <submitted> a JOIN <application_events> e ON e.application_id = a.id
       WHERE e.event_type IN ('offer', 'rejection', 'interview_scheduled') GROUP BY 1""",
)(lambda j: metrics.applications_with_event(facts(j)))
_metric(
    "a05_companies_with_interview",
    "SELECT count(DISTINCT nullif(lower(trim(company)), '')) AS companies FROM <submitted> a JOIN <application_events> e ON e.application_id = a.id WHERE e.event_type = 'interview_scheduled'",
)(lambda j: facts(j).agg(metrics.companies_with_interview().alias("companies")))
_metric("a06_interview_events", "SELECT count(*) AS interviews FROM <submitted> a JOIN <application_events> e ON e.application_id = a.id WHERE e.event_type = 'interview_scheduled'")(
    lambda j: facts(j).agg(F.sum("interviews").alias("interviews"))
)
_metric("a07_outcomes", f"SELECT count(*) FILTER (WHERE has_success) AS successful, count(*) FILTER (WHERE current_status IN {_IN(schema.NEGATIVE_STATUSES)}) AS negative FROM <flagged>")(
    lambda j: metrics.outcomes(facts(j))
)
_metric("a08_live", f"SELECT count(*) AS live FROM <submitted> WHERE current_status IN {_IN(schema.LIVE_STATUSES)} AND last_activity_at >= {_TS(ACTIVE)}")(
    lambda j: metrics.live(submitted(j.apps, j.events, j.classes), ACTIVE)
)
_metric(
    "a09_response_silence",
    "SELECT count(*) AS total_applications, count(*) FILTER (WHERE has_response) AS human_response_count, count(*) FILTER (WHERE NOT has_response) AS silent_count FROM <flagged>",
)(lambda j: metrics.response_silence(facts(j)))
for _name, _types, _column in (("a10_first_response_time", _RESPONSE, "first_response_at"), ("a11_rejection_time", "('rejection')", "first_rejection_at")):
    _metric(
        _name,
        f"""SELECT count(*) AS applications, round(avg(h), 6) AS average_hours FROM (
                SELECT a.id, date_diff('microsecond', a.first_seen_at, min(e.event_at)) / 3.6e9 AS h FROM <submitted> a JOIN <application_events> e ON e.application_id = a.id
                WHERE e.event_type IN {_types} AND e.event_at >= a.first_seen_at GROUP BY a.id, a.first_seen_at) x""",
    )(lambda j, c=_column: metrics.average_hours(facts(j), c))
_metric(
    "a12_first_response_days",
    f"""SELECT a.id AS application_id, greatest(0, CAST(floor(date_diff('second', a.first_seen_at, min(e.event_at)) / 86400) AS BIGINT)) AS days
        FROM <submitted> a JOIN <application_events> e ON e.application_id = a.id WHERE e.event_type IN {_RESPONSE} AND e.event_at >= a.first_seen_at GROUP BY a.id, a.first_seen_at""",
)(lambda j: metrics.first_response_days(facts(j)))
_SILENT = f"""SELECT a.id AS application_id, greatest(0, CAST(floor(date_diff('second', l.event_at, {_TS(CLOCK)}) / 86400) AS BIGINT)) AS days
    FROM <submitted> a JOIN <latest_applied> l ON l.application_id = a.id WHERE a.current_status <> 'withdrawn' AND a.id NOT IN (SELECT application_id FROM <answered>)"""
_metric("a13_silent_ages", _SILENT)(lambda j: metrics.silent_ages(facts(j), CLOCK))
query(
    "a14_silence_histogram",
    "SELECT b.bucket, count(s.days) AS applications FROM (VALUES ('0_7', 0, 7), ('8_14', 8, 14), ('15_30', 15, 30), ('31_60', 31, 60), ('61_plus', 61, 1000000)) b(bucket, low, high) LEFT JOIN <silent> s ON s.days BETWEEN b.low AND b.high GROUP BY 1",
    VIEWS | {"silent": _SILENT},
)(lambda j: metrics.silence_histogram(facts(j), CLOCK))
_metric("a15_ghosted", "SELECT count(DISTINCT id) AS ghosted FROM <ghosted>")(lambda j: metrics.ghosted(facts(j), CUTOFF))
_metric(
    "a16_rates",
    """SELECT name, numerator, denominator, numerator / nullif(denominator, 0) AS rate FROM (
        SELECT 'response' AS name, count(*) FILTER (WHERE has_response) AS numerator, count(*) AS denominator FROM <flagged>
        UNION ALL SELECT 'rejection', count(*) FILTER (WHERE has_rejection), count(*) FROM <flagged>
        UNION ALL SELECT 'ghost', (SELECT count(DISTINCT id) FROM <ghosted>), count(*) FROM <flagged>
        UNION ALL SELECT 'application_to_interview', count(*) FILTER (WHERE has_interview), count(*) FROM <flagged>
        UNION ALL SELECT 'interview_to_offer', count(*) FILTER (WHERE id IN (SELECT application_id FROM <offered_after_interview>)), count(*) FILTER (WHERE has_interview) FROM <flagged>) x""",
)(lambda j: metrics.rates(facts(j), CUTOFF))
_metric(
    "a17_funnel",
    """SELECT 'applied' AS stage, count(*) AS count FROM <flagged> UNION ALL SELECT 'screen', count(*) FROM <flagged> WHERE has_response
       UNION ALL SELECT 'interview', count(DISTINCT nullif(lower(trim(company)), '')) FROM <flagged> WHERE has_interview UNION ALL SELECT 'final', 0
       UNION ALL SELECT 'offer', count(*) FROM <flagged> WHERE id IN (SELECT application_id FROM <offered_after_interview>)""",
)(lambda j: metrics.funnel(facts(j)))
_metric("a18_offer_after_interview", "SELECT count(*) AS applications FROM <submitted> WHERE id IN (SELECT application_id FROM <offered_after_interview>)")(
    lambda j: facts(j).agg(metrics.count_if(F.col("offer_after_interview")).alias("applications"))
)
_metric(
    "a19_a20_daily",
    "SELECT strftime(first_seen_at, '%Y-%m-%d') AS period_start, count(*) AS applications, count(*) FILTER (WHERE has_response) AS responses, count(*) FILTER (WHERE has_response) / count(*) AS response_rate FROM <flagged> GROUP BY 1",
)(lambda j: metrics.daily(facts(j)))
_metric(
    "a21_a24_breakdown",
    "SELECT *, response_count / application_count AS response_rate, interview_count / application_count AS interview_rate, offer_count / application_count AS offer_rate FROM <broken_down>",
)(lambda j: metrics.breakdown(facts(j), j.profiles, j.tech))
_metric(
    "a21_breakdown_source",
    """SELECT dimension, value, application_count, response_count, interview_count, offer_count, success_count, negative_count,
       response_count / application_count AS response_rate, interview_count / application_count AS interview_rate, offer_count / application_count AS offer_rate FROM <broken_down> WHERE dimension = 'source'""",
)(lambda j: metrics.breakdown(facts(j), j.profiles, j.tech, ("source",)))
_metric(
    "a25_busiest_months",
    """SELECT month_start, n AS application_count FROM (SELECT strftime(timezone('America/New_York', timezone('UTC', first_seen_at)), '%Y-%m-01') AS month_start, count(*) AS n FROM <submitted> GROUP BY 1) x
       QUALIFY rank() OVER (ORDER BY n DESC) = 1""",
)(lambda j: metrics.busiest_months(submitted(j.apps, j.events, j.classes), "America/New_York"))
_metric(
    "a26_companies",
    """SELECT company, sum(n)::BIGINT AS application_count, string_agg(role, '|' ORDER BY r, role) AS role_titles, array_to_string(flatten(list(ids ORDER BY r)), '|') AS application_ids FROM (
           SELECT lower(trim(company)) AS company, lower(trim(role_title)) AS r, min(trim(role_title)) AS role, count(*) AS n, list(id ORDER BY trim(role_title), id) AS ids FROM <submitted> WHERE trim(company) <> '' GROUP BY 1, 2) x
       GROUP BY 1 ORDER BY 1 LIMIT 20""",
)(lambda j: metrics.companies(submitted(j.apps, j.events, j.classes)))
_metric("a27_status_counts", f"SELECT s.status, count(a.id) AS applications FROM (VALUES {', '.join(f"('{s}')" for s in schema.STATUSES)}) s(status) LEFT JOIN <applications> a ON a.current_status = s.status GROUP BY 1")(
    lambda j: metrics.status_counts(j.apps)
)
_metric(
    "a28_insight_counts",
    """SELECT 'total' AS kind, 'all' AS value, count(*) AS n FROM <applications> UNION ALL SELECT 'status', current_status, count(*) FROM <applications> GROUP BY 2
       UNION ALL SELECT 'source', source, count(*) FROM <applications> GROUP BY 2 UNION ALL SELECT 'sponsorship', sponsorship, count(*) FROM <applications> GROUP BY 2
       UNION ALL SELECT 'work_mode', coalesce(work_mode, 'unknown'), count(*) FROM <applications> GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM <application_events> GROUP BY 2""",
)(lambda j: metrics.insight_counts(j.apps, j.events))
_metric(
    "a29_rejected_skills",
    "SELECT skill, count(*) AS applications FROM (SELECT DISTINCT a.id, trim(t.skill) AS skill FROM <applications> a JOIN <tech> t ON t.application_id = a.id WHERE a.current_status = 'rejected' AND trim(t.skill) <> '') x GROUP BY 1",
)(lambda j: metrics.rejected_skills(j.apps, j.tech))
_metric(
    "a36_summary",
    "\nUNION ALL ".join(
        [f"SELECT 'in_{k}' AS metric, count(*) AS value FROM <flagged> WHERE first_seen_at >= {_TS(a)} AND first_seen_at < {_TS(b)}" for k, (a, b) in metrics.calendar_windows(CLOCK).items()]
        + [
            f"SELECT '{k}', {e} FROM <flagged>"
            for k, e in (
                ("total", "count(*)"),
                ("companies", "count(DISTINCT nullif(lower(trim(company)), ''))"),
                ("responses", "count(*) FILTER (WHERE has_response)"),
                ("silent", "count(*) FILTER (WHERE NOT has_response)"),
                ("rejected", "count(*) FILTER (WHERE has_rejection)"),
                ("ghosted", "count(*) FILTER (WHERE id IN (SELECT id FROM <ghosted>))"),
                ("interviews", "sum(interviews)::BIGINT"),
                ("offers", "count(*) FILTER (WHERE has_offer)"),
                ("live", f"count(*) FILTER (WHERE current_status IN {_IN(schema.LIVE_STATUSES)} AND last_activity_at >= {_TS(ACTIVE)})"),
                ("offers_after_interview", "count(*) FILTER (WHERE id IN (SELECT application_id FROM <offered_after_interview>))"),
            )
        ]
    ),
)(lambda j: metrics.summary(facts(j), CLOCK))

_SEGMENT = "dimension, value, application_count, response_count, interview_count, offer_count, success_count, negative_count, response_rate, interview_rate, offer_rate, success_rate, negative_rate, response_rate_lift, success_rate_lift, negative_rate_lift"
_segments = lambda j: diagnostics.segments(facts(j), j.profiles, j.tech)
_metric("d01_segments", f"SELECT {_SEGMENT} FROM <segments>")(_segments)
for _name, _where, _order, _n in (
    ("d02_strongest", "response_rate_lift > 0", "response_rate_lift DESC, application_count DESC, dimension, value", 3),
    ("d02_weakest", "response_rate_lift < 0", "response_rate_lift, application_count DESC, dimension, value", 3),
    ("d03_successful", "success_count > 0 AND success_rate_lift > 0", "success_rate_lift DESC, success_count DESC, application_count DESC, dimension, value", 3),
    ("d04_negative", "negative_count > 0 AND negative_rate_lift > 0", "negative_rate_lift DESC, negative_count DESC, application_count DESC, dimension, value", 3),
    ("d05_best_source", "dimension = 'source'", "interview_rate DESC, interview_count DESC, application_count DESC, value", 1),
    ("d06_sponsorship_impact", "dimension = 'sponsorship'", "response_rate_lift, application_count DESC, value", 1),
    ("d07_selling_skills", "dimension = 'tech' AND interview_count > 0", "interview_rate DESC, interview_count DESC, application_count DESC, value", 3),
    ("d07_dead_weight_skills", "dimension = 'tech' AND response_rate_lift < 0", "response_rate_lift, application_count DESC, value", 3),
    ("d08_adjacent_roles", "dimension = 'role' AND success_count > 0", "success_rate DESC, success_count DESC, application_count DESC, value", 3),
):
    _metric(_name, f"SELECT dimension, value, application_count FROM <segments> WHERE {_where} ORDER BY {_order} LIMIT {_n}")(
        lambda j, k=_name.split("_", 1)[1]: diagnostics.highlights(_segments(j))[k].select("dimension", "value", "application_count")
    )
