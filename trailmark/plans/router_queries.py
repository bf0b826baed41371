"""Registered queries of the question router: a table of questions, each of a known kind, and what is expected of that kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import router, windows
from trailmark.plans.catalog import query

#: Questions with route, insight, template, dimension, and filters or limits as text (name=value, sorted).
EXAMPLES: tuple[tuple[str, str, str | None, str, str | None, str], ...] = (
    ("What exactly did the recruiter at Acme say?", "content", None, "summary_counts", None, ""),
    ("Show me every rejection email that mentioned experience", "content", None, "summary_counts", None, ""),
    ("Who am I waiting on and who is overdue for a follow-up?", "quantitative", None, "live_applications", None, ""),
    ("How many applications and what exactly did recruiters say?", "mixed", None, "summary_counts", None, ""),
    ("How many rejected applications do I have, and why am I getting rejected?", "mixed", "why_rejected", "summary_counts", None, "status=rejected"),
    ("Tell me anything useful about my Acme search", "content", None, "summary_counts", None, ""),
    ("How many applications in 2025?", "quantitative", None, "summary_counts", None, "window_kind=calendar_year;window_year=2025"),
    ("How many LinkedIn applications this month?", "quantitative", None, "summary_counts", None, "source=linkedin;window_kind=this_month"),
    ("Show latest application", "quantitative", None, "application_list", None, "list_limit=1"),
    ("Show my most recent application", "quantitative", None, "application_list", None, "list_limit=1"),
    ("Show the latest 3 applications", "quantitative", None, "application_list", None, "list_limit=3"),
    ("List applications from the company site", "quantitative", None, "application_list", None, "list_limit=20;source=company_site"),
    ("Which companies did I apply to in the last 300 days? Give me 500", "quantitative", None, "company_list", None, "list_limit=100;window_days=300;window_kind=rolling_days"),
    ("What is my conversion rate for LinkedIn vs company site?", "quantitative", None, "breakdown", "source", ""),
    ("Compare LinkedIn with referrals.", "quantitative", None, "breakdown", "source", ""),
    ("Previous user question: How many LinkedIn applications do I have?\nCurrent user question: What about referrals?", "quantitative", None, "summary_counts", None, "source=referral"),
    ("How many remote applications?", "quantitative", None, "summary_counts", None, "work_mode=remote"),
    ("How many on-site applications?", "quantitative", None, "summary_counts", None, "work_mode=onsite"),
    ("How do remote vs hybrid roles convert?", "quantitative", None, "breakdown", "work_mode", ""),
    ("How many applications did not offer sponsorship?", "quantitative", None, "summary_counts", None, "sponsorship=not_offered"),
    ("How do offered sponsorship vs non-sponsorship roles convert?", "quantitative", None, "breakdown", "sponsorship", ""),
    ("How many applications are currently interviewing?", "quantitative", None, "summary_counts", None, "status=interview"),
    ("How many applications for a data engineer role with salary between $90k and 120,000?", "quantitative", None, "summary_counts", None, "role=data engineer;salary_max=120000;salary_min=90000"),
    ("How many applications for remote jobs with a salary of at least 95.5k?", "quantitative", None, "summary_counts", None, "salary_min=95500;work_mode=remote"),
    ("How many with job title 'C++ Developer' and salary up to £80,000?", "quantitative", None, "breakdown", "role", "role=c++ developer;salary_max=80000"),
    ("How many with salary 90k to 80k?", "quantitative", None, "summary_counts", None, ""),
    ("What is my average time to first response?", "quantitative", None, "timing", None, ""),
    ("After how many days of silence is an application effectively dead?", "quantitative", None, "personal_ghost_threshold", None, ""),
    ("Is my response rate improving?", "quantitative", None, "response_rate_timeseries", None, ""),
    ("What do my successful jobs have in common in each application?", "quantitative", None, "successful_application_segments", None, ""),
    ("What do my rejected or ghosted applications have in common?", "quantitative", None, "negative_outcome_segments", None, ""),
    ("Which single factor correlates most with getting a response?", "quantitative", None, "strongest_response_correlate", None, ""),
    ("Where is my wasted effort?", "quantitative", None, "wasted_effort_segments", None, ""),
    ("Which source gives the best ROI?", "quantitative", None, "best_roi_source", None, ""),
    ("Is my sponsorship requirement hurting me, with sponsorship?", "quantitative", None, "sponsorship_response_impact", None, ""),
    ("Which skill is dead weight?", "quantitative", None, "skill_signal_segments", None, ""),
    ("Which adjacent roles fit?", "quantitative", None, "adjacent_role_suggestions", None, ""),
    ("How has my application volume changed?", "quantitative", None, "application_timeseries", None, ""),
    ("Show the funnel", "quantitative", None, "funnel", None, ""),
    ("What was my busiest month last year?", "quantitative", None, "busiest_application_month", None, "window_kind=last_year"),
    ("What should I do next week?", "content", "weekly_actions", "summary_counts", None, ""),
    ("What is the story of my job search?", "content", "story", "summary_counts", None, ""),
    ("Breakdown by industry of the tech stack", "quantitative", None, "breakdown", "industry", ""),
)
FILTERS = ("list_limit", "role", "salary_max", "salary_min", "source", "sponsorship", "status", "window_days", "window_kind", "window_year", "work_mode")


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _case(i: int) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {_quoted(e[i])}" for k, e in enumerate(EXAMPLES)) + " END"


_ASKED = {"routed_questions": f"SELECT id, kind, {_case(0)} AS question FROM (SELECT event_id AS id, event_id % {len(EXAMPLES)} AS kind FROM <events>) e"}
_spoken = lambda j: j.view("routed_questions", _ASKED)
query("q04_routes", f"SELECT id, {_case(1)} AS route, {_case(2)} AS insight, {_case(3)} AS template, {_case(4)} AS dimension FROM <routed_questions>", _ASKED)(
    lambda j: router.routed(_spoken(j)).select("id", "route", "insight", "template", "dimension")
)
query("q05_x39_filters", f"SELECT id, {_case(5)} AS filters FROM <routed_questions>", _ASKED)(
    lambda j: router.routed(_spoken(j)).select("id", F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in FILTERS]).alias("filters"))
)
query(
    "x39_seen_between",
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN date_trunc('week', ts) WHEN 1 THEN date_trunc('month', ts) WHEN 2 THEN date_trunc('year', ts) ELSE TIMESTAMP '1997-01-01' END AS first_seen_from,
              CASE event_id % 4 WHEN 0 THEN date_trunc('week', ts) + INTERVAL 7 DAY WHEN 1 THEN date_trunc('month', ts) + INTERVAL 1 MONTH WHEN 2 THEN date_trunc('year', ts) + INTERVAL 1 YEAR ELSE TIMESTAMP '1998-01-01' END - INTERVAL 1 MICROSECOND AS first_seen_to
       FROM <events>""",
)(
    lambda j: j.view("events").select(
        F.col("event_id").alias("id"),
        *[c.alias(n) for c, n in zip(router.seen_between(F.element_at(F.array(*[F.lit(k) for k in ("this_week", "this_month", "this_year", "calendar_year")]), (F.col("event_id") % 4 + 1).cast("int")), F.lit(1997), F.col("ts")), ("first_seen_from", "first_seen_to"), strict=True)],
    )
)
#: A model's plans: some agree with the rules, some don't, some lack a content tool.
_PLANS = {
    "plans": """SELECT q.*, CASE CAST(floor(q.id / 7) AS BIGINT) % 4 WHEN 0 THEN 'content' WHEN 1 THEN 'quantitative' WHEN 2 THEN 'mixed' ELSE 'conversation' END AS plan_route, CASE WHEN CAST(floor(q.id / 7) AS BIGINT) % 4 IN (1, 2) THEN 'rates' END AS plan_template,
                       CASE WHEN CAST(floor(q.id / 7) AS BIGINT) % 3 = 1 THEN 'last_year' END AS plan_window_kind, CAST(floor(q.id / 7) AS BIGINT) % 4 IN (0, 2) AS plan_retrieval, CAST(floor(q.id / 11) AS BIGINT) % 5 = 0 AS plan_insight, CAST(floor(q.id / 13) AS BIGINT) % 5 = 0 AS plan_web FROM <routed_questions> q""",
}
_JUDGED = {
    "plans_ruled": f"SELECT *, plan_route <> 'conversation' AND route <> 'content' AS ruled FROM (SELECT *, {_case(1)} AS route, {_case(3)} AS template, nullif(regexp_extract({_case(5)}, 'window_kind=([a-z_]+)', 1), '') AS own_window FROM <plans>) r",
    "plans_final": """SELECT *, CASE WHEN ruled THEN route ELSE plan_route END AS final_route, CASE WHEN ruled THEN template WHEN plan_route IN ('quantitative', 'mixed') THEN plan_template END AS final_template,
                             CASE WHEN ruled AND route = 'mixed' AND NOT (plan_retrieval OR plan_insight OR plan_web) THEN 'no content tool' END AS fault,
                             CASE WHEN NOT ruled THEN plan_window_kind WHEN route = 'quantitative' THEN coalesce(plan_window_kind, own_window) ELSE own_window END AS final_window_kind FROM <plans_ruled>""",
}
query(
    "q07_x40_overridden_plans",
    """SELECT id, final_route, final_template, final_window_kind, fault,
              CASE WHEN fault IS NOT NULL THEN '' ELSE concat_ws(',', CASE WHEN final_route = 'quantitative' OR (final_route = 'mixed' AND final_template IS NOT NULL) THEN 'structured_query' END,
                  CASE WHEN (final_route = 'mixed' AND plan_retrieval) OR (final_route = 'content' AND NOT plan_insight) THEN 'semantic_search' END,
                  CASE WHEN final_route IN ('mixed', 'content') AND plan_insight THEN 'cached_insight' END, CASE WHEN final_route = 'web' OR (final_route = 'mixed' AND plan_web) THEN 'web_search' END) END AS tools FROM <plans_final>""",
    _ASKED | _PLANS | _JUDGED,
)(lambda j: router.overridden(j.view("plans", _ASKED | _PLANS)).select("id", "final_route", "final_template", "final_window_kind", "fault", F.array_join("tools", ",").alias("tools")))
query(
    "x40_x43_citations_and_prompts",
    f"""SELECT id, CASE WHEN {_case(3)} IN ('live_applications', 'application_list') THEN 'application:' || CAST(id AS VARCHAR) ELSE 'metric:' || {_case(3)} END AS citation_id,
               CASE {_case(3)} WHEN 'summary_counts' THEN 'Show me the applications included in that count.' WHEN 'application_list' THEN 'Group these applications by company.' WHEN 'company_list' THEN 'Show the applications for these companies.' END AS prompt
        FROM <routed_questions>""",
    _ASKED,
)(lambda j: router.routed(_spoken(j)).select("id", router.citation(F.col("template"), F.col("id").cast("string")).alias("citation_id"), router.follow_up_prompt(F.col("template")).alias("prompt")))
_SETTINGS = {
    "settings": """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'azure_openai' ELSE 'ollama' END AS provider, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'deployment-' || CAST(c_nationkey AS STRING) END AS deployment,
                          CASE c_custkey % 5 WHEN 0 THEN '' ELSE 'model-' || CAST(c_nationkey AS STRING) END AS local_model FROM <customer>"""
}
query(
    "x46_classification_targets",
    "SELECT id, CASE WHEN provider = 'azure_openai' THEN deployment ELSE local_model END AS model, coalesce(CASE WHEN provider = 'azure_openai' THEN deployment ELSE local_model END, '') <> '' AS can_run FROM <settings>",
    _SETTINGS,
)(lambda j: j.view("settings", _SETTINGS).select("id", *[c.alias(n) for c, n in zip(router.classification_target(F.col("provider"), F.col("deployment"), F.col("local_model")), ("model", "can_run"), strict=True)]))
_LEANING = {
    "leaning": """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'How many applications are there?' WHEN 1 THEN 'And the rejected ones?' WHEN 2 THEN 'Show their emails' WHEN 3 THEN 'What about Acme' WHEN 4 THEN 'Is IT right?'
        WHEN 5 THEN 'Android roles' WHEN 6 THEN '  how about last week' WHEN 7 THEN 'thistle, items and theme' ELSE 'why was this one rejected' END AS question FROM <events>"""
}
query("x43_leaning_questions", "SELECT id, id % 9 IN (0, 1, 2, 3, 4, 6, 8) AS leans FROM <leaning>", _LEANING)(lambda j: j.view("leaning", _LEANING).select("id", _lean()))


def _lean():
    from trailmark.operators.questions import lean

    return lean(F.col("question")).alias("leans")
#: Requests with a window each, in different zones, asked at the events' times.
_REQUESTS = {
    "window_requests": """SELECT event_id AS request_id, CASE event_id % 9 WHEN 0 THEN 'this_week' WHEN 1 THEN 'last_week' WHEN 2 THEN 'this_month' WHEN 3 THEN 'last_month' WHEN 4 THEN 'this_year' WHEN 5 THEN 'last_year' WHEN 6 THEN 'rolling_days' WHEN 7 THEN 'calendar_year' ELSE 'custom' END AS kind,
                                 CASE WHEN event_id % 9 = 6 THEN CAST(1 + event_id % 500 AS INT) END AS days, CASE WHEN event_id % 9 = 7 THEN CAST(1992 + event_id % 8 AS INT) END AS year,
                                 CASE WHEN event_id % 9 = 8 THEN CAST(DATE '1993-01-01' + CAST(event_id % 900 AS INT) AS DATE) END AS start_day, CASE WHEN event_id % 9 = 8 THEN CAST(DATE '1993-01-01' + CAST(event_id % 900 + 1 + event_id % 70 AS INT) AS DATE) END AS end_day,
                                 CASE event_id % 5 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Europe/Berlin' WHEN 2 THEN 'America/New_York' WHEN 3 THEN 'Asia/Kathmandu' ELSE 'Australia/Lord_Howe' END AS zone, ts - INTERVAL '28' YEAR AS now FROM <events>"""
}
_LOCAL = {
    "window_today": "SELECT *, CAST(timezone(zone, timezone('UTC', now)) AS DATE) AS today FROM <window_requests>",
    "window_days": """SELECT *, CAST(CASE kind WHEN 'this_week' THEN date_trunc('week', today) WHEN 'last_week' THEN date_trunc('week', today) - INTERVAL 7 DAY WHEN 'this_month' THEN date_trunc('month', today) WHEN 'last_month' THEN date_trunc('month', today) - INTERVAL 1 MONTH
                               WHEN 'this_year' THEN date_trunc('year', today) WHEN 'last_year' THEN date_trunc('year', today) - INTERVAL 1 YEAR WHEN 'rolling_days' THEN today - (days - 1) * INTERVAL 1 DAY WHEN 'calendar_year' THEN make_date(year, 1, 1) ELSE start_day END AS TIMESTAMP) AS first_day,
                            CAST(CASE kind WHEN 'this_week' THEN date_trunc('week', today) + INTERVAL 7 DAY WHEN 'last_week' THEN date_trunc('week', today) WHEN 'this_month' THEN date_trunc('month', today) + INTERVAL 1 MONTH WHEN 'last_month' THEN date_trunc('month', today)
                               WHEN 'this_year' THEN date_trunc('year', today) + INTERVAL 1 YEAR WHEN 'last_year' THEN date_trunc('year', today) WHEN 'rolling_days' THEN today + INTERVAL 1 DAY WHEN 'calendar_year' THEN make_date(year + 1, 1, 1) ELSE end_day END AS TIMESTAMP) AS after_day FROM <window_today>""",
    "window_bounds": "SELECT request_id, timezone('UTC', timezone(zone, first_day)) AS first_at, timezone('UTC', timezone(zone, after_day)) AS after_at FROM <window_days>",
}
_bounds = lambda j: windows.bounded(j.view("window_requests", _REQUESTS))
query("f23_window_bounds", "SELECT request_id, first_at, after_at FROM <window_bounds>", _REQUESTS | _LOCAL)(lambda j: _bounds(j).select("request_id", "first_at", "after_at"))
query(
    "q03_f23_counted_requests",
    "SELECT b.request_id, count(a.id) AS n FROM <window_bounds> b LEFT JOIN <applications> a ON a.first_seen_at >= b.first_at AND a.first_seen_at < b.after_at GROUP BY 1",
    _REQUESTS | _LOCAL,
)(lambda j: windows.counted(_bounds(j), j.apps, "first_seen_at"))
