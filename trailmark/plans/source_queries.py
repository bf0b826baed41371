"""Registered source, streaming and template queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.plans import list_queries  # noqa: F401  (its SQL is used below)
from trailmark.plans.catalog import RAW_SQL, query
from trailmark.plans.metric_queries import VIEWS
from trailmark.plans.templates import TEMPLATES, Asker, DateWindow, Request
from trailmark.sources import mail, tables
from trailmark.sources.testdata import CLOCK, JobSearch
from trailmark.streaming.ingest import activity

_NOW = dt.datetime.fromisoformat(CLOCK).replace(tzinfo=dt.UTC)
query("s07_s12_scope_count", "SELECT least(count(*), 200) AS messages FROM <raw_emails> WHERE sent_at >= CAST('1998-01-02' AS TIMESTAMP) AND sent_at < CAST('1998-02-01' AS TIMESTAMP)")(
    lambda j: tables.scope_count(j.emails, "1998-01-02", "1998-02-01", 200)
)
query("s02_x01_point_lookup", "SELECT id, company, current_status FROM <applications> WHERE id = '7'")(lambda j: j.apps.where("id = '7'").select("id", "company", "current_status"))
query("s14_companies_by_length", "SELECT DISTINCT company FROM <applications> ORDER BY length(company) DESC, company")(lambda j: tables.by_length(j.apps))
query("s15_mail_ids", "SELECT id FROM <raw_emails> WHERE provider = 'gmail' ORDER BY id")(lambda j: tables.mail_ids(j.emails, "gmail"))
query("s06_first_added", "SELECT user_id, min(event_id) AS event_id FROM <events> GROUP BY 1")(
    lambda j: j.view("events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
)
#: Bodies of known bytes: long ones are cut inside a character of two bytes.
_LONG = {"long_bodies": "SELECT CAST(doc_id AS STRING) AS id, repeat('aé', CAST(500 + doc_id % 3 * 500 AS INT)) || 'z' AS body_text, doc_id % 3 AS kind FROM <documents>"}
query("s11_decoded_bodies", "SELECT id, CASE kind WHEN 0 THEN body_text ELSE repeat('aé', 666) || 'a' END AS body FROM <long_bodies>", _LONG)(
    lambda j: j.view("long_bodies", _LONG).select("id", F.translate(F.base64(F.encode("body_text", "UTF-8")), "+/=\r\n", "-_").alias("data")).select("id", mail.decoded(F.col("data"), 2000).alias("body"))
)
query("s11_whole_bodies", "SELECT id, body_text AS body FROM <raw_emails> WHERE body_text IS NOT NULL")(
    lambda j: j.emails.where("body_text IS NOT NULL").select("id", mail.decoded(F.translate(F.base64(F.encode("body_text", "UTF-8")), "+/=\r\n", "-_")).alias("body"))
)


def _payloads(j: JobSearch) -> DataFrame:
    data = F.translate(F.base64(F.encode("html", "UTF-8")), "+/=\r\n", "-_")
    part = F.struct(F.lit("text/html; charset=utf-8").alias("mimeType"), F.struct(data.alias("data")).alias("body"))
    return j.view("pages").select("page_id", F.to_json(F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(part).alias("parts"))).alias("payload"))


#: Payloads whose data is sound, not base64, not text, or missing.
def _mixed(j: JobSearch) -> DataFrame:
    data = F.when(F.col("page_id") % 4 == 0, F.lit("YWJj")).when(F.col("page_id") % 4 == 1, F.lit("//79")).when(F.col("page_id") % 4 == 2, F.lit("é"))
    kind = F.when(F.col("page_id") % 4 == 3, "image/png").otherwise("text/plain")
    return j.view("pages").select("page_id", F.to_json(F.struct(kind.alias("mimeType"), F.struct(data.alias("data")).alias("body"))).alias("payload"))


query("s09_body_failures", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'unsupported_content' ELSE 'invalid_body_data' END AS reason FROM <pages> WHERE page_id % 4 <> 0")(lambda j: mail.bodies_and_failures(_mixed(j))[1])
query("s08_fetched_bodies", "SELECT page_id, 'abc' AS body_text, 'plain' AS source, false AS truncated FROM <pages> WHERE page_id % 4 = 0")(lambda j: mail.bodies_and_failures(_mixed(j))[0])
_HTML = {"labelled_plain": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN chr(60) || 'p>kept' || chr(60) || '/p>' ELSE 'a < b and c > d ' || CAST(page_id AS STRING) END AS body_text FROM <pages>"}
query("x25_plain_bodies", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'kept' ELSE body_text END AS body_text, CASE WHEN page_id % 2 = 0 THEN 'html_converted' ELSE 'plain' END AS source FROM <labelled_plain>", _HTML)(
    lambda j: mail.plain_bodies(j.view("labelled_plain", _HTML))
)
query("s10_retained_bodies")(lambda j: _payloads(j).select("page_id", mail.retained_body(F.col("payload")).alias("b")).select("page_id", "b.*"))


def _streamed(j: JobSearch) -> DataFrame:
    events = j.view("events")
    stream = activity(j.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(j.sf_dir))
    name = f"activity_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()  # a row a day and type
    return j.spark.table(name)


query("st01_streamed_activity", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM <events> GROUP BY 1, 2")(_streamed)


def _template(name: str):
    def run(j: JobSearch) -> DataFrame:
        window = DateWindow("this_year") if name in ("total_applications", "application_list", "company_list") else None
        return Asker(j, _NOW).ask(Request(name, dimension="seniority" if name == "breakdown" else None, window=window, zone="Europe/Berlin" if window else "UTC")).rows

    return run


_YEAR = "first_seen_at >= CAST('1997-12-31 23:00:00' AS TIMESTAMP) AND first_seen_at < CAST('1998-12-31 23:00:00' AS TIMESTAMP)"
_SQL = {
    "total_applications": f"SELECT count(*) AS applications FROM <submitted> WHERE {_YEAR}",
    "application_list": f"SELECT * FROM <submitted> WHERE {_YEAR} ORDER BY first_seen_at DESC, lower(company), lower(role_title), id LIMIT 20",
    "company_list": f"""SELECT company, sum(n)::BIGINT AS application_count, string_agg(role, '|' ORDER BY r, role) AS role_titles, array_to_string(flatten(list(ids ORDER BY r)), '|') AS application_ids FROM (
        SELECT lower(trim(company)) AS company, lower(trim(role_title)) AS r, min(trim(role_title)) AS role, count(*) AS n, list(id ORDER BY trim(role_title), id) AS ids FROM <submitted> WHERE trim(company) <> '' AND {_YEAR} GROUP BY 1, 2) x GROUP BY 1 ORDER BY 1 LIMIT 20""",
    "application_timeseries": "SELECT strftime(first_seen_at, '%Y-%m-%d') AS period_start, count(*) AS applications FROM <flagged> GROUP BY 1",
    "response_rate_timeseries": "SELECT strftime(first_seen_at, '%Y-%m-%d') AS period_start, count(*) FILTER (WHERE has_response) / count(*) AS response_rate FROM <flagged> GROUP BY 1",
    "breakdown": "SELECT *, response_count / application_count AS response_rate, interview_count / application_count AS interview_rate, offer_count / application_count AS offer_rate FROM <broken_down> WHERE dimension = 'seniority'",
    "busiest_application_month": "SELECT month_start, n AS application_count FROM (SELECT strftime(first_seen_at, '%Y-%m-01') AS month_start, count(*) AS n FROM <submitted> GROUP BY 1) x QUALIFY rank() OVER (ORDER BY n DESC) = 1",
}
_SEGMENTS_OF = {
    "successful_application_segments": (("successful", "success_count > 0 AND success_rate_lift > 0", "success_rate_lift DESC, success_count DESC, application_count DESC, dimension, value", 3),),
    "negative_outcome_segments": (("negative", "negative_count > 0 AND negative_rate_lift > 0", "negative_rate_lift DESC, negative_count DESC, application_count DESC, dimension, value", 3),),
    "strongest_response_correlate": (("strongest", "response_rate_lift > 0", "response_rate_lift DESC, application_count DESC, dimension, value", 1),),
    "wasted_effort_segments": (("weakest", "response_rate_lift < 0", "response_rate_lift, application_count DESC, dimension, value", 3),),
    "best_roi_source": (("best_source", "dimension = 'source'", "interview_rate DESC, interview_count DESC, application_count DESC, value", 1),),
    "sponsorship_response_impact": (("sponsorship_impact", "dimension = 'sponsorship'", "response_rate_lift, application_count DESC, value", 1),),
    "skill_signal_segments": (
        ("selling_skills", "dimension = 'tech' AND interview_count > 0", "interview_rate DESC, interview_count DESC, application_count DESC, value", 3),
        ("dead_weight_skills", "dimension = 'tech' AND response_rate_lift < 0", "response_rate_lift, application_count DESC, value", 3),
    ),
    "adjacent_role_suggestions": (("adjacent_roles", "dimension = 'role' AND success_count > 0", "success_rate DESC, success_count DESC, application_count DESC, value", 3),),
}
for _name, _parts in _SEGMENTS_OF.items():
    _SQL[_name] = " UNION ALL ".join(f"SELECT * FROM (SELECT *, '{k}' AS highlight FROM <segments> WHERE {w} ORDER BY {o} LIMIT {n}) {k}" for k, w, o, n in _parts)
_RAW = {k: RAW_SQL[k] for k in ("a36_summary", "a16_rates", "a17_funnel", "a10_first_response_time", "a11_rejection_time", "a14_silence_histogram", "l19_live_applications")}
_VIEWS = {k: v for _, views in _RAW.values() for k, v in views.items()} | VIEWS
_SQL |= {
    "summary_counts": _RAW["a36_summary"][0],
    "rates": _RAW["a16_rates"][0],
    "funnel": _RAW["a17_funnel"][0],
    "timing": f"SELECT *, 'first_response' AS name FROM ({_RAW['a10_first_response_time'][0]}) a UNION ALL SELECT *, 'rejection' AS name FROM ({_RAW['a11_rejection_time'][0]}) b",
    "personal_ghost_threshold": f"SELECT *, 30 AS threshold_days FROM ({_RAW['a14_silence_histogram'][0]}) h",
    "live_applications": f"SELECT * FROM ({_RAW['l19_live_applications'][0]}) l ORDER BY days_waiting DESC, id LIMIT 20",
}
for _name in TEMPLATES:
    query(f"q01_{_name}", _SQL.get(_name), _VIEWS)(_template(_name))
