"""Table files: fixtures, golden sets, and snapshot versions of mutable tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import schema

EMAILS = "id string, provider string, thread_id string, from_addr string, to_addr string, subject string, sent_at timestamp, body_text string, body_retention_state string, labels array<string>, ingested_at timestamp"
CLASSIFICATIONS = "email_id string, is_job_related boolean, category string, confidence double, model string, prompt_version string, classified_at timestamp"
APPLICATIONS = (
    "id string, company string, role_title string, source string, first_seen_at timestamp, current_status string, salary_min bigint, salary_max bigint, currency string, location string, "
    "work_mode string, seniority string, sponsorship string, tech_stack array<string>, last_activity_at timestamp, manual_lock boolean, created_at timestamp, updated_at timestamp"
)
EVENTS = "id string, application_id string, email_id string, event_type string, event_at timestamp, extract_note string"
GOLDEN = "schema_version string, case_id string, rationale string, contains_private_data boolean, expected_to_pass_filter boolean, email struct<provider: string, from_addr: string, subject: string, body_text: string>, expected struct<is_job_related: boolean, category: string>"


def _array(columns: str) -> str:
    return "array<struct<" + ", ".join(c.strip().replace(" ", ": ", 1) for c in columns.split(", ")) + ">>"


FIXTURE = f"schema_version string, fixture_id string, description string, contains_private_data boolean, emails {_array(EMAILS)}, classifications {_array(CLASSIFICATIONS)}, applications {_array(APPLICATIONS)}, events {_array(EVENTS)}"


def read_fixture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a job-search fixture file, checked; times are UTC.  Raises ValueError with all problems found."""
    raw = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    tables = {}
    for name in ("emails", "classifications", "applications", "events"):
        t = raw.select(F.inline(name))
        tables[name] = t.withColumns({c: F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz") for c, k in t.dtypes if k == "timestamp"})
    tables["emails"] = tables["emails"].withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).withColumn("body_retention_state", F.coalesce("body_retention_state", F.lit("metadata_only")))
    if problems := [tuple(r) for r in fixture_problems(tables).orderBy("problem", "id").limit(20).collect()]:
        raise ValueError(f"the fixture is unsound: {problems}")
    return tables


def fixture_problems(t: dict[str, DataFrame]) -> DataFrame:
    """problem, id: repeated ids, references to nothing, values out of range."""

    def named(df: DataFrame, problem: str, key: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(key).alias("id"))

    def missing(df: DataFrame, key: str, parent: DataFrame, problem: str, own: str) -> DataFrame:
        return named(df.where(F.col(key).isNotNull()).join(parent.select(F.col("id").alias(key)).distinct(), key, "left_anti"), problem, own)

    out = [named(t[n].groupBy(k).count().where("count > 1"), f"repeated {n}", k) for n, k in (("emails", "id"), ("classifications", "email_id"), ("applications", "id"), ("events", "id"))]
    out += [
        missing(t["classifications"], "email_id", t["emails"], "classification without e-mail", "email_id"),
        missing(t["events"], "application_id", t["applications"], "event without application", "id"),
        missing(t["events"], "email_id", t["emails"], "event without e-mail", "id"),
        named(t["events"].where("(email_id IS NULL) <> (event_type = 'ghost_inferred')"), "only ghosts have no e-mail", "id"),
        named(t["emails"].where("(body_text IS NULL) <> (body_retention_state = 'metadata_only')"), "body against retention state", "id"),
        named(t["classifications"].where("NOT confidence BETWEEN 0 AND 1"), "confidence out of range", "email_id"),
        named(t["applications"].where(~F.col("current_status").isin(*schema.STATUSES)), "unknown status", "id"),
        named(t["applications"].where("salary_min < 0 OR salary_min > salary_max"), "salary range", "id"),
    ]
    union = out[0]
    for df in out[1:]:
        union = union.unionByName(df)
    return union


def read_golden_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def write_version(df: DataFrame, folder: str) -> str:
    """Writes a table's next version beside the last one; a version is whole once its _SUCCESS file is there."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def by_length(apps: DataFrame) -> DataFrame:
    """Distinct companies, longest name first."""
    return apps.select("company").distinct().orderBy(F.length("company").desc(), "company")


def mail_ids(emails: DataFrame, provider: str) -> DataFrame:
    return emails.where(F.col("provider") == provider).select("id").orderBy("id")


def scope_count(emails: DataFrame, start: str | None, end: str | None, most: int) -> DataFrame:
    """How many mails a date window has, counted up to a limit (S07, S12): the filter reaches the scan."""
    at = F.col("sent_at")
    kept = emails
    if start is not None:
        kept = kept.where(at >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        kept = kept.where(at < F.lit(end).cast("timestamp_ntz"))
    return kept.select("id").limit(most).agg(F.count("*").alias("messages"))
