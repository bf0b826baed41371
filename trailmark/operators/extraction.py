"""Answers of a classifying model, checked and split into accepted extractions and quarantined ones.

The model itself is external: its raw answers come in as rows.  Every check is an expression over the answer's text and its parsed
variant, so the whole split is one narrow pass without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema

# The fields of an answer, and which status and events go with a category.
REQUIRED = (
    "is_job_related", "category", "confidence", "company", "role_title", "application_status", "event_type", "event_at", "salary_min", "salary_max", "currency", "location", "work_mode",
    "seniority", "sponsorship", "tech_stack", "rejection_reason",
)
OPTIONAL = ("source",)
CATEGORIES = (*schema.LIFECYCLE_CATEGORIES, *schema.GENERAL_CATEGORIES)
STATUS_OF_CATEGORY = {"application_confirmation": "applied", "rejection": "rejected", "interview_invite": "interview", "offer": "offer", "assessment": "assessment"}
EVENTS_OF_CATEGORY = {
    "application_confirmation": ("applied",), "rejection": ("rejection",), "interview_invite": ("interview_scheduled",), "offer": ("offer",), "assessment": ("assessment",),
    "follow_up": ("feedback", "response"), "other": ("feedback", "response"),
}
WORK_MODES, SPONSORSHIPS = ("remote", "hybrid", "onsite"), ("offered", "not_offered", "unknown")
TEXTS = ("company", "role_title", "location", "seniority", "rejection_reason")
REASONS = ("incomplete_generation", "invalid_json", "duplicate_json_key", "invalid_schema")


@dataclass(frozen=True)
class Answers:
    """accepted: the classification and extraction columns; malformed: email_id, model, prompt_version, reason."""

    accepted: DataFrame
    malformed: DataFrame


def _kind(name: str) -> Column:
    """The JSON type of a field: VOID for null, null where it is missing."""
    return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))


def _text(name: str) -> Column:
    return F.trim(F.try_variant_get("v", f"$.{name}", "string"))


def _one_of(name: str, allowed: tuple[str, ...], nullable: bool = True) -> Column:
    fits = (_kind(name) == "STRING") & _text(name).isin(*allowed)
    return fits | (_kind(name) == "VOID") if nullable else fits


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _number(name: str) -> Column:
    return _kind(name).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def event_time() -> Column:
    """The event's time as UTC: an ISO date or date and time; numbers are no times."""
    iso = _text("event_at")
    return F.when(iso.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?$"), F.to_utc_timestamp(iso.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))


def _sound_fields() -> Column:
    """Every field has its type and range."""
    whole = lambda n: (_kind(n) == "VOID") | ((_kind(n) == "BIGINT") & (F.try_variant_get("v", f"$.{n}", "long") >= 0))
    low, high = (F.try_variant_get("v", f"$.{n}", "long") for n in ("salary_min", "salary_max"))
    skills = F.try_variant_get("v", "$.tech_stack", "array<variant>")
    spelled = F.forall(skills, lambda x: (F.schema_of_variant(x) == "STRING") & (F.trim(F.try_variant_get(x, "$", "string")) != ""))
    return _all(
        [
            _kind("is_job_related") == "BOOLEAN",
            _one_of("category", CATEGORIES, nullable=False),
            _number("confidence") & F.try_variant_get("v", "$.confidence", "double").between(0, 1),
            *[(_kind(n) == "VOID") | ((_kind(n) == "STRING") & (_text(n) != "")) for n in TEXTS],
            F.when(_kind("source").isNotNull(), _one_of("source", schema.SOURCES, nullable=False)).otherwise(True),
            _one_of("application_status", schema.STATUSES),
            _one_of("event_type", schema.EVENT_TYPES),
            (_kind("event_at") == "VOID") | ((_kind("event_at") == "STRING") & event_time().isNotNull()),
            whole("salary_min"),
            whole("salary_max"),
            F.coalesce(low <= high, F.lit(True)),
            (_kind("currency") == "VOID") | ((_kind("currency") == "STRING") & _text("currency").rlike("^[A-Z]{3}$")),
            _one_of("work_mode", WORK_MODES),
            _one_of("sponsorship", SPONSORSHIPS, nullable=False),
            F.startswith(_kind("tech_stack"), F.lit("ARRAY")) & spelled,
        ]
    )


def _consistent() -> Column:
    """Status and event go with the category; unrelated mail tells nothing."""
    category, status, event = _text("category"), _text("application_status"), _text("event_type")
    told = F.lit(None).cast("string")
    allowed = F.lit(False)
    for c, s in STATUS_OF_CATEGORY.items():
        told = F.when(category == c, s).otherwise(told)
    for c, events in EVENTS_OF_CATEGORY.items():
        allowed = allowed | ((category == c) & event.isin(*events))
    related = status.eqNullSafe(told) & F.when(told.isNull(), event.isNull() | F.coalesce(allowed, F.lit(False))).otherwise(F.coalesce(allowed, F.lit(False)))
    empty = _all([_kind(n) == "VOID" for n in (*TEXTS, "application_status", "event_type", "event_at", "salary_min", "salary_max", "currency", "work_mode")])
    nothing = (category == "other") & empty & (F.coalesce(_text("source"), F.lit("other")) == "other") & (_text("sponsorship") == "unknown") & (F.size(F.try_variant_get("v", "$.tech_stack", "array<variant>")) == 0)
    return F.when(F.try_variant_get("v", "$.is_job_related", "boolean"), related).otherwise(F.coalesce(nothing, F.lit(False)))


def judged(answers: DataFrame) -> DataFrame:
    """Adds v (the parsed answer) and reason, null where it is accepted.  answers: email_id, content, finish_reason, model, prompt_version, classified_at."""
    keys = F.json_object_keys("content")
    parsed = answers.withColumn("v", F.try_parse_json("content")).withColumn("keys", keys)
    doubled = F.coalesce(F.size(F.array_distinct("keys")) < F.size("keys"), F.lit(False))
    known = F.array(*map(F.lit, (*REQUIRED, *OPTIONAL)))
    shaped = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")) & (F.size(F.array_except("keys", known)) == 0) & (F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "keys")) == 0)
    reason = (
        F.when(~F.col("finish_reason").eqNullSafe("stop"), "incomplete_generation")
        .when(doubled, "duplicate_json_key")
        .when(F.col("v").isNull(), "invalid_json")
        .when(~F.coalesce(shaped, F.lit(False)) | ~F.coalesce(_sound_fields() & _consistent(), F.lit(False)), "invalid_schema")
    )
    return parsed.withColumn("reason", reason).drop("keys")


def split(answers: DataFrame) -> Answers:
    """Accepted and malformed answers."""
    j = judged(answers)
    number = lambda n: F.try_variant_get("v", f"$.{n}", "long").alias(n)
    accepted = j.where("reason IS NULL").select(
        "email_id", "model", "prompt_version", "classified_at",
        F.try_variant_get("v", "$.is_job_related", "boolean").alias("is_job_related"), _text("category").alias("category"), F.try_variant_get("v", "$.confidence", "double").alias("confidence"),
        _text("company").alias("company"), _text("role_title").alias("role_title"), F.coalesce(_text("source"), F.lit("other")).alias("source"), _text("application_status").alias("status"),
        _text("event_type").alias("event_type"), event_time().alias("event_at"), number("salary_min"), number("salary_max"),
        *[_text(n).alias(n) for n in ("currency", "location", "work_mode", "seniority", "sponsorship")],
        F.transform(F.try_variant_get("v", "$.tech_stack", "array<string>"), lambda x: F.trim(x)).alias("tech_stack"), _text("rejection_reason").alias("rejection_reason"),
    )
    return Answers(accepted, j.where("reason IS NOT NULL").select("email_id", "model", "prompt_version", "reason"))


def run_record(answers: DataFrame) -> DataFrame:
    """One row: candidates, how many were accepted, quarantined by reason, and the tokens used, never less than their parts."""
    total = F.greatest("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    of = lambda r: F.coalesce(F.sum((F.col("reason") == r).cast("long")), F.lit(0)).alias(r)
    return judged(answers).agg(F.count("*").alias("candidates"), F.coalesce(F.sum(F.col("reason").isNull().cast("long")), F.lit(0)).alias("accepted"), *[of(r) for r in REASONS], F.coalesce(F.sum(total), F.lit(0)).alias("tokens"))
