"""Breakdown dimensions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def salary_band() -> Column:
    """Below 100k by the upper end, 150k and more by the lower end."""
    high, low = F.coalesce("salary_max", "salary_min"), F.coalesce("salary_min", "salary_max")
    return F.when(high.isNull(), "unknown").when(high < 100000, "under_100k").when(low >= 150000, "150k_plus").otherwise("100k_149k")


def seniority_bucket() -> Column:
    words = F.concat(F.lit(" "), F.translate(F.lower(F.trim(F.coalesce("seniority", F.lit("")))), ".-/_", "    "), F.lit(" "))
    has = lambda *w: F.array_max(F.array(*[words.contains(f" {x} ") for x in w]))
    return (
        F.when(F.trim(F.coalesce("seniority", F.lit(""))) == "", "unknown")
        .when(has("lead", "staff", "principal"), "lead")
        .when(has("senior", "sr"), "senior")
        .when(has("junior", "jr", "entry", "intern", "graduate"), "junior")
        .when(has("mid", "intermediate"), "mid")
        .otherwise("unknown")
    )


def scalar_dimensions() -> dict[str, Column]:
    """Every dimension but tech; company_type and industry come from the joined company profile."""
    return {
        "role": _or_unknown(F.lower(F.trim("role_title"))),
        "source": _or_unknown(F.col("source")),
        "salary": salary_band(),
        "company_type": _or_unknown(F.col("company_type")),
        "industry": _or_unknown(F.lower(F.trim("industry"))),
        "sponsorship": _or_unknown(F.col("sponsorship")),
        "seniority": seniority_bucket(),
        "work_mode": _or_unknown(F.col("work_mode")),
    }
