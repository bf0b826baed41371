"""Segments compared with the overall rates, and the highlights drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.operators.metrics import broken_down, count_if, narrow


def segments(f: DataFrame, profiles: DataFrame, tech: DataFrame, dimensions: tuple[str, ...] = schema.DIAGNOSTIC_DIMENSIONS) -> DataFrame:
    """All dimensions and values with rates and their lift over the baseline."""
    f = narrow(f)
    base = f.agg(
        F.count("*").alias("n"),
        count_if(F.col("has_response")).alias("response"),
        count_if(F.col("has_success")).alias("success"),
        count_if(F.col("current_status").isin(*schema.NEGATIVE_STATUSES)).alias("negative"),
    ).select(*[F.try_divide(c, "n").alias(f"base_{c}_rate") for c in ("response", "success", "negative")])
    own = broken_down(f, profiles, tech, dimensions).withColumns({f"{k}_rate": F.col(f"{k}_count") / F.col("application_count") for k in ("success", "negative")})
    wide = own.join(F.broadcast(base))  # the baseline is one row
    return wide.withColumns({f"{k}_rate_lift": F.col(f"{k}_rate") - F.col(f"base_{k}_rate") for k in ("response", "success", "negative")}).drop(*[f"base_{k}_rate" for k in ("response", "success", "negative")])


def _top(s: DataFrame, condition: Column | str, order: list[str], n: int) -> DataFrame:
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    return s.where(condition).orderBy(*by).limit(n)


def highlights(s: DataFrame, n: int = schema.HIGHLIGHTS) -> dict[str, DataFrame]:
    """Each is a top-k of the segments; wasted effort is the weakest list, the strongest correlate the first of the strongest."""
    tail = ["-application_count", "dimension", "value"]
    return {
        "strongest": _top(s, "response_rate_lift > 0", ["-response_rate_lift", *tail], n),
        "weakest": _top(s, "response_rate_lift < 0", ["response_rate_lift", *tail], n),
        "successful": _top(s, "success_count > 0 AND success_rate_lift > 0", ["-success_rate_lift", "-success_count", *tail], n),
        "negative": _top(s, "negative_count > 0 AND negative_rate_lift > 0", ["-negative_rate_lift", "-negative_count", *tail], n),
        "best_source": _top(s, "dimension = 'source'", ["-interview_rate", "-interview_count", *tail], 1),
        "sponsorship_impact": _top(s, "dimension = 'sponsorship' AND response_rate_lift IS NOT NULL", ["response_rate_lift", *tail], 1),
        "selling_skills": _top(s, "dimension = 'tech' AND interview_count > 0", ["-interview_rate", "-interview_count", *tail], n),
        "dead_weight_skills": _top(s, "dimension = 'tech' AND response_rate_lift < 0", ["response_rate_lift", *tail], n),
        "adjacent_roles": _top(s, "dimension = 'role' AND success_count > 0", ["-success_rate", "-success_count", *tail], n),
    }
