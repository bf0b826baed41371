"""Application filters as lists of column predicates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema


@dataclass(frozen=True)
class MetricsFilter:
    """Conjunctive application filter; None means any."""

    status: str | None = None
    source: str | None = None
    sponsorship: str | None = None
    first_seen_from: dt.datetime | None = None
    first_seen_to: dt.datetime | None = None
    role: str | None = None
    salary_min: int | None = None
    salary_max: int | None = None
    work_mode: str | None = None

    def __post_init__(self) -> None:
        for value, allowed in ((self.status, schema.STATUSES), (self.source, schema.SOURCES)):
            if value is not None and value not in allowed:
                raise ValueError(f"unknown value {value!r}")
        if self.salary_min is not None and self.salary_max is not None and self.salary_min > self.salary_max:
            raise ValueError("salary_min is above salary_max")

    def conditions(self) -> list[Column]:
        """Both ends of first_seen are inclusive; salary ranges match where they overlap; the role is a case-insensitive substring, taken literally."""
        out = [F.col(c) == v for c, v in (("current_status", self.status), ("source", self.source), ("sponsorship", self.sponsorship), ("work_mode", self.work_mode)) if v is not None]
        if self.first_seen_from is not None:
            out.append(F.col("first_seen_at") >= F.lit(self.first_seen_from).cast("timestamp_ntz"))
        if self.first_seen_to is not None:
            out.append(F.col("first_seen_at") <= F.lit(self.first_seen_to).cast("timestamp_ntz"))
        if self.role is not None and self.role.strip():
            out.append(F.lower("role_title").contains(self.role.strip().lower()))
        if self.salary_min is not None:
            out.append(F.coalesce("salary_max", "salary_min") >= self.salary_min)
        if self.salary_max is not None:
            out.append(F.coalesce("salary_min", "salary_max") <= self.salary_max)
        return out

    def apply(self, apps: DataFrame) -> DataFrame:
        return apps.where(reduce(and_, self.conditions())) if self.conditions() else apps


def is_general() -> Column:
    return F.col("is_job_related") & F.col("category").isin(*schema.GENERAL_CATEGORIES)


def is_lifecycle(classified: str) -> Column:
    """Of an event: its mail, if any, has no classification (``classified`` is null), or one of an application's life."""
    return F.col(classified).isNull() | F.col("category").isin(*schema.LIFECYCLE_CATEGORIES)


def not_submitted(events: DataFrame, classes: DataFrame) -> DataFrame:
    """application_id of applications that only general job mail speaks for (P01), in one aggregate."""
    c = classes.select(F.col("email_id").alias("c_email"), "is_job_related", "category")
    linked = events.select("application_id", "email_id").join(c, F.col("email_id") == F.col("c_email"), "left")
    general, lifecycle = is_general(), is_lifecycle("c_email")
    seen = linked.groupBy("application_id").agg(F.max(F.coalesce(general, F.lit(False))).alias("general"), F.max(F.coalesce(lifecycle, F.lit(False))).alias("lifecycle"))
    return seen.where("general AND NOT lifecycle").select("application_id")


def submitted(apps: DataFrame, events: DataFrame, classes: DataFrame, f: MetricsFilter | None = None) -> DataFrame:
    """Applications that count: the filter's, without those of P01."""
    kept = (f or MetricsFilter()).apply(apps)
    return kept.join(not_submitted(events, classes).withColumnRenamed("application_id", "id"), "id", "left_anti")
