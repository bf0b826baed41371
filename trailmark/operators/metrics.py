"""Counts, rates, funnels, timing, silence and breakdowns over the feature table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.functions.dimensions import scalar_dimensions
from trailmark.sources.shared import cut


def rows(one: DataFrame, name: str, value: str, columns: list[str]) -> DataFrame:
    """One row of several columns as (name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("long").alias(value)) for c in columns])
    return one.select(F.explode(pairs).alias("r")).select("r.*")


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def count_between(f: DataFrame, start: str, end: str) -> DataFrame:
    at = F.col("first_seen_at")
    return f.where((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))).agg(F.count("*").alias("applications"))


def distinct_companies(f: DataFrame) -> DataFrame:
    return f.agg(F.count_distinct(F.nullif(F.lower(F.trim("company")), F.lit(""))).alias("companies"))


def applications_with_event(f: DataFrame) -> DataFrame:
    one = f.agg(count_if(F.col("has_offer")).alias("offer"), count_if(F.col("has_rejection")).alias("rejection"), count_if(F.col("has_interview")).alias("interview_scheduled"))
    return rows(one, "event_type", "applications", ["offer", "rejection", "interview_scheduled"])


def companies_with_interview() -> Column:
    return F.count_distinct(F.when(F.col("has_interview"), F.nullif(F.lower(F.trim("company")), F.lit(""))))


def outcomes(f: DataFrame) -> DataFrame:
    """Success is told by events, a negative outcome by the status."""
    return f.agg(count_if(F.col("has_success")).alias("successful"), count_if(F.col("current_status").isin(*schema.NEGATIVE_STATUSES)).alias("negative"))


def live(f: DataFrame, active_after: str) -> DataFrame:
    kept = F.col("current_status").isin(*schema.LIVE_STATUSES) & (F.col("last_activity_at") >= F.lit(active_after).cast("timestamp_ntz"))
    return f.agg(count_if(kept).alias("live"))


def response_silence(f: DataFrame) -> DataFrame:
    one = f.agg(F.count("*").alias("total_applications"), count_if(F.col("has_response")).alias("human_response_count"))
    return one.withColumn("silent_count", F.col("total_applications") - F.col("human_response_count"))


def hours(a: str, b: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / 3.6e9


def average_hours(f: DataFrame, to: str) -> DataFrame:
    """Applications that have the event, and the mean hours from first_seen_at to it."""
    return f.where(F.col(to).isNotNull()).agg(F.count("*").alias("applications"), F.round(F.avg(hours("first_seen_at", to)), 6).alias("average_hours"))


def whole_days(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", a, b) / 86400)).cast("long")


def first_response_days(f: DataFrame) -> DataFrame:
    return f.where("first_response_at IS NOT NULL").select(F.col("id").alias("application_id"), whole_days(F.col("first_seen_at"), F.col("first_response_at")).alias("days"))


def silent_ages(f: DataFrame, clock: str) -> DataFrame:
    """Whole days since the latest applied event, where no response came after it."""
    kept = f.where("latest_applied IS NOT NULL AND current_status <> 'withdrawn' AND NOT answered")
    return kept.select(F.col("id").alias("application_id"), whole_days(F.col("latest_applied.event_at"), F.lit(clock).cast("timestamp_ntz")).alias("days"))


def silence_histogram(f: DataFrame, clock: str) -> DataFrame:
    """All five buckets, also empty ones."""
    days = F.col("days")
    one = silent_ages(f, clock).agg(*[count_if((days >= low) & (days <= high) if high else days >= low).alias(name) for name, low, high in schema.SILENCE_BUCKETS])
    return rows(one, "bucket", "applications", [b[0] for b in schema.SILENCE_BUCKETS])


def _ghost(cutoff: str) -> Column:
    """Applied, no event but ghosts after the cutoff, no response after the latest applied event."""
    return F.col("latest_applied").isNotNull() & (F.col("latest_non_ghost.event_at") <= F.lit(cutoff).cast("timestamp_ntz")) & ~F.col("answered")


def ghosted(f: DataFrame, cutoff: str) -> DataFrame:
    return f.agg(count_if(_ghost(cutoff)).alias("ghosted"))


def rates(f: DataFrame, cutoff: str) -> DataFrame:
    """Five rates; a rate without a denominator is null."""
    n, counts = F.count("*"), {
        "response": (F.col("has_response"), None),
        "rejection": (F.col("has_rejection"), None),
        "ghost": (_ghost(cutoff), None),
        "application_to_interview": (F.col("has_interview"), None),
        "interview_to_offer": (F.col("offer_after_interview"), F.col("has_interview")),
    }
    one = f.agg(*[c.alias(a) for k, (num, den) in counts.items() for a, c in ((f"{k}_n", count_if(num)), (f"{k}_d", n if den is None else count_if(den)))])
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"{k}_n").alias("numerator"), F.col(f"{k}_d").alias("denominator"), F.try_divide(F.col(f"{k}_n"), F.col(f"{k}_d")).alias("rate")) for k in counts])
    return one.select(F.explode(each).alias("r")).select("r.*")


def funnel(f: DataFrame) -> DataFrame:
    """Applications, responded applications, companies that interviewed, 0 (not tracked), offers after an interview."""
    stages = ["applied", "screen", "interview", "final", "offer"]
    one = f.agg(F.count("*").alias("applied"), count_if(F.col("has_response")).alias("screen"), companies_with_interview().alias("interview"), F.lit(0).alias("final"), count_if(F.col("offer_after_interview")).alias("offer"))
    return rows(one, "stage", "count", stages)


def daily(f: DataFrame) -> DataFrame:
    """Applications and response rate by the UTC day of first_seen_at; days without applications are left out."""
    by = f.groupBy(F.date_format("first_seen_at", "yyyy-MM-dd").alias("period_start")).agg(F.count("*").alias("applications"), count_if(F.col("has_response")).alias("responses"))
    return by.withColumn("response_rate", F.col("responses") / F.col("applications"))


def dimension_rows(f: DataFrame, profiles: DataFrame, tech: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Each application once for each dimension (for tech, once for each skill): one pass for all of them."""
    p = profiles.select("normalized_company", "company_type", "industry")
    wide = f.join(p, F.lower(F.trim("company")) == F.col("normalized_company"), "left") if {"company_type", "industry"} & set(dimensions) else f
    keep = ["has_response", "has_interview", "has_offer", "has_success", "current_status"]
    named = {k: v for k, v in scalar_dimensions().items() if k in dimensions}
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in named.items()])
    out = wide.select(*keep, F.explode(each).alias("d")).select("d.*", *keep) if named else None
    if "tech" in dimensions:
        skill = tech.where(F.trim("skill") != "").select(F.col("application_id").alias("id"), F.lower(F.trim("skill")).alias("value")).distinct()
        skilled = f.join(skill, "id").select(F.lit("tech").alias("dimension"), "value", *keep)
        out = skilled if out is None else out.unionByName(skilled)
    return out


def narrow(f: DataFrame) -> DataFrame:
    """What dimensions need of the feature table, written once: scalar dimensions, skills and a baseline all read it."""
    columns = ["id", "company", "role_title", "source", "salary_min", "salary_max", "sponsorship", "seniority", "work_mode", "has_response", "has_interview", "has_offer", "has_success", "current_status"]
    return cut(f.select(*columns), "features")


def breakdown(f: DataFrame, profiles: DataFrame, tech: DataFrame, dimensions: tuple[str, ...] = schema.DIMENSIONS) -> DataFrame:
    """Counts, rates, successes and negative outcomes by dimension and value."""
    return broken_down(narrow(f) if len(dimensions) > 1 and "tech" in dimensions else f, profiles, tech, dimensions)


def broken_down(f: DataFrame, profiles: DataFrame, tech: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    by = dimension_rows(f, profiles, tech, dimensions).groupBy("dimension", "value").agg(
        F.count("*").alias("application_count"),
        count_if(F.col("has_response")).alias("response_count"),
        count_if(F.col("has_interview")).alias("interview_count"),
        count_if(F.col("has_offer")).alias("offer_count"),
        count_if(F.col("has_success")).alias("success_count"),
        count_if(F.col("current_status").isin(*schema.NEGATIVE_STATUSES)).alias("negative_count"),
    )
    return by.withColumns({f"{k}_rate": F.col(f"{k}_count") / F.col("application_count") for k in ("response", "interview", "offer")})


def busiest_months(f: DataFrame, zone: str = "UTC") -> DataFrame:
    """The months, in a time zone, that most applications were first seen in; all ties."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("first_seen_at"))
    by = f.groupBy(F.date_format(local, "yyyy-MM-01").alias("month_start")).agg(F.count("*").alias("application_count"))
    top = by.agg(F.max("application_count").alias("most"))
    return by.join(F.broadcast(top), F.col("application_count") == F.col("most")).select("month_start", "application_count")  # one row is broadcast


def companies(f: DataFrame, limit: int = schema.LIST_LIMIT) -> DataFrame:
    """The first companies by normalised name: applications, their ids by role, and roles distinct but for case, first spelling shown."""
    keyed = f.select(F.lower(F.trim("company")).alias("company"), F.trim("role_title").alias("role"), "id").where("company <> ''")
    first = keyed.select("company").distinct().orderBy("company").limit(min(limit, schema.LIST_MAXIMUM))
    some = keyed.join(F.broadcast(first), "company")  # LIST_MAXIMUM rows are broadcast
    by_role = some.groupBy("company", F.lower("role").alias("r")).agg(F.min("role").alias("role"), F.collect_list(F.struct(F.lower("role").alias("r"), "role", "id")).alias("apps"))
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "role"))), lambda x: x["role"]), "|")
    ids = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("apps"))), lambda x: x["id"]), "|")
    return by_role.groupBy("company").agg(F.sum(F.size("apps")).alias("application_count"), roles.alias("role_titles"), ids.alias("application_ids")).orderBy("company")


def status_counts(apps: DataFrame) -> DataFrame:
    """Every status, also without applications."""
    one = apps.agg(*[count_if(F.col("current_status") == s).alias(s) for s in schema.STATUSES])
    return rows(one, "status", "applications", list(schema.STATUSES))


def insight_counts(apps: DataFrame, events: DataFrame) -> DataFrame:
    """Counts by status, source, sponsorship and work mode in one grouping-sets pass, and by event type."""
    kinds = {"total": None, "status": "current_status", "source": "source", "sponsorship": "sponsorship", "work_mode": "work_mode"}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), (F.lit("all") if c is None else F.coalesce(c, F.lit("unknown"))).alias("value")) for k, c in kinds.items()])
    of_apps = apps.select(F.explode(each).alias("k")).select("k.*")
    of_events = events.select(F.lit("event_type").alias("kind"), F.col("event_type").alias("value"))
    return of_apps.groupBy("kind", "value").agg(F.count("*").alias("n")).unionByName(of_events.groupBy("kind", "value").agg(F.count("*").alias("n")))


def rejected_skills(apps: DataFrame, tech: DataFrame) -> DataFrame:
    """Skills of rejected applications, once for each application, in their own case."""
    skill = tech.select(F.col("application_id").alias("id"), F.trim("skill").alias("skill")).where("skill <> ''").distinct()
    return apps.where("current_status = 'rejected'").select("id").join(skill, "id").groupBy("skill").agg(F.count("*").alias("applications"))


def calendar_windows(clock: str) -> dict[str, tuple[str, str]]:
    """The week (from Monday), month and year around the clock, half-open."""
    at = dt.datetime.fromisoformat(clock).replace(hour=0, minute=0, second=0)
    week = at - dt.timedelta(days=at.weekday())
    month = at.replace(day=1)
    after = (month + dt.timedelta(days=32)).replace(day=1)
    year = month.replace(month=1)
    span = {"week": (week, week + dt.timedelta(days=7)), "month": (month, after), "year": (year, year.replace(year=year.year + 1))}
    return {k: (str(a), str(b)) for k, (a, b) in span.items()}


def summary(f: DataFrame, clock: str) -> DataFrame:
    """The dashboard's numbers as (metric, value) rows, from one aggregate."""
    at, ts = F.col("first_seen_at"), lambda s: F.lit(s).cast("timestamp_ntz")
    cutoff = str(dt.datetime.fromisoformat(clock) - dt.timedelta(days=schema.GHOST_DAYS))
    active = str(dt.datetime.fromisoformat(clock) - dt.timedelta(days=schema.ACTIVE_DAYS))
    named = {f"in_{k}": count_if((at >= ts(a)) & (at < ts(b))) for k, (a, b) in calendar_windows(clock).items()} | {
        "total": F.count("*"),
        "companies": F.count_distinct(F.nullif(F.lower(F.trim("company")), F.lit(""))),
        "responses": count_if(F.col("has_response")),
        "silent": count_if(~F.col("has_response")),
        "rejected": count_if(F.col("has_rejection")),
        "ghosted": count_if(_ghost(cutoff)),
        "interviews": F.sum("interviews"),
        "offers": count_if(F.col("has_offer")),
        "live": count_if(F.col("current_status").isin(*schema.LIVE_STATUSES) & (F.col("last_activity_at") >= ts(active))),
        "offers_after_interview": count_if(F.col("offer_after_interview")),
    }
    return rows(f.agg(*[c.alias(k) for k, c in named.items()]), "metric", "value", list(named))
