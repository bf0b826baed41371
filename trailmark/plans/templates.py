"""The fixed question templates: a validated request picks one of the registered DataFrame queries."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.operators import diagnostics, lists, metrics
from trailmark.operators.features import features
from trailmark.operators.filters import MetricsFilter, submitted

WINDOWED = ("total_applications", "summary_counts", "application_list", "company_list", "busiest_application_month")
_NEEDS = {"rolling_days": ("days",), "calendar_year": ("year",), "custom": ("start", "end")}
_PLAIN = ("this_week", "last_week", "this_month", "last_month", "this_year", "last_year")


@dataclass(frozen=True)
class DateWindow:
    """A calendar window in the asker's time zone; each kind takes exactly its own fields."""

    kind: str
    days: int | None = None
    year: int | None = None
    start: dt.date | None = None
    end: dt.date | None = None

    def __post_init__(self) -> None:
        if self.kind not in (*_PLAIN, *_NEEDS):
            raise ValueError(f"unknown date window {self.kind!r}")
        given = tuple(n for n in ("days", "year", "start", "end") if getattr(self, n) is not None)
        if given != _NEEDS.get(self.kind, ()):
            raise ValueError(f"{self.kind} takes exactly {_NEEDS.get(self.kind, ())}")
        if self.days is not None and not 1 <= self.days <= 3660:
            raise ValueError("days must be 1 to 3660")
        if self.start is not None and self.end is not None and self.start >= self.end:
            raise ValueError("start must be before end")

    def local_days(self, today: dt.date) -> tuple[dt.date, dt.date]:
        """First day and the day after the last."""
        monday, first = today - dt.timedelta(days=today.weekday()), today.replace(day=1)
        week, year = dt.timedelta(days=7), lambda y: dt.date(y, 1, 1)
        after = (first + dt.timedelta(days=31)).replace(day=1)
        match self.kind:
            case "this_week":
                return monday, monday + week
            case "last_week":
                return monday - week, monday
            case "this_month":
                return first, after
            case "last_month":
                return (first - dt.timedelta(days=1)).replace(day=1), first
            case "this_year":
                return year(today.year), year(today.year + 1)
            case "last_year":
                return year(today.year - 1), year(today.year)
            case "rolling_days":
                return today - dt.timedelta(days=self.days - 1), today + dt.timedelta(days=1)
            case "calendar_year":
                return year(self.year), year(self.year + 1)
        return self.start, self.end

    def utc(self, now: dt.datetime, zone: str) -> tuple[dt.datetime, dt.datetime]:
        """Half-open UTC bounds; now has a time zone."""
        if now.tzinfo is None:
            raise ValueError("the clock needs a time zone")
        tz = ZoneInfo(zone)
        return tuple(dt.datetime.combine(d, dt.time.min, tz).astimezone(dt.UTC) for d in self.local_days(now.astimezone(tz).date()))


@dataclass(frozen=True)
class Request:
    template: str
    filters: MetricsFilter = MetricsFilter()
    dimension: str | None = None
    window: DateWindow | None = None
    zone: str = "UTC"
    limit: int = schema.LIST_LIMIT

    def __post_init__(self) -> None:
        if self.template not in TEMPLATES:
            raise ValueError(f"unknown template {self.template!r}")
        if (self.template == "breakdown") != (self.dimension is not None):
            raise ValueError("a dimension goes with breakdown, and only with it")
        if self.dimension is not None and self.dimension not in schema.DIMENSIONS:
            raise ValueError(f"unknown dimension {self.dimension!r}")
        if self.window is not None and self.template not in WINDOWED:
            raise ValueError(f"{self.template} takes no date window")
        ZoneInfo(self.zone)
        lists.bounded(self.limit)

    def narrowed(self, now: dt.datetime) -> MetricsFilter:
        """The filter cut to the date window; the filter's upper end is inclusive, so a microsecond keeps the window half-open."""
        if self.window is None:
            return self.filters
        start, end = (t.replace(tzinfo=None) for t in self.window.utc(now, self.zone))
        end -= dt.timedelta(microseconds=1)
        f = self.filters
        return dataclasses.replace(f, first_seen_from=max(start, f.first_seen_from or start), first_seen_to=min(end, f.first_seen_to or end))


@dataclass(frozen=True)
class Answer:
    """rows, and for lists how many there are in all (one row, column total)."""

    rows: DataFrame
    total: DataFrame | None = None


class Asker:
    """Answers requests over job-search tables at a clock (with time zone)."""

    def __init__(self, tables, now: dt.datetime):
        self.tables, self.now = tables, now
        self.clock = str(now.astimezone(dt.UTC).replace(tzinfo=None))
        self.cutoff = str(now.astimezone(dt.UTC).replace(tzinfo=None) - dt.timedelta(days=schema.GHOST_DAYS))

    def apps(self, r: Request) -> DataFrame:
        return submitted(self.tables.apps, self.tables.events, self.tables.classes, r.narrowed(self.now))

    def facts(self, r: Request) -> DataFrame:
        return features(self.apps(r), self.tables.events, self.tables.emails, self.tables.classes)

    def highlight(self, r: Request, *names: str) -> DataFrame:
        found = diagnostics.highlights(diagnostics.segments(self.facts(r), self.tables.profiles, self.tables.tech), min(r.limit, schema.HIGHLIGHTS))
        out = None
        for n in names:
            one = found[n].withColumn("highlight", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out

    def timing(self, r: Request) -> DataFrame:
        f = self.facts(r)
        pairs = [("first_response", "first_response_at"), ("rejection", "first_rejection_at")]
        return metrics.average_hours(f, pairs[0][1]).withColumn("name", F.lit(pairs[0][0])).unionByName(metrics.average_hours(f, pairs[1][1]).withColumn("name", F.lit(pairs[1][0])))

    def live(self, r: Request) -> DataFrame:
        apps = r.narrowed(self.now).apply(self.tables.apps)
        return lists.live_applications(apps, lists.follow_up_states(self.tables.events, self.tables.emails, self.clock), self.clock)

    def ask(self, r: Request) -> Answer:
        return TEMPLATES[r.template](self, r)


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def _listed(df: DataFrame, order: list, r: Request) -> Answer:
    return Answer(df.orderBy(*order).limit(r.limit), _total(df))


TEMPLATES: dict[str, Callable[[Asker, Request], Answer]] = {
    "total_applications": lambda a, r: Answer(a.apps(r).agg(F.count("*").alias("applications"))),
    "summary_counts": lambda a, r: Answer(metrics.summary(a.facts(r), a.clock)),
    "rates": lambda a, r: Answer(metrics.rates(a.facts(r), a.cutoff)),
    "funnel": lambda a, r: Answer(metrics.funnel(a.facts(r))),
    "timing": lambda a, r: Answer(a.timing(r)),
    "personal_ghost_threshold": lambda a, r: Answer(metrics.silence_histogram(a.facts(r), a.clock).withColumn("threshold_days", F.lit(schema.GHOST_DAYS))),
    "application_timeseries": lambda a, r: Answer(metrics.daily(a.facts(r)).select("period_start", "applications")),
    "response_rate_timeseries": lambda a, r: Answer(metrics.daily(a.facts(r)).select("period_start", "response_rate")),
    "successful_application_segments": lambda a, r: Answer(a.highlight(r, "successful")),
    "negative_outcome_segments": lambda a, r: Answer(a.highlight(r, "negative")),
    "strongest_response_correlate": lambda a, r: Answer(a.highlight(dataclasses.replace(r, limit=1), "strongest")),
    "wasted_effort_segments": lambda a, r: Answer(a.highlight(r, "weakest")),
    "best_roi_source": lambda a, r: Answer(a.highlight(r, "best_source")),
    "sponsorship_response_impact": lambda a, r: Answer(a.highlight(r, "sponsorship_impact")),
    "skill_signal_segments": lambda a, r: Answer(a.highlight(r, "selling_skills", "dead_weight_skills")),
    "adjacent_role_suggestions": lambda a, r: Answer(a.highlight(r, "adjacent_roles")),
    "breakdown": lambda a, r: Answer(metrics.breakdown(a.facts(r), a.tables.profiles, a.tables.tech, (r.dimension,))),
    "live_applications": lambda a, r: _listed(a.live(r), [F.desc("days_waiting"), "id"], r),
    "application_list": lambda a, r: Answer(lists.application_list(a.apps(r), r.limit), _total(a.apps(r))),
    "company_list": lambda a, r: Answer(metrics.companies(a.apps(r), r.limit), metrics.distinct_companies(a.apps(r)).withColumnRenamed("companies", "total")),
    "busiest_application_month": lambda a, r: Answer(metrics.busiest_months(a.apps(r), r.zone)),
}
