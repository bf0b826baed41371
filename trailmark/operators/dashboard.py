"""The dashboard kept up to date from changed rows (A16, A17, A36 with K21): deltas with retractions instead of recounting.

Kept are the facts of each application, sums, and how many applications each company has.  A batch of changed applications computes
their facts anew, from their own events, adds what these count for and takes away what the facts before counted for.  Numbers that depend
on the clock are kept by day; only the applications of the day that the clock cuts in two are looked at one by one.  A distinct count is the
number of companies whose own count isn't zero.  A batch that is replayed builds on the version before it, as in streaming/tables.py.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.operators.features import submitted_features
from trailmark.operators.metrics import calendar_windows, rows
from trailmark.sources.shared import cut
from trailmark.streaming.tables import BucketedTable

_FACTS = ("id", "company", "first_seen_at", "last_activity_at", "is_live", "has_response", "has_rejection", "has_interview", "has_offer", "offer_after_interview", "interviews", "waiting_since")
#: Numbers that count applications, and those that are kept by the day of a time.
_FLAGS = {"responses": "has_response", "rejected": "has_rejection", "interviewed": "has_interview", "offers": "has_offer", "offers_after_interview": "offer_after_interview"}
_DAYS = {"seen": "first_seen_at", "waiting": "waiting_since", "live": "last_activity_at"}


def facts_of(apps: DataFrame, events: DataFrame, emails: DataFrame, classes: DataFrame) -> DataFrame:
    """What counts of each submitted application."""
    f = submitted_features(apps, events, emails, classes)
    waits = F.when(F.col("latest_applied").isNotNull() & ~F.col("answered"), F.col("latest_non_ghost.event_at"))
    company = F.nullif(F.lower(F.trim("company")), F.lit(""))
    return f.withColumns({"company": company, "waiting_since": waits, "is_live": F.coalesce(F.col("current_status").isin(*schema.LIVE_STATUSES), F.lit(False))}).select(*_FACTS)


def _cells(facts: DataFrame, sign: int) -> DataFrame:
    """cell, n: what applications add to the sums, or with sign -1 take away."""
    one = [F.struct(F.lit("total").alias("cell"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("interviews").alias("cell"), F.col("interviews").cast("long").alias("n"))]
    one += [F.struct(F.lit(name).alias("cell"), F.col(flag).cast("long").alias("n")) for name, flag in _FLAGS.items()]
    for name, at in _DAYS.items():
        counts = F.col(at).isNotNull() & (F.col("is_live") if name == "live" else F.lit(True))
        one.append(F.struct(F.concat(F.lit(f"{name}:"), F.date_format(at, "yyyy-MM-dd")).alias("cell"), counts.cast("long").alias("n")))
    return facts.select(F.explode(F.array(*one)).alias("c")).where("c.cell IS NOT NULL AND c.n <> 0").select("c.cell", (F.col("c.n") * sign).alias("n"))


def _companies(facts: DataFrame, sign: int) -> DataFrame:
    return facts.where("company IS NOT NULL").select("company", F.lit(sign).cast("long").alias("n"), (F.col("has_interview").cast("long") * sign).alias("interviewed"))


def _added(key: str, values: tuple[str, ...]):
    """Adds a batch of deltas to what is there; what comes to nothing goes."""

    def apply(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if old is None else old.select(key, *values).unionByName(batch)
        summed = both.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])
        any_left = F.lit(False)
        for v in values:
            any_left = any_left | (F.col(v) != 0)
        return summed.where(any_left)

    return apply


class Dashboard:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        table = lambda name, key: BucketedTable(spark, f"{folder.rstrip('/')}/{name}", key=key, buckets=buckets)
        self.spark, self.facts, self.sums, self.companies = spark, table("facts", "id"), table("sums", "cell"), table("companies", "company")

    def update(self, changed: DataFrame, apps: DataFrame, events: DataFrame, emails: DataFrame, classes: DataFrame, batch: int) -> None:
        """changed: id of applications that were added, changed or deleted, or whose events or mails were (K21's changed_rows, say).

        The other tables are as they are now; only rows of changed applications are looked at.  Batches are numbered from 0."""
        ids = cut(changed.select("id").distinct(), "changed")
        narrow = events.select("id", "application_id", "email_id", "event_type", "event_at")
        e = narrow.join(ids.withColumnRenamed("id", "application_id"), "application_id", "left_semi")
        new = cut(facts_of(apps.join(ids, "id", "left_semi"), e, emails, classes), "facts")
        touched = {r["bucket"] for r in self.facts.place(ids).select("bucket").distinct().collect()}
        before = self.facts.rows_before(0, batch, touched)
        old = None if before is None else before.select(*_FACTS).join(ids, "id", "left_semi")
        cells, companies = _cells(new, 1), _companies(new, 1)
        if old is not None:
            cells, companies = cells.unionByName(_cells(old, -1)), companies.unionByName(_companies(old, -1))
        cells = cut(cells.groupBy("cell").agg(F.sum("n").alias("n")).where("n <> 0"), "cells")
        companies = cut(companies.groupBy("company").agg(F.sum("n").alias("n"), F.sum("interviewed").alias("interviewed")).where("n <> 0 OR interviewed <> 0"), "companies")

        def replace(kept: DataFrame | None, batch_ids: DataFrame) -> DataFrame:
            return new if kept is None else kept.select(*_FACTS).join(batch_ids, "id", "left_anti").unionByName(new)

        self.sums.write(_added("cell", ("n",)), cells, batch, 0, "dashboard")
        self.companies.write(_added("company", ("n", "interviewed")), companies, batch, 0, "dashboard")
        self.facts.write(replace, ids, batch, 0, "dashboard")

    # -- reading ------------------------------------------------------------------------------------------------------------------

    def _numbers(self, clock: str) -> DataFrame:
        """One row of all numbers at a time of the clock."""
        at = dt.datetime.fromisoformat(clock)
        ghost, active = at - dt.timedelta(days=schema.GHOST_DAYS), at - dt.timedelta(days=schema.ACTIVE_DAYS)
        sums, facts, companies = self.sums.rows(), self.facts.rows(), self.companies.rows()
        sums = sums if sums is not None else self.spark.createDataFrame([], "cell string, n long")
        name, day = F.substring_index("cell", ":", 1), F.when(F.col("cell").contains(":"), F.substring_index("cell", ":", -1))
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
        midnight = lambda t: t.strftime("%Y-%m-%d")
        kept = {n: total(F.col("cell") == n) for n in ("total", "interviews", *_FLAGS)}
        kept |= {f"in_{k}": total((name == "seen") & (day >= midnight(dt.datetime.fromisoformat(a))) & (day < midnight(dt.datetime.fromisoformat(b)))) for k, (a, b) in calendar_windows(clock).items()}
        kept |= {"ghosted_days": total((name == "waiting") & (day < midnight(ghost))), "live_days": total((name == "live") & (day > midnight(active)))}
        one = sums.agg(*[c.alias(k) for k, c in kept.items()])
        if facts is not None:
            ts = lambda t: F.lit(str(t)).cast("timestamp_ntz")
            cut_day = lambda c, t: F.col(c).between(ts(t.replace(hour=0, minute=0, second=0, microsecond=0)), ts(t.replace(hour=23, minute=59, second=59, microsecond=999999)))
            edge = facts.where(cut_day("waiting_since", ghost) | cut_day("last_activity_at", active)).agg(
                F.count_if(cut_day("waiting_since", ghost) & (F.col("waiting_since") <= ts(ghost))).alias("ghosted_edge"),
                F.count_if(F.col("is_live") & cut_day("last_activity_at", active) & (F.col("last_activity_at") >= ts(active))).alias("live_edge"),
            )
            one = one.join(edge)  # one row each
        else:
            one = one.withColumns({"ghosted_edge": F.lit(0), "live_edge": F.lit(0)})
        if companies is not None:
            one = one.join(companies.agg(F.count_if(F.col("n") > 0).alias("companies"), F.count_if(F.col("interviewed") > 0).alias("companies_interviewed")))
        else:
            one = one.withColumns({"companies": F.lit(0), "companies_interviewed": F.lit(0)})
        return one.withColumns({"ghosted": F.col("ghosted_days") + F.col("ghosted_edge"), "live": F.col("live_days") + F.col("live_edge"), "silent": F.col("total") - F.col("responses")})

    def summary(self, clock: str) -> DataFrame:
        """What ``metrics.summary`` gives."""
        names = ["in_week", "in_month", "in_year", "total", "companies", "responses", "silent", "rejected", "ghosted", "interviews", "offers", "live", "offers_after_interview"]
        return rows(self._numbers(clock), "metric", "value", names)

    def rates(self, clock: str) -> DataFrame:
        """What ``metrics.rates`` gives at this time."""
        pairs = {"response": ("responses", "total"), "rejection": ("rejected", "total"), "ghost": ("ghosted", "total"), "application_to_interview": ("interviewed", "total"), "interview_to_offer": ("offers_after_interview", "interviewed")}
        part = lambda k, n, d: F.struct(F.lit(k).alias("name"), F.col(n).cast("long").alias("numerator"), F.col(d).cast("long").alias("denominator"), F.try_divide(F.col(n), F.col(d)).alias("rate"))
        return self._numbers(clock).select(F.explode(F.array(*[part(k, n, d) for k, (n, d) in pairs.items()])).alias("r")).select("r.*")

    def funnel(self, clock: str) -> DataFrame:
        """What ``metrics.funnel`` gives."""
        one = self._numbers(clock)
        stages: dict[str, Column] = {"applied": F.col("total"), "screen": F.col("responses"), "interview": F.col("companies_interviewed"), "final": F.lit(0), "offer": F.col("offers_after_interview")}
        return rows(one.select(*[c.alias(k) for k, c in stages.items()]), "stage", "count", list(stages))
