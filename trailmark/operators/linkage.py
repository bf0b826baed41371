"""From extractions of single mails to applications with event timelines.

``extractions`` has one row for each classified mail: email_id, thread_id, sent_at, classified_at, category, seq (its place in the
batch) and what was read from it.  Everything is a join, a grouped aggregate or a window, but for the two rules that depend on the
order of a thread's or a key's mails: missing names are filled while a thread's mails stream through a task, and a key's attempts are
folded in slices (attempts.py).
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.functions.text import normalized_company, normalized_role, once, ordinal_bucket, uuid5_hex
from trailmark.operators.attempts import GROUP, STATUS_OF_EVENT, attempts, folded_status, later

# Namespaces of deterministic ids.
APPLICATION_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
EVENT_NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"
EVENT_OF_STATUS = {"applied": "applied", "in_review": "response", "assessment": "assessment", "interview": "interview_scheduled", "offer": "offer", "rejected": "rejection"}
#: Fields of an application that the first mail which tells them decides.
FIRST_KNOWN = ("currency", "location", "work_mode", "seniority")
#: Identities of a thread that are moved at a time, at most twice as many.
BLOCK = 2048
#: Stands for a missing time or place in the batch.
_LAST = (1 << 63) - 1


def _mapped(c: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), c)


def evidence(x: DataFrame) -> DataFrame:
    """Lifecycle mails, and follow-ups or others that tell of a response or feedback."""
    said = F.col("category").isin("follow_up", "other") & F.col("event_type").isin("feedback", "response")
    return x.where(F.col("category").isin(*schema.LIFECYCLE_CATEGORIES) | F.coalesce(said, F.lit(False)))


def anchored(x: DataFrame, known_threads: DataFrame) -> DataFrame:
    """Responses and feedback stay only in threads with lifecycle evidence or a known application."""
    loose = F.coalesce(F.col("event_type").isin("feedback", "response"), F.lit(False))
    threads = x.where(~loose & F.col("thread_id").isNotNull()).select("thread_id").union(known_threads.select("thread_id")).distinct()
    return x.where(~loose).unionByName(x.where(loose).join(threads, "thread_id", "left_semi").select(*x.columns))


def resolved(x: DataFrame) -> DataFrame:
    """Adds what each mail counts as: its event, and when that was."""
    kind = F.coalesce("event_type", _mapped(F.col("status"), EVENT_OF_STATUS), F.lit("applied"))
    return x.withColumn("event", kind).withColumn("at", F.coalesce("event_at", "sent_at", "classified_at"))


class _Dated:
    """Identities by (at, turn), as numbers in blocks, so that a new one moves few of the others and each takes 24 bytes."""

    def __init__(self) -> None:
        self.starts: list[tuple[int, int]] = []
        self.blocks: list[tuple[array, array, array]] = []

    def add(self, at: int, turn: int, who: int) -> None:
        k = max(bisect_right(self.starts, (at, turn)) - 1, 0)
        if not self.blocks or (len(self.blocks[k][0]) >= BLOCK and k == len(self.blocks) - 1 and (at, turn) >= (self.blocks[k][0][-1], self.blocks[k][1][-1])):
            k = len(self.blocks)
            self.blocks.append((array("q"), array("q"), array("q")))
            self.starts.append((at, turn))
        block = self.blocks[k]
        i = bisect_right(block[1], turn, bisect_left(block[0], at), bisect_right(block[0], at))
        for column, value in zip(block, (at, turn, who), strict=True):
            column.insert(i, value)
        if len(block[0]) > 2 * BLOCK:
            self.blocks[k : k + 1] = [tuple(c[:BLOCK] for c in block), tuple(c[BLOCK:] for c in block)]
            self.starts.insert(k + 1, (self.blocks[k + 1][0][0], self.blocks[k + 1][1][0]))
        self.starts[k] = (self.blocks[k][0][0], self.blocks[k][1][0])

    def pick(self, at: int) -> int:
        """The last one by then, or else the last of those that are first."""
        at = max(at, self.blocks[0][0][0])
        times, _, whose = self.blocks[bisect_right(self.starts, (at, _LAST)) - 1]
        return whose[bisect_right(times, at) - 1]


class _Thread:
    """The identities that a thread's mails may take, by what is known of them."""

    def __init__(self) -> None:
        self.found: dict[tuple, _Dated] = {}
        self.numbers: dict[tuple, int] = {}
        self.whole: list[tuple] = []

    def add(self, at: int, turn: int, identity: tuple) -> None:
        who = self.numbers.setdefault(identity, len(self.whole))
        if who == len(self.whole):
            self.whole.append(identity)
        for known in (("any",), ("company", identity[2]), ("role", identity[3])):
            self.found.setdefault(known, _Dated()).add(at, turn, who)

    def fill(self, at: int, turn: int, c, r, ck, rk) -> tuple:
        dated = self.found.get(("company", ck) if c is not None else ("role", rk) if r is not None else ("any",))
        if dated is None:
            return c, r
        best = self.whole[dated.pick(at)]
        filled = c or best[0], r or best[1]
        self.add(at, turn, (*filled, ck if c is not None else best[2], rk if r is not None else best[3]))
        return filled


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by thread in, identities by time before what is to fill in the batch's order; mails with the names that they take out."""
    thread, state = None, None
    for b in batches:
        company, role = b.column("company").to_pylist(), b.column("role_title").to_pylist()
        read = [b.column(c).to_pylist() for c in ("thread_id", "_phase", "_turn", "ck", "rk")]
        for i, (at, own, phase, turn, ck, rk) in enumerate(zip(b.column("at").cast(pa.int64()).to_pylist(), *read, strict=True)):
            if state is None or own != thread:
                thread, state = own, _Thread()
            at = _LAST if at is None else at
            if phase < 2:
                state.add(at, turn, (company[i], role[i], ck, rk))
            else:
                company[i], role[i] = state.fill(at, -turn, company[i], role[i], ck, rk)
        names = {"company": company, "role_title": role}
        out = pa.RecordBatch.from_arrays([pa.array(names[f.name], f.type) if f.name in names else b.column(f.name) for f in b.schema], schema=b.schema)
        yield out.filter(pc.greater(b.column("_phase"), 0))


def inherit_identity(x: DataFrame, known: DataFrame) -> DataFrame:
    """Fills a missing company or role from the same thread (L05): the latest earlier identity that fits, else the earliest.

    x is resolved; known: thread_id, company, role_title, at of applications.  Mails are taken in the batch's order, and a filled one
    counts as an identity for those after it.  Only threads with something to fill are sorted; their rows stream through a task, which
    keeps 72 bytes for each identity of the thread at hand, and its different names.
    """
    sparse = F.col("company").isNull() | F.col("role_title").isNull()
    threads = x.where(sparse & F.col("thread_id").isNotNull()).select("thread_id").distinct()
    rest = x.join(threads, "thread_id", "left_anti").select(*x.columns)
    seq = F.coalesce("seq", F.lit(_LAST))
    mails = x.join(threads, "thread_id", "left_semi").select(*x.columns, F.when(sparse, 2).otherwise(1).alias("_phase"), F.when(sparse, seq).otherwise(-seq).alias("_turn"))
    apps = known.select("thread_id", "company", "role_title", "at").where("company <> '' AND role_title <> ''").join(threads, "thread_id", "left_semi")
    rows = mails.unionByName(apps.withColumns({"_phase": F.lit(0), "_turn": F.lit(_LAST)}), allowMissingColumns=True)
    rows = rows.withColumns({"ck": normalized_company("company"), "rk": normalized_role("role_title")})
    in_order = ["thread_id", F.col("_phase") == 2, F.asc_nulls_last(F.when(F.col("_phase") < 2, F.col("at"))), "_turn", "at", "company", "role_title"]
    filled = rows.repartition("thread_id").sortWithinPartitions(*in_order).mapInArrow(_filled, rows.schema)
    return rest.unionByName(filled.select(*x.columns))


def keyed(x: DataFrame) -> DataFrame:
    """The grouping key (L06): company and role keys, and the thread, or without one a 30-day bucket."""
    thread = F.nullif(F.trim("thread_id"), F.lit(""))
    named = x.withColumn("company_key", F.nullif(normalized_company("company"), F.lit(""))).withColumn("role_key", normalized_role("role_title")).withColumn("thread", thread)
    return named.withColumn("bucket", F.when(F.col("thread").isNull(), ordinal_bucket(F.to_date("at"))))


def _json(fields: list[tuple[str, Column]]) -> Column:
    """Canonical JSON (sorted keys, no blanks) of strings and numbers that need no escapes."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields, key=lambda f: f[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(c: Column) -> Column:
    """A JSON string, non-ASCII characters escaped; surrogate pairs for characters beyond U+FFFF."""
    units = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(....)", "\\\\u$1")

    def escaped(ch: Column) -> Column:
        out = F.when(ch.rlike(r"^[ !#-\[\]-~]$"), ch).when(ch == '"', F.lit('\\"')).when(ch == "\\", F.lit("\\\\"))
        for sign, letter in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
            out = out.when(ch == sign, F.lit("\\" + letter))
        return out.otherwise(units(ch))

    def spelled(t: Column) -> Column:
        return F.when(t.rlike(r"^[ !#-\[\]-~]*$"), t).otherwise(F.array_join(F.transform(F.split(t, ""), lambda ch: escaped(ch)), ""))

    return F.concat(F.lit('"'), once(c, spelled), F.lit('"'))


def application_id() -> Column:
    """Deterministic id of a grouping key and attempt."""
    fields = [("company", quoted(F.col("company_key"))), ("role", quoted(F.col("role_key"))), ("thread_id", quoted(F.col("thread"))), ("time_window_start", quoted(F.date_format("bucket", "yyyy-MM-dd"))), ("window_days", F.lit(str(schema.GROUPING_DAYS)))]
    start = F.col("attempt_started_at")
    iso = F.concat(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(start, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(start, "SSSSSS"))), F.lit("+00:00"))
    again = _json([*fields, ("attempt_started_at", quoted(iso))])
    return uuid5_hex(APPLICATION_NAMESPACE, F.when(start.isNull(), _json(fields)).otherwise(again))


def event_id() -> Column:
    at = F.col("at")
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(at, "SSSSSS"))), F.lit("+00:00"))
    return uuid5_hex(EVENT_NAMESPACE, _json([("application_id", quoted(F.col("application_id"))), ("email_id", quoted(F.col("email_id"))), ("event_type", quoted(F.col("event"))), ("event_at", quoted(iso))]))


def _joined(left: DataFrame, right: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """left with right's other columns, by columns that may be null."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    condition = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return left.join(renamed, condition, how).drop(*[f"_{c}" for c in by])


def roll_up(x: DataFrame, by: tuple[str, ...] = (*GROUP, "attempt_started_at")) -> DataFrame:
    """One application for each key and attempt (L08): salary bounds, first known fields in batch order, status by the fold.

    The display name comes from the first mail with a company, or failing that a role, that improves on the ones before it: the first
    mail that tells both, or else of mails that tell one, the first after the last that tells the other.  So all of it is sums by key, and no
    application's mails are gathered.
    """
    first = lambda c, skip=None: F.min_by(c, F.when(F.col(c).isNotNull() & (F.lit(True) if skip is None else F.col(c) != skip), F.col("seq"))).alias(c)
    plain = [first(c) for c in FIRST_KNOWN if c in x.columns]
    setting, response = folded_status(["at", F.coalesce("sent_at", "at").alias("sent"), "classified_at", "seq"], "event", F.coalesce(_mapped(F.col("event"), STATUS_OF_EVENT), F.col("status")))
    has_company, has_role = F.col("company").isNotNull(), F.col("role_title").isNotNull()
    named = F.struct("seq", "company", "role_title")
    g = x.groupBy(*by).agg(
        F.min("at").alias("first_seen_at"), F.max("at").alias("last_activity_at"), F.min("salary_min").alias("salary_min"), F.max("salary_max").alias("salary_max"),
        *plain, F.coalesce(first("sponsorship", "unknown"), F.lit("unknown")).alias("sponsorship"), F.coalesce(first("source", "other"), F.lit("other")).alias("source"),
        setting.alias("setting"), response.alias("replied"), F.count("*").alias("mails"),
        F.min(F.when(has_company & has_role, named)).alias("both"),
        F.max(F.when(has_company & ~has_role, F.col("seq"))).alias("last_company"), F.max(F.when(has_role & ~has_company, F.col("seq"))).alias("last_role"),
    )
    open_ = g.where("both IS NULL AND (last_company IS NOT NULL OR last_role IS NOT NULL)").select(*by, "last_company", "last_role")
    tells = x.where(has_company != has_role).select(*by, "seq", "company", "role_title")
    after = F.when(F.col("company").isNotNull(), F.coalesce(F.col("last_role"), F.lit(-(1 << 63)))).otherwise(F.coalesce(F.col("last_company"), F.lit(-(1 << 63))))
    partial = _joined(tells, open_, by).where(F.col("seq") > after).groupBy(*by).agg(F.min(named).alias("part"))
    skills = x.select(*by, "seq", F.posexplode("tech_stack").alias("place", "skill")).groupBy(*by, "skill").agg(F.min(F.struct("seq", "place")).alias("told"))
    stacks = skills.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("told", "skill"))), lambda s: s["skill"]).alias("tech_stack"))
    out = _joined(_joined(g, partial, by, "left"), stacks, by, "left")
    best = F.coalesce("both", "part")
    return out.select(
        *by, "first_seen_at", "last_activity_at", "salary_min", "salary_max", *[c for c in FIRST_KNOWN if c in x.columns], "sponsorship", "source", "mails",
        F.coalesce("tech_stack", F.array().cast("array<string>")).alias("tech_stack"), later("setting", "replied").alias("current_status"),
        F.coalesce(best["company"], F.lit("")).alias("company"), F.coalesce(best["role_title"], F.lit("")).alias("role_title"),
    )


def proposals(x: DataFrame, known: DataFrame | None = None, known_threads: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """The mails that count, each with its application's and its event's id."""
    spark = x.sparkSession
    known = known if known is not None else spark.createDataFrame([], "thread_id string, company string, role_title string, at timestamp_ntz")
    known_threads = known_threads if known_threads is not None else known.select("thread_id").distinct()
    kept = inherit_identity(resolved(anchored(evidence(x), known_threads)), known)
    return attempts(keyed(kept), existing).withColumn("application_id", application_id()).withColumn("event_id", event_id())


def link(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole linkage of a first batch: (applications, events)."""
    split = proposals(x)
    return roll_up(split.drop("event_id"), ("application_id",)), split


def ghost_candidates(apps: DataFrame, events: DataFrame, not_submitted: DataFrame, cutoff: str) -> DataFrame:
    """Applications whose latest applied event is old and that have no ghost yet (L12), without those of P01."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    facts = events.groupBy("application_id").agg(F.max(F.when(F.col("event_type") == "applied", F.col("event_at"))).alias("applied_at"), F.max(F.col("event_type") == "ghost_inferred").alias("ghost"))
    old = facts.where((F.col("applied_at") <= at) & ~F.col("ghost")).join(not_submitted, "application_id", "left_anti")
    return apps.join(old.select(F.col("application_id").alias("id"), "applied_at"), "id")


def infer_ghosts(features: DataFrame, events: DataFrame, not_submitted: DataFrame, now: str, days: int = schema.GHOST_DAYS) -> DataFrame:
    """Ghost events to add: a threshold after the latest other event, if that has passed and no response came."""
    due = F.col("latest_non_ghost.event_at") + F.make_dt_interval(days=F.lit(days))
    cutoff = str(pd.Timestamp(now) - pd.Timedelta(days=days))
    cand = ghost_candidates(features, events, not_submitted, cutoff)
    kept = cand.where(F.col("latest_applied").isNotNull() & ~F.col("answered") & (due <= F.lit(now).cast("timestamp_ntz")))
    return kept.select(F.col("id").alias("application_id"), F.lit("ghost_inferred").alias("event_type"), due.alias("event_at"))


def retract_ghosts(features: DataFrame, ghosts: DataFrame, days: int = schema.GHOST_DAYS) -> DataFrame:
    """What becomes of each ghost event (L13): retract after a late response or without an applied event, move if its date changed."""
    due = F.col("latest_non_ghost.event_at") + F.make_dt_interval(days=F.lit(days))
    joined = ghosts.join(features.select(F.col("id").alias("application_id"), "latest_applied", "latest_non_ghost", "answered"), "application_id", "left")
    action = F.when(F.col("latest_applied").isNull() | F.col("answered"), "retract").when(due != F.col("event_at"), "move").otherwise("keep")
    return joined.select("application_id", "id", "event_at", action.alias("action"), F.when(action == "move", due).otherwise(F.col("event_at")).alias("due_at"))
