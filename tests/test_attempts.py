"""Attempts of keys with any number of mails, and sums in place of folds, against plain folds."""

import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.operators import attempts as A
from trailmark.operators import linkage
from trailmark.plans import linkage_queries  # noqa: F401  (it registers its queries)
from trailmark.plans.catalog import QUERIES
from trailmark.sources.testdata import JobSearch

MAIL = "email_id string, company_key string, role_key string, thread string, bucket date, at timestamp_ntz, classified_at timestamp_ntz, seq long, event string, status string"
BEGIN = dt.datetime(2020, 1, 1)
STALE = dt.timedelta(days=schema.STALE_ATTEMPT_DAYS)


def next_status(status, event, said):
    to = A.STATUS_OF_EVENT.get(event) or said
    return status if not to or (event == "response" and status not in A.OPEN) else to


def starts(event, status, idle):
    if event == "applied":
        return status in A.TERMINAL or idle >= STALE
    return event in A.ACTIVE_EVENTS and (status in A.HARD_TERMINAL or idle >= STALE)


def plain(mails, had):
    """The rule as it is told: mails of one key in order, each to the attempt that owns it, that is open, or that it begins."""
    found = [dict(zip(("key", "status", "first", "last", "mails"), a, strict=True)) for a in had]
    out = {}
    for email_id, at, event, said in mails:
        owner = next((a for a in found if email_id in a["mails"]), None)
        a = owner or max((a for a in found if a["first"] <= at), key=lambda a: a["first"], default=None)
        if a is None and found:
            a = min(found, key=lambda a: a["first"])
        elif a is None or (owner is None and at > a["last"] and starts(event, a["status"], at - a["last"])):
            later = min((b for b in found if b["first"] > at), key=lambda b: b["first"], default=None)
            if a is not None and later is not None:
                a = later
            else:
                a = {"key": None if a is None else at, "status": "applied", "first": at, "last": at, "mails": set()}
                found.append(a)
        out[email_id] = a["key"]
        a["last"] = max(a["last"], at)
        a["status"] = next_status(a["status"], event, said)
    return out


def timelines(seed, keys, most, with_attempts):
    """For each key its mails in order, and the attempts that were there before."""
    r = random.Random(seed)
    events = ["applied", "response", "assessment", "interview_scheduled", "rejection", "offer", "feedback", "ghost_inferred"]
    worlds = []
    for k in range(keys):
        at, mails = BEGIN, []
        for i in range(r.randint(1, most)):
            at += r.choice([dt.timedelta(0), dt.timedelta(seconds=1), dt.timedelta(days=r.randint(1, 40)), STALE - dt.timedelta(seconds=1), STALE, dt.timedelta(days=200)])
            event = r.choice(events if r.random() < 0.5 else r.sample(events, 2))
            mails.append((f"{k}-{i}", at, event, r.choice([None, "withdrawn", "in_review", "odd"]) if event == "feedback" else None))
        had = []
        if with_attempts and r.random() < 0.8:
            ids = [m[0] for m in mails]
            r.shuffle(ids)
            firsts = r.sample([BEGIN + dt.timedelta(days=d) for d in range(-100, max(2, (at - BEGIN).days + 50))], r.randint(1, 4))
            for n, first in enumerate(sorted(firsts)):
                mine, ids = ids[: r.randint(0, 3)], ids[3:]
                had.append((None if n == 0 else first, r.choice(A._STATUSES[:-1]), first, first + dt.timedelta(days=r.choice([0, 0, 30, 400])), set(mine)))
        worlds.append((f"k{k}", mails, had))
    return worlds


def frames(spark, worlds):
    rows = [(i, k, None, k, None, at, BEGIN + dt.timedelta(seconds=n), n, event, said) for k, mails, _ in worlds for n, (i, at, event, said) in enumerate(mails)]
    random.Random(0).shuffle(rows)
    old = [(k, None, k, None, key, status, first, last, sorted(mine)) for k, _, had in worlds for key, status, first, last, mine in had]
    return spark.createDataFrame(rows, MAIL), spark.createDataFrame(old, A.OLD)


@pytest.mark.parametrize("with_attempts", [False, True])
@pytest.mark.parametrize("slice_mails", [1, 3, 7, 1000])
def test_slices_place_mails_as_the_plain_fold(spark, slice_mails, with_attempts):
    worlds = timelines(slice_mails + 100 * with_attempts, 60, 40, with_attempts)
    x, old = frames(spark, worlds)
    got = {r["email_id"]: r["attempt_started_at"] for r in A.attempts(x, old if with_attempts else None, slice_mails).collect()}
    want = {}
    for _, mails, had in worlds:
        want |= plain(mails, had)
    assert got == want


@pytest.mark.parametrize("seed", range(40))
def test_slice_tables_compose(seed):
    """Tables of slices, applied in a row, against moving mail by mail: without Spark, many timelines."""
    ((_, mails, had),) = timelines(seed, 1, 60, True)
    r = random.Random(seed)
    known = sorted(({"first_at": f, "attempt_started_at": k, "last_at": last, "status": s} for k, s, f, last, _ in had), key=lambda a: a["first_at"])
    of_mail = {m: (f, k) for k, _, f, _, mine in had for m in mine}
    rows = []
    for n, (i, at, event, said) in enumerate(mails):
        to = A.STATUS_OF_EVENT.get(event) or said
        owner = of_mail.get(i)
        rows.append({
            "mail_row": n, "key": "k", "at": at, "kind": 1 if event == "applied" else 2 if event in A.ACTIVE_EVENTS else 0, "to": -1 if not to else A._NUMBER.get(to, len(A._STATUSES) - 1), "response": event == "response",
            "owner": owner and {"first_at": owner[0], "attempt_started_at": owner[1]}, "segment": sum(a["first_at"] <= at for a in known), "had": known or None,
        })
    cut = 0
    for n, row in enumerate(rows):
        cut += n > 0 and (r.random() < 0.3 or row["segment"] != rows[n - 1]["segment"])
        row["slice"] = cut
    import pyarrow as pa

    class Batch(list):
        def to_pylist(self):
            return list(self)

    tables = [t for b in A._tables(iter([Batch(rows)])) for t in b.to_pylist()]
    entries = {e["slice"]: e["entry"] for b in A._entries(iter([Batch(tables)])) for e in b.to_pylist()}
    placed = [p for b in A._placed(iter([Batch([row | {"entry": entries[row["slice"]]} for row in rows])])) for p in b.to_pylist()]
    assert pa and {mails[p["mail_row"]][0]: p["attempt_started_at"] for p in placed} == plain(mails, had)


def test_a_key_with_a_third_of_all_mails(spark):
    """One key's mails are placed by many tasks: no slice is larger than asked for."""
    n = 60_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("email_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("company_key"), F.lit(None).cast("string").alias("role_key"),
        F.lit("t").alias("thread"), F.lit(None).cast("date").alias("bucket"), F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, id * 7)").alias("at"), F.lit(BEGIN).cast("timestamp_ntz").alias("classified_at"),
        F.col("id").alias("seq"), F.element_at(F.array(*[F.lit(e) for e in ("applied", "rejection", "response", "offer", "feedback")]), ((F.col("id") * 7919) % 5 + 1).cast("int")).alias("event"), F.lit(None).cast("string").alias("status"),
    )
    got = {r["email_id"]: r["attempt_started_at"] for r in A.attempts(rows, slice_mails=500).where("company_key = 'hot'").collect()}
    mails = [(r["email_id"], r["at"], r["event"], None) for r in rows.where("company_key = 'hot'").orderBy("at").collect()]
    assert len(mails) == n // 3 and got == plain(mails, [])


def test_linked_events_query(spark, small):
    """l05_l07_l09 and l09_linked_events: attempts by the plain fold, ids by the standard library."""
    j = JobSearch(spark, small)
    got = {r["email_id"]: r for r in QUERIES["l09_linked_events"](spark, small).collect()}
    none = spark.createDataFrame([], "thread_id string")
    known = spark.createDataFrame([], "thread_id string, company string, role_title string, at timestamp_ntz")
    keyed = linkage.keyed(linkage.inherit_identity(linkage.resolved(linkage.anchored(linkage.evidence(j.extractions), none)), known)).collect()
    groups = {}
    for r in sorted(keyed, key=lambda r: (r["at"], r["classified_at"], r["seq"])):
        groups.setdefault(tuple(r[c] for c in A.GROUP), []).append(r)
    assert len(got) == len(keyed)
    iso = lambda t: t.isoformat(timespec="microseconds" if t.microsecond else "seconds") + "+00:00"
    named = lambda space, fields: uuid.uuid5(uuid.UUID(space), json.dumps(fields, sort_keys=True, separators=(",", ":"))).hex
    apps = {}
    for (company, role, thread, bucket), mails in groups.items():
        started = plain([(r["email_id"], r["at"], r["event"], r["status"]) for r in mails], [])
        for r in mails:
            key = {"company": company, "role": role, "thread_id": thread, "time_window_start": bucket and bucket.isoformat(), "window_days": 30}
            if started[r["email_id"]] is not None:
                key["attempt_started_at"] = iso(started[r["email_id"]])
            app = named(linkage.APPLICATION_NAMESPACE, key)
            event = named(linkage.EVENT_NAMESPACE, {"application_id": app, "email_id": r["email_id"], "event_type": r["event"], "event_at": iso(r["at"])})
            g = got[r["email_id"]]
            assert (g["application_id"].replace("-", ""), g["event_id"].replace("-", ""), g["attempt_started_at"]) == (app, event, started[r["email_id"]])
            apps.setdefault(g["application_id"], []).append(r)
    linked = {r["application_id"]: r for r in QUERIES["l05_l07_l09_linked_applications"](spark, small).collect()}
    assert set(linked) == set(apps)
    for app, mails in apps.items():
        check_rolled(linked[app], mails)


def check_rolled(got, mails):
    """An application's fields by plain folds over its mails."""
    status = "applied"
    for r in sorted(mails, key=lambda r: (r["at"], r["sent_at"] or r["at"], r["classified_at"], r["seq"])):
        status = next_status(status, r["event"], r["status"])
    order = sorted(mails, key=lambda r: r["seq"])
    best, skills = order[0], []
    for r in order:
        if (r["company"] is not None and best["company"] is None) or (r["role_title"] is not None and best["role_title"] is None):
            best = r
        skills += [s for s in r["tech_stack"] or [] if s not in skills]
    assert (got["current_status"], got["company"], got["role_title"], got["tech_stack"], got["mails"]) == (status, best["company"] or "", best["role_title"] or "", skills, len(mails))
    assert (got["first_seen_at"], got["last_activity_at"]) == (min(r["at"] for r in mails), max(r["at"] for r in mails))


def test_rolled_up_fields_are_those_of_plain_folds(spark):
    r, rows = random.Random(4), []
    for k in range(200):
        for i in range(r.randint(1, 9)):
            event = r.choice(["applied", "response", "assessment", "rejection", "offer", "feedback", "ghost_inferred"])
            at = BEGIN + dt.timedelta(days=r.randint(0, 5))
            rows.append((f"a{k}" if k % 9 else None, len(rows), at, r.choice([None, at, BEGIN]), BEGIN, event, r.choice([None, "withdrawn", "in_review"]) if event == "feedback" else None, r.choice([None, None, f"C{i}"]), r.choice([None, None, f"R{i}"]), r.choice([None, [], ["x", "y"], ["z", "x"]])))
    r.shuffle(rows)
    x = spark.createDataFrame(rows, "app string, seq long, at timestamp_ntz, sent_at timestamp_ntz, classified_at timestamp_ntz, event string, status string, company string, role_title string, tech_stack array<string>")
    x = x.withColumns({c: F.lit(None).cast(t) for c, t in (("salary_min", "long"), ("salary_max", "long"), ("sponsorship", "string"), ("source", "string"))})
    got = {r["app"]: r for r in linkage.roll_up(x, ("app",)).collect()}
    groups = {}
    for row in x.collect():
        groups.setdefault(row["app"], []).append(row)
    assert set(got) == set(groups)
    for app, mails in groups.items():
        check_rolled(got[app], mails)


def test_cache_identity_is_a_hash_over_sorted_rows(spark, small):
    """l22_f11: equal for any order of rows, another for any other value; the sums by the standard library."""
    import hashlib

    from trailmark.operators import insights
    from trailmark.plans import insight_queries  # noqa: F401

    def plain(df):
        columns = sorted(df.columns)
        texts = [r[0] for r in df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).collect()]
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        parts = [str(sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes)) for i in range(8)]
        return hashlib.sha256("|".join([str(len(texts)), *parts]).encode()).hexdigest()

    rows = spark.createDataFrame([(i, None if i % 3 else "x", float(i)) for i in range(50)], "id long, b string, a double")
    one = insights.fingerprint(rows).first()[0]
    assert one == plain(rows) == insights.fingerprint(rows.orderBy(F.desc("id")).repartition(5)).first()[0]
    assert one != insights.fingerprint(rows.where("id > 0")).first()[0] and one != insights.fingerprint(rows.withColumn("a", F.col("a") + (F.col("id") == 7).cast("int"))).first()[0]
    (got,) = QUERIES["l22_f11_cache_identity"](spark, small).collect()
    j = JobSearch(spark, small)
    facts, e = insights.role_outcomes(insight_queries._evidence(j, "role_fit")), insight_queries._evidence(j, "story")
    assert got["inputs_hash"] == hashlib.sha256("|".join(["v1", "story", plain(facts), plain(e)]).encode()).hexdigest()
