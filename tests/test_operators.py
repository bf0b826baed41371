"""Rules that SQL can't easily restate: linkage with attempts, snapshots, fixtures, streams, request validation."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trailmark.operators import corrections, linkage, metrics, retrieval, snapshots
from trailmark.operators.filters import MetricsFilter
from trailmark.plans.templates import TEMPLATES, Asker, DateWindow, Request
from trailmark.sources import tables
from trailmark.sources.testdata import JobSearch
from trailmark.streaming import ingest

X = "email_id string, thread_id string, sent_at timestamp_ntz, classified_at timestamp_ntz, category string, seq long, company string, role_title string, event_type string, status string, event_at timestamp_ntz, salary_min long, salary_max long, currency string, work_mode string, sponsorship string, source string, tech_stack array<string>"
DAY = dt.datetime(2024, 1, 1)


def mail(i, day, event, thread="t", company="Acme Inc.", role="Engineer", **more):
    at = DAY + dt.timedelta(days=day)
    base = {"email_id": f"m{i}", "thread_id": thread, "sent_at": at, "classified_at": at, "category": "other" if event in ("response", "feedback") else "application_confirmation", "seq": i, "company": company, "role_title": role}
    rest = {"event_type": event, "status": None, "event_at": at, "salary_min": None, "salary_max": None, "currency": None, "work_mode": None, "sponsorship": "unknown", "source": "other", "tech_stack": []}
    return {**base, **rest, **more}


def extractions(spark, rows):
    names = [c.split(" ")[0] for c in X.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], X)


def test_attempts_split_on_state_and_idleness(spark):
    story = [(1, 0, "applied"), (2, 5, "interview_scheduled"), (3, 9, "rejection"), (4, 12, "feedback"), (5, 20, "applied"), (6, 25, "response"), (7, 30, "offer"), (8, 31, "assessment"), (9, 500, "assessment")]
    x = extractions(spark, [mail(i, d, e) for i, d, e in story])
    got = {r["email_id"]: r["attempt_started_at"] for r in linkage.attempts(linkage.keyed(linkage.resolved(x))).collect()}
    second, third, fourth = (DAY + dt.timedelta(days=d) for d in (20, 31, 500))
    assert got == {"m1": None, "m2": None, "m3": None, "m4": None, "m5": second, "m6": second, "m7": second, "m8": third, "m9": fourth}


def test_known_attempts_keep_their_mails(spark):
    x = linkage.keyed(linkage.resolved(extractions(spark, [mail(1, 40, "applied"), mail(2, 41, "rejection"), mail(3, 10, "response")])))
    old = x.limit(1).select(*linkage.GROUP).withColumns({
        "attempt_started_at": F.lit(None).cast("timestamp_ntz"), "status": F.lit("rejected"), "first_at": F.lit(DAY + dt.timedelta(days=5)).cast("timestamp_ntz"),
        "last_at": F.lit(DAY + dt.timedelta(days=20)).cast("timestamp_ntz"), "email_ids": F.array(F.lit("m2")),
    })
    got = {r["email_id"]: r["attempt_started_at"] for r in linkage.attempts(x, old).collect()}
    assert got == {"m1": DAY + dt.timedelta(days=40), "m2": None, "m3": None}


def test_identity_comes_from_the_thread(spark):
    rows = [mail(1, 3, "assessment", company=None), mail(2, 1, "applied"), mail(3, 5, "offer", role=None), mail(4, 2, "applied", company=None, thread="u"), mail(5, 9, "applied", company="Beta", role=None)]
    x = linkage.resolved(extractions(spark, rows))
    known = spark.createDataFrame([("u", "Gamma", "Engineer", DAY)], "thread_id string, company string, role_title string, at timestamp_ntz")
    got = {r["email_id"]: (r["company"], r["role_title"]) for r in linkage.inherit_identity(x, known).collect()}
    assert got == {"m1": ("Acme Inc.", "Engineer"), "m2": ("Acme Inc.", "Engineer"), "m3": ("Acme Inc.", "Engineer"), "m4": ("Gamma", "Engineer"), "m5": ("Beta", None)}


def test_linkage_is_deterministic_and_rolls_up(spark):
    rows = [mail(1, 0, "applied", salary_min=10, tech_stack=["sql", "spark"]), mail(2, 4, "response", salary_min=5, salary_max=50, currency="EUR", tech_stack=["spark", "go"]), mail(3, 9, "offer", sponsorship="offered"), mail(4, 2, "feedback", thread="alone")]
    one = linkage.link(extractions(spark, rows))
    two = linkage.link(extractions(spark, rows[::-1]).repartition(3))
    app = one[0].collect()
    assert [r.asDict() for r in app] == [r.asDict() for r in two[0].collect()] and len(app) == 1
    a = app[0]
    assert (a["salary_min"], a["salary_max"], a["currency"], a["sponsorship"], a["current_status"], a["tech_stack"]) == (5, 50, "EUR", "offered", "offer", ["sql", "spark", "go"])
    assert a["first_seen_at"] == DAY and a["last_activity_at"] == DAY + dt.timedelta(days=9)
    assert one[1].count() == one[1].select("event_id").distinct().count() == 3


def test_role_up_ids_match_the_canonical_json(spark):
    import uuid

    x = linkage.attempts(linkage.keyed(linkage.resolved(extractions(spark, [mail(1, 0, "applied", thread=None, company="Ünïcode GmbH")]))))
    got = x.select(linkage.application_id()).first()[0]
    bucket = dt.date.fromordinal(DAY.toordinal() // 30 * 30).isoformat()
    name = json.dumps({"company": "unicode", "role": "engineer", "thread_id": None, "time_window_start": bucket, "window_days": 30}, separators=(",", ":"), sort_keys=True)
    assert got == uuid.uuid5(uuid.UUID(linkage.APPLICATION_NAMESPACE), name).hex


def test_snapshots_take_the_last_row_of_a_batch(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 3)], "id string, v int, seq int")
    got = snapshots.replaced(old, snapshots.last_of(new, ["id"]), ["id"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 4), ("c", 5)]


def test_tombstones_and_protected_events(spark):
    c = spark.createDataFrame(
        [("merge", "{}", json.dumps({"deleted_source_application_id": "x"})), ("event_edit", json.dumps({"event": {"id": "e1", "email_id": "m1"}}), "{}"), ("status_edit", "{}", "{}")],
        "correction_type string, before_json string, after_json string",
    )
    assert [r["id"] for r in snapshots.merge_tombstones(c).collect()] == ["x"]
    assert [tuple(r) for r in snapshots.protected_events(c).collect()] == [("e1", "m1")]


def test_split_needs_an_event_that_stays(spark):
    j = "id string, application_id string, event_at timestamp_ntz"
    events = spark.createDataFrame([("1", "a", DAY), ("2", "b", DAY), ("3", "b", DAY + dt.timedelta(days=1))], j)
    apps = spark.createDataFrame([("a", DAY, DAY, False), ("b", DAY, DAY, False)], "id string, first_seen_at timestamp_ntz, last_activity_at timestamp_ntz, manual_lock boolean")
    new_apps, new_events = corrections.split(apps, events, events.where("id IN ('1', '3')").select("application_id", "id"))
    got = {r["id"]: r["application_id"] for r in new_events.collect()}
    assert got["1"] == "a" and got["2"] == "b" and got["3"].startswith("manual-split-")
    assert {r["id"]: r["manual_lock"] for r in new_apps.collect()} == {"a": False, "b": True, got["3"]: True}


def fixture_file(tmp_path, **change):
    at = "2024-01-01T10:00:00Z"
    data = {
        "schema_version": "1", "fixture_id": "f", "description": "d", "contains_private_data": False,
        "emails": [{"id": "m1", "provider": "gmail", "ingested_at": at, "sent_at": at}, {"id": "m2", "provider": "gmail", "ingested_at": at, "body_text": "x", "body_retention_state": "retained", "labels": ["INBOX"]}],
        "classifications": [{"email_id": "m1", "is_job_related": True, "category": "offer", "confidence": 0.5, "model": "m", "prompt_version": "v", "classified_at": at}],
        "applications": [{"id": "a1", "company": "c", "role_title": "r", "source": "other", "first_seen_at": at, "current_status": "applied", "sponsorship": "unknown", "last_activity_at": at, "created_at": at, "updated_at": at}],
        "events": [{"id": "e1", "application_id": "a1", "email_id": "m1", "event_type": "applied", "event_at": at}],
    } | change
    path = tmp_path / "fixture.json"
    path.write_text(json.dumps(data))
    return str(path)


def test_fixture(spark, tmp_path):
    t = tables.read_fixture(spark, fixture_file(tmp_path))
    assert t["emails"].where("id = 'm1'").first()["labels"] == [] and t["events"].first()["event_at"] == dt.datetime(2024, 1, 1, 10)
    bad = fixture_file(tmp_path, events=[{"id": "e1", "application_id": "no", "email_id": "gone", "event_type": "applied", "event_at": "2024-01-01T10:00:00Z"}])
    with pytest.raises(ValueError, match="event without application"):
        tables.read_fixture(spark, bad)


def test_golden_set(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text("\n".join(json.dumps({"schema_version": "1", "case_id": str(i), "email": {"subject": "s"}, "expected": {"is_job_related": i == 1}}) for i in range(3)))
    assert tables.read_golden_set(spark, str(path)).where("expected.is_job_related").count() == 1


def write_page(folder, n, rows):
    """Pages are read in the order of their times, so page n gets the n-th second."""
    folder.mkdir(exist_ok=True)
    (page := folder / f"page-{n}.json").write_text("\n".join(json.dumps({"provider": "gmail", "received_at": "2024-01-01T00:00:00", "labels": [], **r}) for r in rows))
    os.utime(page, (1_700_000_000 + n,) * 2)


def test_stream_restarts_after_the_last_page(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "pages", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    sink = ingest.into_buckets(lambda old, page: snapshots.upsert_emails(old if old is not None else ingest.metadata_rows(page).limit(0), ingest.metadata_rows(page)), out, buckets=4)

    def run():
        ingest.run_available(ingest.pages(spark, str(folder)), sink, checkpoint)
        return len(list((tmp_path / "out" / "data").glob("0*"))), sorted((r["id"], r["subject"]) for r in ingest.current(spark, out).collect())

    write_page(folder, 1, [{"id": "a", "subject": "1"}, {"id": "b", "subject": "1"}])
    write_page(folder, 2, [{"id": "b", "subject": "2"}])
    assert run() == (2, [("a", "1"), ("b", "2")])
    assert len(list((tmp_path / "out" / "data" / "00000000-000000000001").glob("bucket=*"))) == 1  # only the bucket of b
    write_page(folder, 3, [{"id": "c", "subject": "3"}])
    assert run() == (3, [("a", "1"), ("b", "2"), ("c", "3")])
    assert run()[0] == 3  # nothing new, nothing written


def test_replayed_batch_writes_the_same_rows(spark, tmp_path):
    sink = ingest.into_buckets(lambda old, new: new if old is None else snapshots.replaced(old, new, ["id"]), str(tmp_path), buckets=3)
    a, b = (spark.createDataFrame([(i, v) for i in range(n)], "id int, v string") for v, n in (("a", 9), ("b", 2)))
    sink(a, 0)
    for _ in range(2):
        sink(b, 1)
    assert sorted(map(tuple, ingest.current(spark, str(tmp_path)).collect())) == [(0, "b"), (1, "b"), *[(i, "a") for i in range(2, 9)]]


def test_old_mail_is_kept_and_repeats_count_once(spark, tmp_path):
    """A page of history years old comes after newer mail; a message added twice counts as it came first."""
    out = f"{tmp_path}/out"
    sink = ingest.into_buckets(lambda old, page: (lambda new: new if old is None else old.unionByName(new))(ingest.first_added(page, old)), out, buckets=2)
    write_page(tmp_path / "pages", 1, [{"id": "a", "subject": "1", "received_at": "2024-05-01 00:00:00"}, {"id": "a", "subject": "2", "received_at": "2024-06-01 00:00:00"}])
    write_page(tmp_path / "pages", 2, [{"id": "old", "subject": "3", "received_at": "1999-01-01 00:00:00"}, {"id": "a", "subject": "4", "received_at": "1999-01-01 00:00:00"}])
    ingest.run_available(ingest.pages(spark, str(tmp_path / "pages")), sink, f"{tmp_path}/c")
    assert sorted((r["id"], r["subject"]) for r in ingest.current(spark, out).collect()) == [("a", "1"), ("old", "3")]


def test_unsound_rows_go_aside_and_expired_offsets_reload(spark, tmp_path):
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    sink = ingest.with_dead_letters(ingest.into_buckets(lambda old, new: new, good, buckets=2), F.col("id") != "", bad)
    write_page(tmp_path / "pages", 1, [{"id": "a"}, {"id": ""}, {"subject": "none"}])
    run = lambda c, s=sink: ingest.run_available(ingest.pages(spark, str(tmp_path / "pages")), s, f"{tmp_path}/{c}")

    class OffsetExpired(Exception):
        pass

    def fails(fault):
        def sink(batch, batch_id):
            raise fault

        return sink

    ingest.resume_or_reload(lambda: run("c1", fails(OffsetExpired("the offset is gone"))), lambda: run("c2"))
    assert [r["id"] for r in ingest.current(spark, good).collect()] == ["a"] and ingest.dead_letters(spark, bad).count() == 2
    with pytest.raises(StreamingQueryException):  # a fault of the sink is no expired offset
        ingest.resume_or_reload(lambda: run("c3", fails(ValueError("disk full"))), lambda: run("c4"))


NOW = dt.datetime(2024, 3, 31, 22, 30, tzinfo=dt.UTC)


@pytest.mark.parametrize(
    ("window", "zone", "start", "end"),
    [
        (DateWindow("this_month"), "UTC", "2024-03-01 00:00", "2024-04-01 00:00"),
        (DateWindow("this_month"), "Europe/Berlin", "2024-03-31 22:00", "2024-04-30 22:00"),
        (DateWindow("last_month"), "America/New_York", "2024-02-01 05:00", "2024-03-01 05:00"),
        (DateWindow("this_week"), "UTC", "2024-03-25 00:00", "2024-04-01 00:00"),
        (DateWindow("last_year"), "UTC", "2023-01-01 00:00", "2024-01-01 00:00"),
        (DateWindow("rolling_days", days=7), "UTC", "2024-03-25 00:00", "2024-04-01 00:00"),
        (DateWindow("calendar_year", year=2020), "UTC", "2020-01-01 00:00", "2021-01-01 00:00"),
        (DateWindow("custom", start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 6)), "UTC", "2024-01-05 00:00", "2024-01-06 00:00"),
    ],
)
def test_date_windows(window, zone, start, end):
    assert [f"{t:%Y-%m-%d %H:%M}" for t in window.utc(NOW, zone)] == [start, end]


@pytest.mark.parametrize(
    "wrong",
    [
        lambda: DateWindow("rolling_days"),
        lambda: DateWindow("this_week", days=3),
        lambda: DateWindow("custom", start=dt.date(2024, 1, 2), end=dt.date(2024, 1, 1)),
        lambda: DateWindow("someday"),
        lambda: Request("breakdown"),
        lambda: Request("rates", dimension="source"),
        lambda: Request("rates", window=DateWindow("this_week")),
        lambda: Request("drop tables"),
        lambda: Request("total_applications", zone="Mars/Olympus"),
        lambda: Request("application_list", limit=101),
        lambda: MetricsFilter(status="unknown"),
        lambda: MetricsFilter(salary_min=2, salary_max=1),
    ],
)
def test_wrong_requests(wrong):
    with pytest.raises((ValueError, KeyError)):
        wrong()


def test_all_templates_answer(spark, small):
    asker = Asker(JobSearch(spark, small), dt.datetime(1998, 9, 1, 12, tzinfo=dt.UTC))
    assert len(TEMPLATES) == 21
    for name in ("company_list", "application_list", "live_applications"):
        a = asker.ask(Request(name, limit=3))
        assert a.rows.count() <= 3 <= a.total.first()["total"]


def test_calendar_windows():
    assert metrics.calendar_windows("2024-02-29 10:00:00") == {"week": ("2024-02-26 00:00:00", "2024-03-04 00:00:00"), "month": ("2024-02-01 00:00:00", "2024-03-01 00:00:00"), "year": ("2024-01-01 00:00:00", "2025-01-01 00:00:00")}


def test_padding(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "e array<float>")
    assert df.select(retrieval.padded(F.col("e"), 4)).first()[0] == [1.0, 2.0, 0.0, 0.0]
    with pytest.raises(Exception, match="too many dimensions"):
        df.select(retrieval.padded(F.col("e"), 1)).collect()

