"""Batches of extractions against known applications: replays, reclassified mails, locks, edits by hand."""

import datetime as dt
import json

import pytest

from trailmark.operators import linkage, relinkage
from test_operators import DAY, extractions, mail

APP = "id string, company string, role_title string, source string, first_seen_at timestamp_ntz, current_status string, salary_min long, salary_max long, currency string, work_mode string, sponsorship string, tech_stack array<string>, last_activity_at timestamp_ntz, manual_lock boolean, created_at timestamp_ntz"
EVENT = "id string, application_id string, email_id string, event_type string, event_at timestamp_ntz, extracted_status string"
MAIL = "id string, provider string, thread_id string, sent_at timestamp_ntz"
CLASS = "email_id string, classified_at timestamp_ntz"
CORRECTION = "correction_type string, before_json string, after_json string"


class World:
    """The tables, and what batches make of them."""

    def __init__(self, spark):
        self.spark, self.corrections = spark, []
        self.apps, self.events, self.mails = [], [], {}

    def run(self, rows, unrelated=()):
        for r in rows:
            self.mails[r["email_id"]] = (r["thread_id"], r["sent_at"])
        frame = self.spark.createDataFrame
        emails = frame([(i, "gmail", t, at) for i, (t, at) in self.mails.items()], MAIL)
        classes = frame([(i, at) for i, (_, at) in self.mails.items()], CLASS)
        told = frame([(r["email_id"],) for r in rows] + [(u,) for u in unrelated], "email_id string")
        got = relinkage.relink(extractions(self.spark, rows), told, frame(self.apps, APP), frame(self.events, EVENT), emails, classes, frame(self.corrections, CORRECTION))
        self.outcomes = {r["outcome"] for r in got.outcomes.collect()}
        self.conflicts = sorted((r["conflict_type"], r["application_id"], r["evidence_email_id"]) for r in got.conflicts.collect())
        self.apps, self.events = [tuple(r) for r in got.applications.collect()], [tuple(r) for r in got.events.collect()]
        return self

    def named(self):
        return sorted((a[1], a[2], a[5]) for a in self.apps)

    def kinds(self):
        return sorted((e[2], e[3]) for e in self.events)


@pytest.fixture(autouse=True)
def plainly(spark):
    """Tiny tables: compiling and adapting plans would take longer than running them."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def world(spark):
    return World(spark)


def test_replays_change_nothing_and_new_mails_extend(world):
    first = mail(1, 0, "applied", salary_min=120, salary_max=150, currency="GBP", work_mode="remote", source="linkedin", sponsorship="offered", tech_stack=["sql", "go"])
    second = mail(2, 4, "interview_scheduled", tech_stack=["go", "spark"], source="other", company=None, role=None)
    world.run([first])
    world.run([second])
    assert world.named() == [("Acme Inc.", "Engineer", "interview")] and world.kinds() == [("m1", "applied"), ("m2", "interview_scheduled")]
    a = world.apps[0]
    assert a[3] == "linkedin" and a[6:12] == (120, 150, "GBP", "remote", "offered", ["sql", "go", "spark"]) and a[12] == DAY + dt.timedelta(days=4)
    apps, events = sorted(world.apps), sorted(world.events)
    world.run([first, second])
    assert (sorted(world.apps), sorted(world.events), world.outcomes, world.conflicts) == (apps, events, {"upserted"}, [])


def test_reclassified_mails_move_and_empty_applications_go(world):
    world.run([mail(1, 0, "applied"), mail(2, 3, "response", thread="t")])
    assert len(world.apps) == 1 and len(world.events) == 2
    world.run([mail(1, 0, "applied", company="Beta", role="Platform Engineer"), mail(2, 3, "response", company="Beta", role="Platform Engineer")])
    assert world.named() == [("Beta", "Platform Engineer", "in_review")] and world.kinds() == [("m1", "applied"), ("m2", "response")]
    world.run([], unrelated=["m2"])
    assert world.named() == [("Beta", "Platform Engineer", "applied")] and world.kinds() == [("m1", "applied")]


def test_locked_applications_keep_their_events(world):
    world.run([mail(1, 0, "applied")])
    world.apps = [(*a[:13], True, a[14]) for a in world.apps]
    mine = world.apps[0][0]
    world.run([mail(1, 0, "applied", company="Beta")])
    assert world.named() == [("Acme Inc.", "Engineer", "applied")] and world.conflicts == [("application_event", mine, "m1")]
    world.run([mail(2, 5, "rejection")])
    assert world.outcomes == {"manual_conflict"} and world.conflicts == [("application_summary", mine, "m2")] and world.kinds() == [("m1", "applied")]


def test_events_edited_by_hand_stay(world):
    world.run([mail(1, 0, "applied"), mail(2, 2, "assessment")])
    edited = next(e for e in world.events if e[2] == "m2")
    world.corrections = [("event_edit", json.dumps({"event": {"id": edited[0], "email_id": "m2"}}), None)]
    world.run([mail(2, 2, "offer")])
    assert ("m2", "assessment") in world.kinds() and world.conflicts == [("application_event", edited[1], "m2")]


def test_merged_applications_do_not_come_back(world):
    world.run([mail(1, 0, "applied")])
    gone = world.apps[0][0]
    world.apps, world.events, world.corrections = [], [], [("merge", None, json.dumps({"deleted_source_application_id": gone}))]
    world.run([mail(1, 0, "applied")])
    assert world.apps == [] and world.events == [] and world.outcomes == {"merged_source"}


def test_mails_of_a_second_attempt_stay_with_it(world):
    story = [mail(1, 0, "applied"), mail(2, 9, "rejection"), mail(3, 20, "applied")]
    world.run(story)
    assert world.named() == [("Acme Inc.", "Engineer", "applied"), ("Acme Inc.", "Engineer", "rejected")]
    world.run([mail(4, 22, "interview_scheduled")])
    assert world.named() == [("Acme Inc.", "Engineer", "interview"), ("Acme Inc.", "Engineer", "rejected")]


def test_a_processing_run_takes_all_batches(spark):
    """Five mails in batches of three: one malformed, one unrelated, three of one application that then falls silent."""
    from pyspark.sql import functions as F

    from trailmark.operators import processing

    at = lambda d: DAY + dt.timedelta(days=d)
    mails = spark.createDataFrame([(f"m{i}", "gmail", "t", at(i), "retained", "text") for i in range(5)], "id string, provider string, thread_id string, sent_at timestamp_ntz, body_retention_state string, body_text string")
    classes = spark.createDataFrame([], "email_id string, is_job_related boolean, category string, confidence double, model string, prompt_version string, classified_at timestamp_ntz")
    names = [c.split(" ") for c in APP.split(", ")]
    none = lambda schema: spark.createDataFrame([], schema)
    tables = processing.Tables(mails, classes, none(", ".join(map(" ".join, names))), none(EVENT), none(CORRECTION))

    def classify(df):
        null = {k: None for k in ("company", "role_title", "application_status", "event_type", "event_at", "salary_min", "salary_max", "currency", "location", "work_mode", "seniority", "rejection_reason")}
        other = {"is_job_related": False, "category": "other", "confidence": 1.0, "sponsorship": "unknown", "tech_stack": [], **null}
        told = lambda c, s, e: json.dumps({**other, "is_job_related": True, "category": c, "company": "Acme", "role_title": "Engineer", "application_status": s, "event_type": e})
        said = {"m0": told("application_confirmation", "applied", "applied"), "m1": json.dumps(other), "m2": "{", "m3": told("assessment", "assessment", "assessment"), "m4": told("interview_invite", "interview", "interview_scheduled")}
        content = F.create_map(*[F.lit(x) for p in said.items() for x in p])
        return df.select(F.col("id").alias("email_id"), F.try_element_at(content, F.col("id")).alias("content"), F.lit("stop").alias("finish_reason"), F.lit("model-1").alias("model"), F.lit("v1").alias("prompt_version"), F.col("sent_at").alias("classified_at"))

    part = processing.run(tables, classify, "model-1", "v1", "2024-06-01 00:00:00", size=3, most=1)
    assert sorted(r["email_id"] for r in part.pending.collect()) == ["m3", "m4"] and part.reindex is None  # what is left is told
    state = spark.createDataFrame([("m0", "old", "p", "e"), ("gone", "x", "p", "e")], "email_id string, content_hash string, provider string, model string")
    one = processing.run(tables, classify, "model-1", "v1", "2024-06-01 00:00:00", index_state=state, index_provider="p", index_model="e")
    assert sorted(map(tuple, one.reindex.collect())) == [("gone", "delete"), ("m0", "embed"), ("m3", "embed"), ("m4", "embed")] and one.pending.isEmpty()
    got = processing.run(tables, classify, "model-1", "v1", "2024-06-01 00:00:00", size=3)
    done, malformed = got.tables, got.malformed
    assert sorted(map(tuple, one.tables.events.collect())) == sorted(map(tuple, done.events.collect()))  # one pass or batches
    assert [tuple(r) for r in malformed.collect()] == [("m2", "model-1", "v1", "invalid_json")]
    assert [(r["company"], r["current_status"]) for r in done.apps.collect()] == [("Acme", "interview")] and done.classes.count() == 4
    assert sorted(r["event_type"] for r in done.events.collect()) == ["applied", "assessment", "interview_scheduled"]  # it was answered, so no ghost


def test_json_strings(spark):
    texts = ["plain", "", 'quo"te', "back\\slash", "tab\tline\nfeed\r\b\f", "é ünï 日本", "🙂 x", "\x7f\x01", "a/b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(linkage.quoted(df["t"])).collect()] == [json.dumps(t) for t in texts]
