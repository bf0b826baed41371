"""Joins and ranks of long tables are dealt into parts of a bounded number of rows, with the same results."""

from datetime import datetime

import pytest

from trailmark.operators import features, insights
from trailmark.plans import insight_queries, list_queries  # noqa: F401  (they register their queries)
from trailmark.plans.catalog import QUERIES
from trailmark.sources import shared
from trailmark.sources.testdata import JobSearch


@pytest.mark.parametrize("name", ["a30_role_citations", "a30_role_outcomes", "l21_story_window", "l22_f11_cache_identity", "w08_l11_status_fold"])
def test_parts_change_no_rows(spark, small, monkeypatch, name):
    rows = lambda: sorted(map(tuple, QUERIES[name](spark, small).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(shared, "PART_ROWS", 700)
    assert rows() == whole and whole


def test_parts_grow_with_rows(spark, small, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 300)
    j = JobSearch(spark, small)
    parts = -(-j.events.count() // 300)
    assert parts > 10
    assert insights.dated_events(j.apps, j.events, insights.SCOPES["role_fit"]).rdd.getNumPartitions() == parts
    assert insights.scoped("story", j.apps, j.events, j.emails).rdd.getNumPartitions() == parts == insights.scoped("role_fit", j.apps, j.events, j.emails).rdd.getNumPartitions()
    assert features.ordered_events(j.events, j.emails, j.classes).rdd.getNumPartitions() == parts


def test_rows_without_a_mail_are_not_one_part(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 100)
    at = datetime(2024, 1, 1)
    events = spark.createDataFrame([(f"e{i}", f"a{i}", None, "applied", at) for i in range(1000)], "id string, application_id string, email_id string, event_type string, event_at timestamp_ntz")
    emails = spark.createDataFrame([("m", at)], "id string, sent_at timestamp_ntz")
    classes = spark.createDataFrame([("m", at)], "email_id string, classified_at timestamp_ntz")
    sizes = features.ordered_events(events, emails, classes).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 1000 and max(sizes) < 300


def test_citations_of_repeated_mails(spark):
    at = lambda d: datetime(2024, 1, d)
    apps = spark.createDataFrame([("a", " Dev ", at(1)), ("b", "Dev", at(2)), ("c", " ", at(3))], "id string, role_title string, first_seen_at timestamp_ntz").selectExpr(
        "*", "'x' AS company", "'applied' AS current_status", "'s' AS source", "'u' AS sponsorship", "'w' AS work_mode"
    )
    events = spark.createDataFrame([("e1", "a", "m1", "applied", at(5)), ("e2", "a", None, "applied", at(4)), ("e3", "a", "gone", "applied", None), ("e4", "c", "m1", "applied", at(1))], "id string, application_id string, email_id string, event_type string, event_at timestamp_ntz")
    emails = spark.createDataFrame([("m1",), ("m1",), ("m2",)], "id string")
    dated = insights.dated_events(apps, events, insights.SCOPES["role_fit"])
    got = sorted(tuple(r) for r in insights.cited_roles(dated, emails, most=4).collect())
    assert got == [("Dev", 1, "application:a|event:e3|email:gone"), ("Dev", 2, "application:b"), ("Dev", 3, "application:a|event:e2"), ("Dev", 4, "application:a|event:e1|email:m1")]
    assert insights.cited_roles(dated, emails, most=9).count() == 5


def test_story_by_its_events_is_the_window_of_all_evidence(spark):
    at = lambda y, d=1: datetime(y, 1, d)
    apps = spark.createDataFrame([(x, at(2024)) for x in "abc"], "id string, first_seen_at timestamp_ntz").selectExpr("*", "'x' AS company", "'r' AS role_title", "'applied' AS current_status", "'s' AS source", "'u' AS sponsorship", "'w' AS work_mode")
    events = [("e1", "a", "m1", None), ("e2", "a", None, at(2020)), ("e3", "b", "m2", None), ("e4", "b", None, None), ("e5", "b", "m1", at(2022, 5)), ("e6", "orphan", None, at(2030)), ("e7", "a", "m1", at(2019))]
    events = spark.createDataFrame([(*e[:3], "applied", e[3]) for e in events], "id string, application_id string, email_id string, event_type string, event_at timestamp_ntz")
    emails = spark.createDataFrame([("m1", at(2023)), ("m2", at(2021))], "id string, sent_at timestamp_ntz").selectExpr("*", "'s' AS subject", "'f' AS from_addr", "'retained' AS body_retention_state", "'t' AS body_text")
    whole = insights.story_window(insights.evidence(apps, events, emails, insights.SCOPES["story"]))
    got = insights.story(apps, events, emails).select(*whole.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert {r["event_id"] for r in got.collect()} == {"e1", "e5"}
