"""The kept dashboard against full queries after random batches of changes."""

import datetime as dt
import random

import pytest

from trailmark.operators import metrics
from trailmark.operators.dashboard import Dashboard
from trailmark.operators.features import features
from trailmark.operators.filters import submitted

CLOCK = dt.datetime(2024, 6, 12, 15, 30)
APP = "id string, company string, role_title string, source string, first_seen_at timestamp_ntz, current_status string, sponsorship string, work_mode string, salary_min long, salary_max long, last_activity_at timestamp_ntz"


@pytest.fixture(autouse=True)
def plainly(spark):
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_deltas_equal_full_queries(spark, tmp_path):
    r = random.Random(11)
    near = lambda days: CLOCK - dt.timedelta(days=days) + r.choice([dt.timedelta(0), dt.timedelta(hours=1), -dt.timedelta(hours=1), dt.timedelta(days=r.randint(-9, 9))])
    apps, events, mails = {}, {}, {}
    frame = spark.createDataFrame

    def app():
        return (r.choice(["Acme", " acme ", "Beta", "", None, "Co"]), "Engineer", "other", near(r.choice([0, 2, 20, 150])), r.choice(["applied", "in_review", "rejected", "withdrawn", "interview", "offer"]), "unknown", None, None, None, near(r.choice([0, 60, 60, 90])))

    board = Dashboard(spark, str(tmp_path / "board"), buckets=3)
    for batch in range(14):
        changed = {str(r.randint(0, 25)) for _ in range(r.randint(1, 8))}
        for a in changed:
            if r.random() < 0.15:
                apps.pop(a, None)
                for e in [e for e, v in events.items() if v[0] == a]:
                    del events[e]
                continue
            apps[a] = app() if a not in apps or r.random() < 0.5 else apps[a]
            for _ in range(r.randint(0, 2)):
                e = f"e{r.randint(0, 60)}"
                if e not in events or events[e][0] == a:
                    mails[f"m{e}"] = (near(30), r.choice(["follow_up", "rejection", "offer"]))
                    events[e] = (a, r.choice([None, f"m{e}"]), r.choice(["applied", "applied", "response", "rejection", "interview_scheduled", "offer", "ghost_inferred", "feedback"]), near(r.choice([30, 30, 10, 60])))
            for e in [e for e, v in events.items() if v[0] == a and r.random() < 0.2]:
                del events[e]
        a = frame([(k, *v) for k, v in apps.items()], APP)
        e = frame([(k, *v) for k, v in events.items()], "id string, application_id string, email_id string, event_type string, event_at timestamp_ntz")
        m = frame([(k, v[0]) for k, v in mails.items()], "id string, sent_at timestamp_ntz")
        c = frame([(k, v[0], v[1], True) for k, v in mails.items()], "email_id string, classified_at timestamp_ntz, category string, is_job_related boolean")
        for _ in range(2 if batch == 5 else 1):  # one batch is replayed
            board.update(frame([(x,) for x in changed], "id string"), a, e, m, c, batch)
        if batch % 3 == 1 or batch > 11:
            f = features(submitted(a, e, c), e, m, c).cache()
            clock, cutoff = str(CLOCK), str(CLOCK - dt.timedelta(days=30))
            for got, want in ((board.summary(clock), metrics.summary(f, clock)), (board.rates(clock), metrics.rates(f, cutoff)), (board.funnel(clock), metrics.funnel(f))):
                nothing = lambda x: [tuple(0 if v is None and i == 1 else v for i, v in enumerate(t)) for t in map(tuple, x.collect())]
                assert sorted(nothing(got), key=repr) == sorted(nothing(want), key=repr), batch


def test_facts_of_changed_applications_read_events_once(spark, small):
    from trailmark.operators.dashboard import facts_of
    from trailmark.operators.features import features, submitted_features
    from trailmark.operators.filters import submitted
    from trailmark.sources.testdata import JobSearch

    j = JobSearch(spark, small)
    got, want = submitted_features(j.apps, j.events, j.emails, j.classes), features(submitted(j.apps, j.events, j.classes), j.events, j.emails, j.classes)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and 0 < got.count() < j.apps.count()
    plan = facts_of(j.apps, j.events, j.emails, j.classes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and plan.count("l_linenumber") and sum("Relation" in x and "l_linenumber" in x for x in plan.splitlines()) == 1
