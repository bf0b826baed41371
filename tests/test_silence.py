"""Ghosts by timers and late threads against the batch operators, in any order of arrival."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import linkage
from trailmark.operators.features import features
from trailmark.operators.filters import not_submitted
from trailmark.streaming import silence

BEGIN = dt.datetime(2024, 1, 1)
EVENT = "application_id string, id string, event_type string, event_at timestamp_ntz, email_sent_at timestamp_ntz, classified_at timestamp_ntz, general boolean, lifecycle boolean, seen_at timestamp"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def pages(folder, batches):
    folder.mkdir(parents=True, exist_ok=True)
    for n, rows in enumerate(batches):
        path = folder / f"{n}.json"
        path.write_text("\n".join(json.dumps(r, default=str) for r in rows))
        os.utime(path, (1_700_000_000 + n,) * 2)


def run(spark, stream, checkpoint):
    """All rows that the stream hands out, with batch and place."""
    out = []

    def keep(batch, batch_id):
        out.extend((batch_id, i, *r) for i, r in enumerate(batch.collect()))

    query = stream.writeStream.foreachBatch(keep).outputMode("update" if "action" in stream.columns else "append").option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_timers_find_the_ghosts_of_all_events(spark, tmp_path, seed):
    r = random.Random(seed)
    events, categories = [], []
    for a in range(40):
        at = BEGIN + dt.timedelta(days=r.randint(0, 60))
        for _ in range(r.randint(1, 6)):
            at += dt.timedelta(days=r.choice([0, 1, 5, 31, 40]))
            kind = r.choice(["applied", "applied", "applied", "response", "feedback", "note"])
            sent = r.choice([at, at + dt.timedelta(hours=1)])
            category = r.choice(["follow_up", "application_confirmation", "application_confirmation", "unknown"])
            events.append((f"a{a}", f"e{len(events)}", kind, at, sent, sent + dt.timedelta(minutes=1), category == "follow_up", category == "application_confirmation"))
            categories.append(category)
    of_event = dict(zip((e[1] for e in events), categories, strict=True))
    r.shuffle(events)
    for kind, day, place in (("applied", 0, 0), ("response", 5, len(events))):  # an answer that comes last of all
        at = BEGIN + dt.timedelta(days=day)
        events.insert(place + (kind == "response"), ("late", f"late-{kind}", kind, at, at, at, False, True))
        of_event[f"late-{kind}"] = "application_confirmation"
    clock, batches, rest = BEGIN, [], list(events)
    while rest:
        clock += dt.timedelta(days=r.choice([1, 10, 35]))
        n = r.randint(1, 25)
        take, rest = rest[:n], rest[n:]
        batches.append([dict(zip([c.split()[0] for c in EVENT.split(", ")], (*e, clock), strict=True)) for e in take])
    clock += dt.timedelta(days=20)
    batches.append([{"application_id": "clock", "seen_at": clock}])
    pages(tmp_path / "pages", batches)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "pages"))
    half = run(spark, silence.ghost_changes(stream), f"{tmp_path}/c")
    changes = spark.createDataFrame(half, "batch long, place long, application_id string, action string, event_at timestamp_ntz")
    got = {tuple(x) for x in silence.standing(changes).collect()}
    shape = "application_id string, id string, event_type string, event_at timestamp_ntz, sent timestamp_ntz, classified timestamp_ntz, category string"
    table = spark.createDataFrame([(*e[:6], of_event[e[1]]) for e in events], shape).withColumn("email_id", F.col("id"))
    apps = table.select(F.col("application_id").alias("id")).distinct().withColumn("first_seen_at", F.lit(BEGIN).cast("timestamp_ntz"))
    emails = table.select("id", F.col("sent").alias("sent_at"))
    classes = table.select(F.col("id").alias("email_id"), F.col("classified").alias("classified_at"), "category", F.lit(True).alias("is_job_related"))
    e = table.select("application_id", "id", "event_type", "event_at", "email_id")
    want = linkage.infer_ghosts(features(apps, e, emails, classes), e, not_submitted(e, classes), str(clock))
    assert got == {(x["application_id"], x["event_at"]) for x in want.collect()} and len(got) > 3
    assert {c[3] for c in half} >= {"infer", "retract"}  # late events took some back


def test_late_threads_are_promoted_once(spark, tmp_path):
    r = random.Random(3)
    mails = [{"provider": "gmail", "thread_id": r.choice([None, *(f"t{i}" for i in range(15))]), "id": f"m{i}", "outcome": r.choice(["rejected"] * 5 + ["candidate"])} for i in range(150)]
    pages(tmp_path / "pages", [mails[i : i + 20] for i in range(0, 150, 20)])
    stream = spark.readStream.schema("provider string, thread_id string, id string, outcome string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "pages"))
    got = sorted(x[-1] for x in run(spark, silence.promoted_mails(stream), f"{tmp_path}/c"))
    found = {m["thread_id"] for m in mails if m["outcome"] == "candidate"} - {None}
    assert got == sorted(m["id"] for m in mails if m["outcome"] == "rejected" and m["thread_id"] in found)
