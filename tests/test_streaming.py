"""Mail as a stream: positions, stops, expired cursors; tables of versions: replays, reloads, expiry."""

import json
import random
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trailmark.operators import snapshots
from trailmark.streaming import ingest, mailbox
from trailmark.streaming.tables import BucketedTable

FIELDS = "id string, subject string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this module


class Box:
    """A provider whose mail is a file: pages go from the newest back, and what arrives meanwhile is on no page, only among the changes."""

    def __init__(self, path):
        self.path = str(path)

    def put(self, mails, oldest=0):
        Path(self.path).write_text(json.dumps({"mails": mails, "oldest": oldest}))

    def get(self):
        return json.loads(Path(self.path).read_text())

    def cursor(self):
        return str(len(self.get()["mails"]))

    def page(self, token, size):
        mails = self.get()["mails"]
        end = int(token) if token else len(mails)
        return mails[max(0, end - size) : end], str(end - size) if end > size else None

    def changes(self, cursor, token, size):
        box = self.get()
        if int(cursor) < box["oldest"]:
            raise mailbox.OffsetExpired(cursor)
        at = int(token or cursor)
        more = at + size < len(box["mails"])
        return box["mails"][at : at + size], str(at + size) if more else None, str(len(box["mails"]))

    def messages(self, ids):
        return [(i, f"about {i}") for i in ids]


def ids_of(reader, start, end):
    return [r[0] for p in reader.partitions(start, end) for r in reader.read(p)]


@pytest.mark.parametrize("seed", range(4))
def test_forty_thousand_mails_with_a_stop_at_every_page(tmp_path, seed):
    """After every page a new reader takes over from the checkpoint; some batches fail and are read again; mail arrives all the time."""
    r, box = random.Random(seed), Box(tmp_path / "box")
    mails = [f"m{i}" for i in range(40_000)]
    box.put(mails)
    reader = mailbox.MailboxReader(box, 500, 60)
    at, got, idle = reader.initialOffset(), [], 0
    while idle < 2:
        if r.random() < 0.3 and len(mails) < 41_000:
            mails += [f"m{i}" for i in range(len(mails), len(mails) + r.randint(1, 900))]
            box.put(mails)
        reader = mailbox.MailboxReader(box, 500, 60)
        assert reader.partitions(at, at) == []
        end = reader.latestOffset()
        if end == at:
            idle += 1
            continue
        if r.random() < 0.2:  # the batch fails; the checkpoint names its end
            reader = mailbox.MailboxReader(box, 500, 60)
        if r.random() < 0.1:
            mails += [f"m{len(mails)}"]
            box.put(mails)
        got += ids_of(reader, at, end)
        reader.commit(end)
        at, idle = end, 0
    assert sorted(set(got)) == sorted(mails)
    assert len(got) - len(mails) <= 5_000  # repeats only of changes that were read again
    assert at["phase"] == "changes" and at["cursor"] == str(len(mails)) and at["epoch"] == 0


def test_pages_are_read_once_without_failures(tmp_path):
    box = Box(tmp_path / "box")
    box.put([f"m{i}" for i in range(230)])
    reader, got = mailbox.MailboxReader(box, 50, 20), []
    at = reader.initialOffset()
    while (end := reader.latestOffset()) != at:
        got += ids_of(reader, at, end)
        reader.commit(end)
        at = end
    assert sorted(got) == sorted(box.get()["mails"]) and len(reader.seen) <= 1


def test_an_expired_cursor_reads_all_again(tmp_path):
    box = Box(tmp_path / "box")
    box.put([f"m{i}" for i in range(120)])
    reader, got = mailbox.MailboxReader(box, 50, 20), []
    at = reader.initialOffset()
    steps = 0
    while (end := reader.latestOffset()) != at:
        got += ids_of(reader, at, end)
        at, steps = end, steps + 1
        if steps == 3:
            box.put([f"m{i}" for i in range(300)], oldest=200)
            got = []
    assert sorted(set(got)) == sorted(box.get()["mails"]) and at["epoch"] == 1


def upserted(old, page):
    return page if old is None else snapshots.replaced(old, page, ["id"])


def test_mail_streams_into_a_table_over_restarts(spark, tmp_path):
    box, out = Box(tmp_path / "box"), f"{tmp_path}/table"
    mails = [f"m{i}" for i in range(130)]
    box.put(mails)
    spark.dataSource.register(mailbox.mailbox(box, "box", FIELDS))
    stream = lambda: spark.readStream.format("box").option("pagesize", 50).option("pertask", 20).load()
    writes = []
    sink = ingest.into_buckets(upserted, out, buckets=4)

    class Failing:
        """Fails at the second batch, after its rows were written."""

        def of(self, checkpoint):
            self.sink = sink.of(checkpoint)
            return self

        def __call__(self, batch, batch_id):
            self.sink(batch, batch_id)
            writes.append(batch_id)
            if writes == [0, 1]:
                raise ValueError("stopped")

    with pytest.raises(Exception, match="stopped"):
        ingest.run_until_idle(stream(), Failing(), f"{tmp_path}/c")
    box.put(mails := [*mails, "late1", "late2"])
    ingest.run_until_idle(stream(), Failing(), f"{tmp_path}/c")
    assert writes[:3] == [0, 1, 1]
    table = ingest.current(spark, out)
    assert sorted(r["id"] for r in table.collect()) == sorted(mails)
    assert table.columns == ["id", "subject"]


def test_a_reload_into_a_used_table_hides_nothing(spark, tmp_path):
    """The faults that batch numbers alone had: a new checkpoint begins at 0 again."""
    out = str(tmp_path / "table")
    sink = ingest.into_buckets(upserted, out, buckets=3)
    rows = lambda *r: spark.createDataFrame(r, "id string, v long")
    table = BucketedTable(spark, out, buckets=3)
    table.write(upserted, rows(("a", 1), ("b", 1)), 0, table.epoch_of("first"), "first")
    table.write(upserted, rows(("c", 1)), 1, table.epoch_of("first"), "first")
    table.write(upserted, rows(("a", 2), ("b", 2), ("d", 2)), 0, table.epoch_of("second"), "second")
    assert sorted(map(tuple, ingest.current(spark, out).collect())) == [("a", 2), ("b", 2), ("c", 1), ("d", 2)]
    table.write(upserted, rows(("a", 3)), 2, table.epoch_of("first"), "first")  # the first goes on after all
    assert ("a", 3) in set(map(tuple, ingest.current(spark, out).collect())) and table.versions()[-1] == "00000002-000000000002"
    sink(rows(("e", 4)), 0)
    assert ingest.current(spark, out).count() == 5


def test_versions_stay_bounded_and_removed_rows_go(spark, tmp_path):
    out = str(tmp_path / "table")
    table = BucketedTable(spark, out, key="id", buckets=4, keep=3)

    def apply(old, batch):
        if old is None:
            return batch
        return snapshots.replaced(old, batch, ["id"]).where("v >= 0")

    state, r = {}, random.Random(1)
    for n in range(25):
        change = {r.randint(0, 9): r.choice([n, n, -1]) for _ in range(2)}
        table.write(apply, spark.createDataFrame(list(change.items()), "id long, v long"), n, 0, "s")
        state = {k: v for k, v in (state | change).items() if v >= 0 or (n == 0)}
        if n == 3:
            table.write(apply, spark.createDataFrame(list(change.items()), "id long, v long"), n, 0, "s")  # replayed
    assert {r["id"]: r["v"] for r in ingest.current(spark, out).where("v >= 0").collect()} == {k: v for k, v in state.items() if v >= 0}
    assert len(table.versions()) == 3 and len(table.files.names(f"{out}/data")) <= 4 + 3
    older = table.versions()[0]
    assert ingest.current(spark, out, older).count() >= 0
    empty = spark.createDataFrame([], "id long, v long")
    table.write(apply, empty, 25, 0, "s")
    assert table.versions()[-1].endswith("25")


def test_dead_letters_of_two_checkpoints_stay(spark, tmp_path):
    sink = ingest.with_dead_letters(lambda batch, batch_id: None, F.col("id") != "", f"{tmp_path}/bad")
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"id": "", "subject": "x"}))
    for c in ("c1", "c2"):
        ingest.run_available(ingest.pages(spark, str(pages), FIELDS), sink, f"{tmp_path}/{c}")
    assert ingest.dead_letters(spark, f"{tmp_path}/bad").count() == 2
