"""Missing names of a thread's mails (L05), against a plain fold; any dates, and threads of any number of mails."""

import datetime as dt
import random

import pyarrow as pa
import pytest

from trailmark.operators import linkage

X = "email_id string, thread_id string, seq long, at timestamp_ntz, company string, role_title string, tags array<string>"
KNOWN = "thread_id string, company string, role_title string, at timestamp_ntz"


def plain(mails, apps):
    """{email_id: (company, role)}: every identity is looked at for every mail."""
    key = lambda name: name if name is None else name.strip().lower()
    seen = [(at, 1, 0, c, r, key(c), key(r)) for _, c, r, at in apps if c and r]
    own = sorted(mails, key=lambda m: m[2])
    seen += [(at, 0, -seq, c, r, key(c), key(r)) for _, _, seq, at, c, r, _ in own if c is not None and r is not None]
    out = {m[0]: (m[4], m[5]) for m in own}
    for i, _, seq, at, c, r, _ in own:
        if c is not None and r is not None:
            continue
        fits = [s for s in seen if (s[5] == key(c) if c is not None else s[6] == key(r) if r is not None else True)]
        if fits:
            first = min(s[0] for s in fits)
            best = max(s for s in fits if s[0] <= max(at, first))
            out[i] = (c or best[3], r or best[4])
            seen.append((at, 0, -seq, *out[i], key(c) if c is not None else best[5], key(r) if r is not None else best[6]))
    return out


def story(r, n, begin):
    """Mails of three threads in any order, with ties in time, and known applications of one of them."""
    day = lambda: begin + dt.timedelta(days=r.randint(0, n // 4))
    mails = [(f"m{i}", f"t{i % 3}" if i % 11 else None, i, day(), r.choice([None, None, "", "Ab", "Bc", "Cd", "De"]), r.choice([None, None, "Dev", "Ops", "Lead"]), [str(i)]) for i in range(n)]
    apps = [("t0", c, role, begin + dt.timedelta(days=d)) for d, (c, role) in enumerate([("Known", "Dev"), ("Ab", "Chief"), ("", "Dev"), ("Bc", None)])]
    r.shuffle(mails)
    return mails, apps


@pytest.mark.parametrize("begin", [dt.datetime(2024, 1, 1), dt.datetime(2270, 1, 1), dt.datetime(1600, 1, 1)])
@pytest.mark.parametrize("block", [1, 3, 2048])
def test_names_are_those_of_a_plain_fold(spark, monkeypatch, begin, block):
    """Dates beyond what nanoseconds hold (1677 to 2262) failed before."""
    monkeypatch.setattr(linkage, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    mails, apps = story(random.Random(block), 400, begin)
    try:
        x = spark.createDataFrame(mails, X).repartition(5)
        got = {r["email_id"]: r for r in linkage.inherit_identity(x, spark.createDataFrame(apps, KNOWN)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for t in ("t0", "t1", "t2"):
        expected |= plain([m for m in mails if m[1] == t], [a for a in apps if a[0] == t])
    expected |= {m[0]: (m[4], m[5]) for m in mails if m[1] is None}
    assert {i: (r["company"], r["role_title"]) for i, r in got.items()} == expected
    assert {i: (r["at"], r["tags"]) for i, r in got.items()} == {m[0]: (m[3], m[6]) for m in mails}


@pytest.mark.parametrize("block", [1, 2, 50])
def test_identities_in_blocks(monkeypatch, block):
    monkeypatch.setattr(linkage, "BLOCK", block)
    r, dated, rows = random.Random(block), linkage._Dated(), []
    for who in range(600):
        row = (r.randint(0, 60) if who > 200 else who // 5, r.randint(-9, 9), who)
        rows.append(row)
        dated.add(*row)
        at = r.randint(-5, 70)
        until = [x for x in rows if x[0] <= max(at, min(rows)[0])]
        assert dated.pick(at) == max(until)[2]
    assert max(len(b[0]) for b in dated.blocks) <= 2 * block


def test_a_long_thread_is_read_batch_by_batch():
    """A batch comes out before the next one is read: no thread is held whole."""
    n, read = 50, []
    schema = pa.schema([("thread_id", pa.string()), ("at", pa.timestamp("us")), ("company", pa.string()), ("role_title", pa.string()), ("_phase", pa.int32()), ("_turn", pa.int64()), ("ck", pa.string()), ("rk", pa.string())])

    def batches():
        for i in range(n):
            read.append(i)
            rows = [("t", i * 10 + k, "A" if i < 40 else None, "R", 1 if i < 40 else 2, -k if i < 40 else i * 10 + k, "a" if i < 40 else None, "r") for k in range(10)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for i, b in enumerate(linkage._filled(batches())):
        assert len(read) == i + 1 and set(b.column("company").to_pylist()) == {"A"}
    assert len(read) == n
