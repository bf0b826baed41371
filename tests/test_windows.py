"""Windows of many requests against those of single ones."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from trailmark.operators import windows
from trailmark.plans.templates import DateWindow

REQUEST = "request_id long, kind string, days int, year int, start_day date, end_day date, zone string, now timestamp_ntz"
ZONES = ("UTC", "Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Beirut", "Pacific/Apia", "Africa/Monrovia")


def requests(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        now = dt.datetime(r.choice([1960, 2016, 2024]), r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.randint(0, 59))
        now = r.choice([now, dt.datetime(2024, 3, 31, 0, 30), dt.datetime(2024, 11, 3, 5, 59), dt.datetime(2016, 10, 16, 2, 30)])
        kind = r.choice(windows.KINDS)
        start = dt.date(r.randint(1950, 2024), r.randint(1, 12), r.randint(1, 28))
        own = {"rolling_days": {"days": r.randint(1, 3660)}, "calendar_year": {"year": r.randint(1950, 2030)}, "custom": {"start": start, "end": start + dt.timedelta(days=r.randint(1, 20_000))}}.get(kind, {})
        out.append((i, kind, own.get("days"), own.get("year"), own.get("start"), own.get("end"), r.choice(ZONES), now))
    return out


def test_ten_thousand_windows(spark):
    asked = requests(10_000, 1)
    r = random.Random(2)
    times = [dt.datetime(1970, 1, 1) + dt.timedelta(seconds=r.randint(-20 * 365 * 86400, 55 * 365 * 86400)) for _ in range(3000)]
    want = {}
    for i, kind, days, year, start, end, zone, now in asked:
        want[i] = tuple(t.replace(tzinfo=None) for t in DateWindow(kind, days, year, start, end).utc(now.replace(tzinfo=dt.UTC), zone))
    times += [t + dt.timedelta(microseconds=d) for t, _ in list(want.values())[:60] for d in (-1, 0, 1)]
    times += [t + dt.timedelta(microseconds=d) for _, t in list(want.values())[:60] for d in (-1, 0, 1)]
    bounded = windows.bounded(spark.createDataFrame(asked, REQUEST)).cache()
    got = {x["request_id"]: (x["first_at"], x["after_at"]) for x in bounded.where("problem IS NULL").collect()}
    assert got == want
    rows = spark.createDataFrame([(t,) for t in times] + [(None,)], "at timestamp_ntz")
    times.sort()
    import bisect

    counts = {x["request_id"]: x["n"] for x in windows.counted(bounded, rows, "at").collect()}
    assert counts == {i: bisect.bisect_left(times, b) - bisect.bisect_left(times, a) for i, (a, b) in want.items()}
    assert {z for *_, z, _ in asked} == set(ZONES) and ZoneInfo("Africa/Monrovia")


def test_unsound_windows(spark):
    now = dt.datetime(2024, 1, 1)
    asked = [
        (0, "someday", None, None, None, None, "UTC", now), (1, "rolling_days", None, None, None, None, "UTC", now), (2, "this_week", 3, None, None, None, "UTC", now), (3, "rolling_days", 0, None, None, None, "UTC", now),
        (4, "custom", None, None, dt.date(2024, 1, 2), dt.date(2024, 1, 2), "UTC", now), (5, None, None, None, None, None, "UTC", now), (6, "calendar_year", None, 2024, None, dt.date(2024, 1, 2), "UTC", now), (7, "this_year", None, None, None, None, "UTC", now),
    ]
    bounded = windows.bounded(spark.createDataFrame(asked, REQUEST))
    got = {x["request_id"]: x["problem"] for x in bounded.collect()}
    assert got == {0: "unknown kind", 1: "wrong fields", 2: "wrong fields", 3: "days out of range", 4: "start not before end", 5: "unknown kind", 6: "wrong fields", 7: None}
    rows = spark.createDataFrame([(dt.datetime(2024, 5, 1),)], "at timestamp_ntz")
    assert {x["request_id"]: x["n"] for x in windows.counted(bounded, rows, "at").collect()} == {**dict.fromkeys(range(7), 0), 7: 1}


def test_requests_of_one_window_are_counted_once(spark, monkeypatch):
    met, cut = {}, windows.cut

    def seen(df, name):
        out = cut(df, name)
        met[name] = out.count()
        return out

    monkeypatch.setattr(windows, "cut", seen)
    asked = [(i, "calendar_year", None, 2024 + i % 2, None, None, "UTC", dt.datetime(2024, 1, 1)) for i in range(500)]
    rows = spark.createDataFrame([(dt.datetime(2024, 5, 1),)] * 3, "at timestamp_ntz")
    counts = {x["request_id"]: x["n"] for x in windows.counted(windows.bounded(spark.createDataFrame(asked, REQUEST)), rows, "at").collect()}
    assert counts == {i: 0 if i % 2 else 3 for i in range(500)} and met["distinct_windows"] == 2
