"""Date windows of a table of requests, in each one's time zone, and what lies in them (F23, Q03 for many requests at once).

Requests of one and the same window are counted once.  Rows are counted once by quarters of an hour, and by blocks of two, four, eight and so on of these; a window is covered by at most two
blocks of each size.  So requests and rows are each read once and meet on blocks, however long the windows and however many requests begin
on the same day.  Where a window doesn't begin or end at a quarter of an hour (zones had such offsets long ago), the rows of that quarter are
compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.sources.shared import cut

QUARTER = 900_000_000
LEVELS = 24  # blocks of up to 2**24 quarters, some 478 years; longer windows have more of the largest blocks
KINDS = ("this_week", "last_week", "this_month", "last_month", "this_year", "last_year", "rolling_days", "calendar_year", "custom")
MOST_DAYS = 3660


def _zoned(source: Column, target: Column, t: Column) -> Column:
    return F.convert_timezone(source, target, t)


def local_days(kind: Column, today: Column, days: Column, year: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The first day of a window and the day after its last."""
    monday, first, january = F.trunc(today, "week"), F.trunc(today, "month"), F.trunc(today, "year")
    of_year = F.make_date(year, F.lit(1), F.lit(1))
    table = {
        "this_week": (monday, F.date_add(monday, 7)), "last_week": (F.date_sub(monday, 7), monday),
        "this_month": (first, F.add_months(first, 1)), "last_month": (F.add_months(first, -1), first),
        "this_year": (january, F.add_months(january, 12)), "last_year": (F.add_months(january, -12), january),
        "rolling_days": (F.date_sub(today, days - 1), F.date_add(today, 1)), "calendar_year": (of_year, F.add_months(of_year, 12)), "custom": (start, end),
    }
    return tuple(F.coalesce(*[F.when(kind == k, pair[i]) for k, pair in table.items()]) for i in (0, 1))


def problem(kind: Column, days: Column, year: Column, start: Column, end: Column) -> Column:
    """Null for a sound window; else what is wrong: each kind takes exactly its own fields."""
    given = lambda c: c.isNotNull()
    rolls, named, custom = kind == "rolling_days", kind == "calendar_year", kind == "custom"
    wrong = (given(days) != rolls) | (given(year) != named) | (given(start) != custom) | (given(end) != custom)
    return (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown kind").when(wrong, "wrong fields")
        .when(rolls & ~days.between(1, MOST_DAYS), "days out of range").when(custom & (start >= end), "start not before end")
    )


def bounded(requests: DataFrame) -> DataFrame:
    """Adds problem, and for sound windows first_at and after_at, half-open UTC bounds (timestamp_ntz).

    requests: kind, days, year, start_day, end_day, zone (an IANA name) and now (timestamp_ntz, UTC)."""
    fields = [F.col(c) for c in ("days", "year", "start_day", "end_day")]
    today = F.to_date(_zoned(F.lit("UTC"), F.col("zone"), F.col("now")))
    first, after = local_days(F.col("kind"), today, *fields)
    wrong = problem(F.col("kind"), *fields)
    utc = lambda day: F.when(wrong.isNull(), _zoned(F.col("zone"), F.lit("UTC"), day.cast("timestamp_ntz")))
    return requests.withColumns({"problem": wrong, "first_at": utc(first), "after_at": utc(after)})


def _micros(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)


def _blocks(low: Column, high: Column) -> Column:
    """(level, block) of the blocks that cover the quarters low to high, both included."""
    state = F.struct(low.alias("low"), high.alias("high"), F.array().cast("array<struct<level: int, block: bigint>>").alias("found"))
    one = lambda level, block: F.array(F.struct(level.cast("int").alias("level"), block.cast("bigint").alias("block")))
    none = F.array().cast("array<struct<level: int, block: bigint>>")

    def step(s: Column, level: Column) -> Column:
        low, high = s["low"], s["high"]
        last = level == LEVELS
        left = (low <= high) & ~last & (F.pmod(low, F.lit(2)) == 1)
        right = (low + left.cast("bigint") <= high) & ~last & (F.pmod(high, F.lit(2)) == 0)
        rest = F.when(last & (low <= high), F.transform(F.sequence(low, F.greatest(low, high)), lambda b: F.struct(level.cast("int").alias("level"), b.cast("bigint").alias("block")))).otherwise(none)
        found = F.concat(s["found"], F.when(left, one(level, low)).otherwise(none), F.when(right, one(level, high)).otherwise(none), rest)
        low, high = low + left.cast("bigint"), high - right.cast("bigint")
        half = lambda x, done: F.when(low <= high, F.floor(x / 2)).otherwise(done).cast("bigint")  # noqa: E731  what is covered stays so
        return F.struct(half(low, 1).alias("low"), half(high, 0).alias("high"), found.alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), state, step)["found"]


def counted(requests: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """request_id, n: how many rows lie in each request's window; requests: request_id, first_at, after_at.  Null bounds count nothing."""
    low, high = _micros(F.col("first_at")), _micros(F.col("after_at"))
    asked = cut(requests.select("request_id", low.alias("low"), high.alias("high")), "windows")
    times = rows.where(F.col(at).isNotNull()).groupBy(_micros(F.col(at)).alias("t")).agg(F.count("*").alias("n")).withColumn("quarter", F.floor(F.col("t") / QUARTER))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    quarters = times.groupBy("quarter").agg(F.sum("n").alias("n"))
    sums = quarters.select("n", "quarter", level.alias("level")).groupBy("level", F.floor(F.col("quarter") / F.pow(F.lit(2.0), F.col("level"))).alias("block")).agg(F.sum("n").alias("n"))
    first, last = F.ceil(F.col("low") / QUARTER), F.floor(F.col("high") / QUARTER) - 1
    windows = cut(asked.where("low < high").select("low", "high").distinct(), "distinct_windows")
    covered = windows.select("low", "high", F.explode(_blocks(first, last)).alias("b")).select("low", "high", "b.level", "b.block")
    whole = covered.join(sums, ["level", "block"]).select("low", "high", "n")
    edges = F.array_distinct(F.filter(F.array(F.when(F.col("low") % QUARTER != 0, F.floor(F.col("low") / QUARTER)), F.when(F.col("high") % QUARTER != 0, F.floor(F.col("high") / QUARTER))), lambda q: q.isNotNull()))
    partly = windows.select("low", "high", F.explode(edges).alias("quarter")).join(times, "quarter").where((F.col("t") >= F.col("low")) & (F.col("t") < F.col("high"))).select("low", "high", "n")
    total = cut(whole.unionByName(partly).groupBy("low", "high").agg(F.sum("n").alias("n")), "counted_windows")
    count = F.coalesce("n", F.lit(0)).cast("long").alias("n")
    met = asked.where("low < high").join(total, ["low", "high"], "left").select("request_id", count)
    return met.unionByName(asked.where("NOT coalesce(low < high, false)").select("request_id", F.lit(0).cast("long").alias("n")))
