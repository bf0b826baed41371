"""Attempts of a grouping key (L07), for keys with any number of mails.

Which attempt a mail belongs to depends on all mails of its key before it.  That fold is cut into slices of consecutive mails.  What a slice does
depends on little of what came before it: the status of the attempt at hand (nine values), and when that last moved, which matters only against
three dates of the slice.  So each slice becomes a table from entry state to exit state, computed by its own task; the tables of a
key are applied one after another, a row a slice; and with the state that it is entered with, each slice places its mails by itself.

Slices are cut where the key's segment changes, too: attempts that were there before divide its time, and in each segment mails move the
attempt that began last, or the next one, and no other.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trailmark import schema
from trailmark.sources.shared import cut

STATUS_OF_EVENT = {"applied": "applied", "response": "in_review", "assessment": "assessment", "interview_scheduled": "interview", "rejection": "rejected", "offer": "offer", "ghost_inferred": "ghosted"}
TERMINAL, HARD_TERMINAL = ("offer", "rejected", "ghosted", "withdrawn"), ("offer", "rejected", "withdrawn")
#: Statuses that a response moves on.
OPEN = ("applied", "in_review", "ghosted")
ACTIVE_EVENTS = ("assessment", "interview_scheduled", "offer")
GROUP = ("company_key", "role_key", "thread", "bucket")
OLD = "company_key string, role_key string, thread string, bucket date, attempt_started_at timestamp_ntz, status string, first_at timestamp_ntz, last_at timestamp_ntz, email_ids array<string>"

#: Statuses by number; the last stands for any other.
_STATUSES = ("applied", "in_review", "assessment", "interview", "offer", "rejected", "ghosted", "withdrawn", "")
_NUMBER = {s: i for i, s in enumerate(_STATUSES)}
_ENDED, _HARD, _OPEN, _GHOSTED = ({_NUMBER[s] for s in some} for some in (TERMINAL, HARD_TERMINAL, OPEN, ("ghosted",)))
_STALE = schema.STALE_ATTEMPT_DAYS * 86_400_000_000
_SAME = tuple(range(len(_STATUSES)))
_EPOCH = dt.datetime(1970, 1, 1)

# A mail is (at, kind, to, response, owner): microseconds; 1 for applied, 2 for an active event, else 0; the number of the status that it
# sets, or -1; whether it is a response; the attempt that has it already, from 1, or 0.
# A state is (new, status, last, key, onward): whether the attempt at hand is a new one, its status and last move, and, if new, when it
# began ("=": before the slice); onward is what the next attempt's status becomes, for each that it may have.


def _next(status: int, mail: tuple) -> int:
    _, _, to, response, _ = mail
    return status if to < 0 or (response and status not in _OPEN) else to


def _starts(kind: int, status: int, idle: int) -> bool:
    if kind == 1:
        return status in _ENDED or idle >= _STALE
    return kind == 2 and (status in _HARD or idle >= _STALE)


def _move(state: tuple, mail: tuple, segment: int, had: int, floor: int) -> tuple[tuple, int]:
    """The state after a mail, and its attempt: from 1 those that were there, 0 a new one.

    segment: how many of the ``had`` attempts began by then; floor: when the last of them moved last."""
    new, status, last, key, onward = state
    at, kind, _, _, owner = mail
    mine = owner == segment and owner > 0 and not new
    if owner and not mine:
        return (new, status, last, key, tuple(_next(s, mail) for s in onward)) if owner == segment + 1 else state, owner
    if segment == 0 and had:
        return (new, status, last, key, tuple(_next(s, mail) for s in onward)), 1
    if status is None:
        return (True, _next(0, mail), at, None, onward), 0
    since = last if new else max(last, floor)
    if not mine and at > since and _starts(kind, status, at - since):
        if segment < had:
            return (new, status, last, key, tuple(_next(s, mail) for s in onward)), segment + 1
        return (True, _next(0, mail), at, at, onward), 0
    return (new, _next(status, mail), max(since, at), key, onward), 0 if new else segment


def _dates(mails: list[tuple], new: bool, segment: int, had: int) -> tuple[int, int | None] | None:
    """The first mail that asks for the attempt at hand, and the first active event before any that joins it without asking."""
    if segment == 0 and had:
        return None
    asks = [m for m in mails if m[4] == 0 or (m[4] == segment and not new)]
    if not asks:
        return None
    active = None
    for at, kind, _, _, owner in asks:
        if owner or kind == 0:
            break
        if kind == 2:
            active = at
            break
    return asks[0][0], active


def _side(last: int, dates: tuple[int, int | None] | None) -> str:
    """What matters of the last move: later than the first date or not, and stale by either or not."""
    if dates is None:
        return ""
    first, active = dates
    return f"{int(last < first)}{int(first - last >= _STALE)}{int(active is not None and active - last >= _STALE)}"


def _table(mails: list[tuple], segment: int, had: int, floor: int) -> dict:
    """Exit states of a slice by entry state: f'{new}{status}{side}' to [new, status, last or null if as before, key, onward]."""
    out: dict[str, list] = {}
    dates = {new: _dates(mails, new, segment, had) for new in (False, True)}
    for new in (False, True) if segment == had else (False,):
        first, active = dates[new] or (floor, None)
        lasts = [first, first - 1, first - _STALE, first - _STALE + 1, *([active - _STALE, active - _STALE + 1] if active is not None else [])]
        entries: dict[str, tuple] = {}
        for last in lasts:
            last = min(last, first)
            if not new:
                last = max(last, floor)
            for status in range(len(_STATUSES)):
                entries.setdefault(f"{int(new)}{status}{_side(last, dates[new])}", (new, status, last, "=", _SAME))
        now = {s: s for s in entries.values()}
        for mail in mails:  # equal states go on as one
            step = {s: _move(s, mail, segment, had, floor)[0] for s in set(now.values())}
            now = {entry: step[s] for entry, s in now.items()}
        for name, entry in entries.items():
            n, status, last, key, onward = now[entry]
            out[name] = [n, status, None if last == entry[2] else last, key, onward]
    begun = (True, None, 0, None, _SAME)
    for mail in mails if not had else ():
        begun = _move(begun, mail, segment, had, floor)[0]
    others: dict[str, tuple] = {}
    for mail in mails:
        if mail[4] > segment + 1:
            others[str(mail[4])] = tuple(_next(s, mail) for s in others.get(str(mail[4]), _SAME))
    return {"dates": [dates[False], dates[True]], "moves": out, "others": others, "begun": begun[:4]}


def _micros(t: dt.datetime) -> int:
    return (t - _EPOCH) // dt.timedelta(microseconds=1)


class _Attempts:
    """Attempts of a key that were there, by when they began; of those that began together the first counts, others only own mails."""

    def __init__(self, had: list[dict] | None):
        rows = had or []
        first = [i for i, a in enumerate(rows) if i == 0 or a["first_at"] != rows[i - 1]["first_at"]]
        self.number = {}
        for i, a in enumerate(rows):
            self.number[a["first_at"], a["attempt_started_at"]] = first.index(i) + 1 if i in first else len(first) + 1 + i
        self.keys = {self.number[a["first_at"], a["attempt_started_at"]]: a["attempt_started_at"] for a in rows}
        kept = [rows[i] for i in first]
        self.starts = [a["first_at"] for a in kept]
        self.last = [max(_micros(a["last_at"]), _micros(a["first_at"])) for a in kept]
        self.status = [_NUMBER.get(a["status"], len(_STATUSES) - 1) for a in kept]

    def __len__(self) -> int:
        return len(self.starts)

    def floor(self, segment: int) -> int:
        return self.last[segment - 1] if segment else 0

    def entry(self, segment: int) -> tuple:
        """(new, status, last, key) where the segment begins; of a key without attempts, before its first mail, no status."""
        if segment:
            return False, self.status[segment - 1], self.last[segment - 1], None
        return (False, 0, 0, None) if len(self) else (True, None, 0, None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _mail(r: dict, attempts: _Attempts) -> tuple:
    owner = attempts.number.get((r["owner"]["first_at"], r["owner"]["attempt_started_at"]), 0) if r["owner"] else 0
    return _micros(r["at"]), r["kind"], r["to"], r["response"], owner


def _batched(rows: Iterator[tuple], arrow: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def _sliced(most: int):
    """Adds the slice to mails in order; a key's slices are numbered in order, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, count, before = TaskContext.get().partitionId(), -1, 0, None
        for b in batches:
            slices = []
            for here in zip(b.column("key").to_pylist(), b.column("segment").to_pylist(), strict=True):
                if here != before or count >= most:
                    n, count, before = n + 1, 0, here
                count += 1
                slices.append((part << 40) + n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slices, pa.int64())], names=[*b.schema.names, "slice"])

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mails by slice in; the slice's table out."""

    def rows() -> Iterator[tuple]:
        for slice_, mails in groupby(_rows(batches), key=lambda r: r["slice"]):
            mails = list(mails)
            attempts, segment = _Attempts(mails[0]["had"]), mails[0]["segment"]
            table = _table([_mail(r, attempts) for r in mails], segment, len(attempts), attempts.floor(segment))
            yield slice_, mails[0]["key"], segment, json.dumps(table), mails[0]["had"]

    return _batched(rows(), _TABLE)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables of each key in order in; the state that each slice is entered with out."""

    def rows() -> Iterator[tuple]:
        for _, slices in groupby(_rows(batches), key=lambda r: r["key"]):
            attempts, state, at = None, None, None
            for r in slices:
                if attempts is None:
                    attempts = _Attempts(r["had"])
                if at != r["segment"]:
                    at, state = r["segment"], attempts.entry(r["segment"])
                yield r["slice"], json.dumps(state)
                table = json.loads(r["moves"])
                new, status, last, key = state
                if status is None:  # the key's first mail begins an attempt
                    state = tuple(table["begun"])
                else:
                    since = last if new else max(last, attempts.floor(at))
                    dates = table["dates"][int(new)]
                    n, s, moved, began, onward = table["moves"][f"{int(new)}{status}{_side(since, dates and tuple(dates))}"]
                    state = (n, s, since if moved is None else moved, key if began == "=" else began)
                    if at < len(attempts):
                        attempts.status[at] = onward[attempts.status[at]]
                for number, then in table["others"].items():
                    if int(number) <= len(attempts):
                        attempts.status[int(number) - 1] = then[attempts.status[int(number) - 1]]

    return _batched(rows(), _ENTRY)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mails by slice, with the state that it is entered with, in; when each mail's attempt began out."""

    def rows() -> Iterator[tuple]:
        for _, mails in groupby(_rows(batches), key=lambda r: r["slice"]):
            state = None
            for r in mails:
                if state is None:
                    attempts, segment = _Attempts(r["had"]), r["segment"]
                    state = (*(json.loads(r["entry"]) if r["entry"] else attempts.entry(segment)), _SAME)
                state, owner = _move(state, _mail(r, attempts), segment, len(attempts), attempts.floor(segment))
                began = attempts.keys[owner] if owner else state[3]
                yield r["mail_row"], began if began is None or isinstance(began, dt.datetime) else _EPOCH + dt.timedelta(microseconds=began)

    return _batched(rows(), _PLACE)


_HAD = pa.list_(pa.struct([("first_at", pa.timestamp("us")), ("attempt_started_at", pa.timestamp("us")), ("last_at", pa.timestamp("us")), ("status", pa.string())]))
_HAD_SQL = "array<struct<first_at: timestamp_ntz, attempt_started_at: timestamp_ntz, last_at: timestamp_ntz, status: string>>"
_TABLE = pa.schema([("slice", pa.int64()), ("key", pa.string()), ("segment", pa.int32()), ("moves", pa.string()), ("had", _HAD)])
_ENTRY = pa.schema([("slice", pa.int64()), ("entry", pa.string())])
_PLACE = pa.schema([("mail_row", pa.int64()), ("attempt_started_at", pa.timestamp("us"))])


def _key() -> Column:
    """One string for the four parts of a key, nulls apart from all values."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in GROUP]))


def folded_status(order: list[Column | str], event: str, to: Column) -> tuple[Column, Column]:
    """Two aggregates whose later() tells the status after all events in order: the last event that sets one, and the last response."""
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.col(event).alias("e"), to.alias("to"))
    said = F.col(event) == "response"
    return F.max(F.when(~F.coalesce(said, F.lit(False)) & to.isNotNull(), place)), F.max(F.when(said & to.isNotNull(), place))


def later(setting: str, response: str) -> Column:
    """A response moves on only what is open, and whatever is set after it stands."""
    status = F.coalesce(F.col(f"{setting}.to"), F.lit("applied"))
    moves = F.col(response).isNotNull() & (F.col(setting).isNull() | (F.col(response) > F.col(setting))) & status.isin(*OPEN)
    return F.when(moves, F.col(f"{response}.to")).otherwise(status)


def attempts(x: DataFrame, existing: DataFrame | None = None, slice_mails: int = 4096) -> DataFrame:
    """Splits each key's mails into attempts (L07): adds attempt_started_at, null for a key's first attempt.

    x: keyed mails (each email_id once).  existing: the key's columns, attempt_started_at, status, first_at, last_at, email_ids of attempts
    that were found before (last_at counts as first_at if it is earlier); mails that one owns stay with it."""
    old = existing if existing is not None else x.sparkSession.createDataFrame([], OLD)
    mails = cut(x.withColumn("mail_row", F.monotonically_increasing_id()), "keyed")
    one = F.struct("first_at", "attempt_started_at", "last_at", "status")
    had = old.groupBy(_key().alias("key")).agg(F.array_sort(F.collect_list(one)).cast(_HAD_SQL).alias("had"))
    owners = old.select(_key().alias("key"), F.explode("email_ids").alias("email_id"), "first_at", "attempt_started_at").groupBy("key", "email_id").agg(F.min(F.struct("first_at", "attempt_started_at")).alias("owner"))
    number = F.create_map(*[F.lit(v) for s, i in _NUMBER.items() if s for v in (s, i)])
    set_by_event = F.create_map(*[F.lit(v) for e, s in STATUS_OF_EVENT.items() for v in (e, s)])
    to = F.coalesce(F.try_element_at(set_by_event, F.col("event")), F.when(F.col("status") != "", F.col("status")))
    narrow = mails.select(
        "mail_row", _key().alias("key"), "email_id", "at", "classified_at", "seq",
        F.when(F.col("event") == "applied", 1).when(F.col("event").isin(*ACTIVE_EVENTS), 2).otherwise(0).alias("kind"),
        F.when(to.isNull(), -1).otherwise(F.coalesce(F.try_element_at(number, to), F.lit(len(_STATUSES) - 1))).alias("to"),
        F.coalesce(F.col("event") == "response", F.lit(False)).alias("response"),
    )
    began = F.transform(F.coalesce("had", F.array().cast(_HAD_SQL)), lambda a: a["first_at"])
    known = narrow.join(owners, ["key", "email_id"], "left").join(had, "key", "left").withColumn("segment", F.size(F.array_distinct(F.filter(began, lambda t: t <= F.col("at")))).cast("int"))
    order = ["key", "at", "classified_at", "seq", "mail_row"]
    columns = known.select("mail_row", "key", "at", "classified_at", "seq", "kind", "to", "response", "owner", "segment")
    ordered = columns.repartitionByRange(*order).sortWithinPartitions(*order)
    sliced = cut(ordered.mapInArrow(_sliced(slice_mails), StructType([*columns.schema.fields, StructField("slice", LongType())])), "slices")
    in_order = ["slice", "at", "classified_at", "seq", "mail_row"]
    by_slice = lambda df: df.repartition("slice").sortWithinPartitions(*in_order)
    several = sliced.groupBy("key").agg(F.min("slice").alias("a"), F.max("slice").alias("b")).where("a < b").select("key")
    long = sliced.join(several, "key", "left_semi").join(had, "key", "left")
    tables = by_slice(long).mapInArrow(_tables, f"slice long, key string, segment int, moves string, had {_HAD_SQL}")
    entries = cut(tables.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(_entries, "slice long, entry string"), "entries")
    placed = by_slice(sliced.join(entries, "slice", "left").join(had, "key", "left")).mapInArrow(_placed, "mail_row long, attempt_started_at timestamp_ntz")
    return mails.join(placed, "mail_row").drop("mail_row")
