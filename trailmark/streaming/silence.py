"""Silent applications and late threads as streams with state and timers (L12, L13, late data).

An application's state is a few facts of its events, whatever their order of arrival: the latest applied event, response and other event,
and whether anything but general job mail speaks for it.  When it waits for an answer, a timer is set to the end of its silence; the
clock is the watermark of when rows were seen.  What comes late, a response above all, takes an inferred ghost back, or moves it.
So at any time the ghosts that stand are those that ``linkage.infer_ghosts`` finds among all events seen by then.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trailmark import schema

_EPOCH = dt.datetime(1970, 1, 1)
_DAY = 86_400_000_000
GHOSTS = "application_id string, action string, event_at timestamp_ntz"
PROMOTED = "provider string, thread_id string, id string"


def _micros(t: dt.datetime) -> int:
    return (t.replace(tzinfo=None) - _EPOCH) // dt.timedelta(microseconds=1)


class GhostTimers(StatefulProcessor):
    """Rows of one application in; infer, move and retract out."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "facts string")

    def _read(self) -> dict:
        return json.loads(self.facts.get()[0]) if self.facts.exists() else {"applied": None, "response": None, "other": None, "general": False, "lifecycle": False, "ghost": None, "timer": None}

    def _due(self, facts: dict) -> int | None:
        """When an application that waits for an answer counts as a ghost, None for others."""
        answered = facts["response"] is not None and facts["applied"] is not None and facts["response"] > facts["applied"]
        submitted = facts["lifecycle"] or not facts["general"]  # P01
        return facts["other"][0] + self.days * _DAY if facts["applied"] is not None and not answered and submitted else None

    def _settle(self, key: tuple, facts: dict, clock: int) -> Iterator[Row]:
        """Makes the ghost, and the timer, what the facts say at this time (microseconds)."""
        due = self._due(facts)
        ghost = due if due is not None and due <= clock else None
        if ghost != facts["ghost"]:
            action = "retract" if ghost is None else "infer" if facts["ghost"] is None else "move"
            at = facts["ghost"] if ghost is None else ghost
            yield Row(application_id=key[0], action=action, event_at=_EPOCH + dt.timedelta(microseconds=at))
            facts["ghost"] = ghost
        timer = -(-due // 1000) if due is not None and ghost is None else None  # milliseconds, rounded up
        if timer != facts["timer"]:
            if facts["timer"] is not None:
                self.handle.deleteTimer(facts["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
            facts["timer"] = timer
        self.facts.update((json.dumps(facts),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        facts = self._read()
        for r in rows:
            if r["event_type"] is None:
                continue
            place = [_micros(r["event_at"]), _micros(r["email_sent_at"]), _micros(r["classified_at"]), r["id"]]
            names = [n for n, yes in (("applied", r["event_type"] == "applied"), ("response", r["event_type"] in schema.RESPONSE_EVENTS), ("other", r["event_type"] != "ghost_inferred")) if yes]
            for name in names:
                if facts[name] is None or place > facts[name]:
                    facts[name] = place
            facts["general"], facts["lifecycle"] = facts["general"] or bool(r["general"]), facts["lifecycle"] or bool(r["lifecycle"])
        yield from self._settle(key, facts, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        facts = self._read()
        if facts["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            facts["timer"] = None
        yield from self._settle(key, facts, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000)

    def close(self) -> None:
        pass


def ghost_changes(events: DataFrame, days: int = schema.GHOST_DAYS) -> DataFrame:
    """application_id, action (infer, move, retract), event_at: what becomes of ghosts as events are seen and time goes by.

    events, a stream: application_id, id, event_type, event_at, email_sent_at, classified_at, general and lifecycle (whether its mail is
    general job mail, or tells of an application or is missing, as in ``filters.not_submitted``), seen_at (timestamp, the clock).  Rows without event_type only move the clock.  Needs the RocksDB state store."""
    timed = events.withWatermark("seen_at", "0 seconds")
    return timed.groupBy("application_id").transformWithState(GhostTimers(days), GHOSTS, "Update", "EventTime")


def standing(changes: DataFrame) -> DataFrame:
    """application_id, event_at of the ghosts that stand after all changes; changes: those columns, action, and batch and place in order."""
    last = changes.groupBy("application_id").agg(F.max(F.struct("batch", "place", "action", "event_at")).alias("c"))
    return last.where("c.action <> 'retract'").select("application_id", "c.event_at")


class ThreadPromotion(StatefulProcessor):
    """Mails of one thread in; rejected ones that count after all, as another mail of the thread is a candidate, out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "open boolean")
        self.waiting = handle.getListState("waiting", "id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found, rejected = self.open.exists(), []
        for r in rows:
            if r["outcome"] == "candidate":
                found = True
            else:
                rejected.append((r["id"],))
        if not found:
            if rejected:
                self.waiting.appendList(rejected)
            return
        if not self.open.exists():
            self.open.update((True,))
            rejected = [tuple(x) for x in (self.waiting.get() if self.waiting.exists() else ())] + rejected
            self.waiting.clear()
        for (mail,) in rejected:
            yield Row(provider=key[0], thread_id=key[1], id=mail)

    def close(self) -> None:
        pass


def promoted_mails(decisions: DataFrame) -> DataFrame:
    """provider, thread_id, id of rejected mails in threads that have a candidate, once each, whichever came first.

    decisions, a stream: provider, thread_id, id, outcome (candidate or rejected); mails without a thread stay as they were decided."""
    return decisions.where("thread_id IS NOT NULL").groupBy("provider", "thread_id").transformWithState(ThreadPromotion(), PROMOTED, "Append", "None")
