"""A mail provider as a streaming source: its pages, then its changes, with the position in Spark's checkpoint.

An offset is where reading goes on.  ``phase`` full: at page ``token`` ('' for the first) of the list of all mail; ``cursor`` was asked for before
the first page, so nothing that arrives while pages are read is missed.  After the last page the phase is changes: mail added since
``cursor``, page by page, too; only after the last page of changes does the cursor that they lead to take its place.  A provider that
no longer knows a cursor is read from its first page again (``epoch`` counts that).  Repeats are told by their ids downstream.

Each trigger moves one page on: the driver sees a page's message ids, and tasks fetch the messages, ``per_task`` at a time.  A batch that failed
is read again between the offsets that the checkpoint names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from trailmark.streaming.ingest import PAGE


class OffsetExpired(Exception):
    """The provider no longer has the changes since a cursor."""


class Provider(Protocol):
    """What is asked of a mail provider; its objects are pickled."""

    def cursor(self) -> str:
        """Where changes stand now."""

    def page(self, token: str, size: int) -> tuple[list[str], str | None]:
        """Message ids of a page of all mail ('' for the first), and the next page's token, None after the last."""

    def changes(self, cursor: str, token: str, size: int) -> tuple[list[str], str | None, str]:
        """Ids of messages added since the cursor, the next page's token, and the cursor that the changes lead to; or OffsetExpired."""

    def messages(self, ids: Sequence[str]) -> Iterable[tuple]:
        """The messages' fields in the schema's order; messages that are gone are left out."""


class MailboxReader(DataSourceStreamReader):
    def __init__(self, provider: Provider, page_size: int, per_task: int):
        self.provider, self.page_size, self.per_task = provider, page_size, per_task
        self.first: dict | None = None  # where a new stream begins; Spark may ask for it after the first page was listed
        self.at: dict | None = None  # where the next page begins
        self.seen: dict[str, tuple[list[str], dict]] = {}  # pages that were listed and not yet written, by where they begin

    def _full(self, epoch: int) -> dict:
        return {"epoch": epoch, "phase": "full", "token": "", "cursor": self.provider.cursor(), "read": 0}

    def initialOffset(self) -> dict:
        if self.first is None:
            self.first = self._full(0)
        return self.first

    def _step(self, start: dict) -> tuple[list[str], dict]:
        """The ids of the page at an offset, and the offset after it; the same offset if there is nothing new."""
        if start["phase"] == "full":
            ids, token = self.provider.page(start["token"], self.page_size)
            after = start | {"token": token, "read": start["read"] + len(ids)} if token is not None else start | {"phase": "changes", "token": "", "read": start["read"] + len(ids)}
            return ids, after
        try:
            ids, token, cursor = self.provider.changes(start["cursor"], start["token"], self.page_size)
        except OffsetExpired:
            return [], self._full(start["epoch"] + 1)
        after = start | {"token": token or "", "read": start["read"] + len(ids)}
        if token is None:
            after |= {"cursor": cursor}
        return ids, after

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        ids, after = self._step(start)
        if _name(after) != _name(start):
            self.seen[_name(start)] = (ids, after)
        self.at = after
        return after

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.at is None:
            self.at = end  # a restart: Spark names the position of its checkpoint
        out: list[InputPartition] = []
        while _name(start) != _name(end):
            ids, after = self.seen.get(_name(start)) or self._step(start)
            out += [InputPartition(ids[i : i + self.per_task]) for i in range(0, len(ids), self.per_task)]
            if _name(after) == _name(start):
                break
            # a page that is read again may end elsewhere: another cursor is asked for, or more has changed; that is read again by the next batch
            moved = after["epoch"] > start["epoch"] or (start["phase"] == "changes" and not after["token"])
            start = end if moved else after
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(self.provider.messages(partition.value))

    def commit(self, end: dict) -> None:
        self.seen = {k: v for k, v in self.seen.items() if k == _name(end)}


def _name(offset: dict) -> str:
    return f"{offset['epoch']}:{offset['phase']}:{offset['cursor']}:{offset['token']}"


def mailbox(provider: Provider, name: str = "mailbox", schema: str = PAGE) -> type[DataSource]:
    """The data source of a provider, to be registered with ``spark.dataSource.register``."""

    class Mailbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> MailboxReader:
            return MailboxReader(provider, int(self.options.get("pagesize", 50)), int(self.options.get("pertask", 25)))

    return Mailbox


def mail(spark: SparkSession, provider: Provider, name: str = "mailbox", page_size: int = 50, per_task: int = 25) -> DataFrame:
    """A provider's mail as a stream."""
    spark.dataSource.register(mailbox(provider, name))
    return spark.readStream.format(name).option("pagesize", page_size).option("pertask", per_task).load()
