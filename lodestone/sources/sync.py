"""One cycle of synchronisation between a local table and a remote source, and listeners for what happens."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import versions
from .remote import Remote


@dataclass(frozen=True)
class SyncResult:
    merged: DataFrame
    pulled: int
    resolved: int
    pushed: int
    cursor: int


def _version(df: DataFrame, source: str) -> DataFrame:
    return df.select("key", F.struct("value", F.lit(source).alias("source_id"), "ts").alias("v"))


def sync(local: DataFrame, remote: Remote, cursor: int, resolver: versions.Resolver = versions.last_write_wins, deletes: bool = False) -> SyncResult:
    """Pulls what is newer than the cursor, resolves conflicts, pushes the local rows (only after a first pull), moves the cursor.

    Rows are (key, value, ts), with real times on both sides. Of several remote changes of a key the last counts; a change
    without a value is a deletion, honoured if `deletes`. Counts come from one aggregate, so the driver holds no rows.
    """
    changes = remote.fetch_since(cursor)
    news = changes.groupBy("key").agg(F.max_by(F.struct("value", "ts"), "ts").alias("r")).select("key", "r.value", "r.ts")
    gone = news.filter("value IS NULL") if deletes else news.filter("false")
    news = news.filter("value IS NOT NULL")
    joined = versions.sync(_version(local, "local"), _version(news, "remote"), resolver)
    counts = {r["outcome"]: r["n"] for r in joined.groupBy("outcome").agg(F.count("*").alias("n")).collect()}  # four rows at most
    merged = joined.select("key", "v.value", "v.ts").join(gone.select("key"), "key", "left_anti")
    last = changes.agg(F.max("ts")).first()[0]
    pushed = 0
    if cursor > 0:
        out = joined.filter("outcome <> 'pulled' AND v.source_id = 'local'").select("key", "v.value", "v.ts").join(gone.select("key"), "key", "left_anti")
        pushed = out.count()
        remote.push(out)
    return SyncResult(merged, counts.get("pulled", 0), counts.get("resolved", 0), pushed, cursor if last is None else max(cursor, last))


@dataclass
class EventLog(StreamingQueryListener):
    """Keeps the last events of the session's streams: (kind, query id, rows)."""

    most: int = 500
    events: list[tuple[str, str, int]] = field(default_factory=list)

    def _add(self, kind: str, id_: str, rows: int = 0) -> None:
        self.events.append((kind, id_, rows))
        del self.events[: -self.most]

    def onQueryStarted(self, event) -> None:
        self._add("started", str(event.id))

    def onQueryProgress(self, event) -> None:
        self._add("progress", str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._add("idle", str(event.id))

    def onQueryTerminated(self, event) -> None:
        self._add("terminated", str(event.id))


def new_key() -> bytes:
    """A fresh 256-bit key."""
    return secrets.token_bytes(32)
