"""Live queries, ordered application, staging and windows over streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from braidlake.operators.merge import patch

#: Batches of which a live query remembers that they were delivered; the interval of a capture; bounds of a batch's seconds.
REMEMBERED, INTERVAL = 1024, "1 second"
SLOW, QUICK = 0.010, 0.002


class Busy(RuntimeError):
    """A queue is full: try again."""


class Limit(ValueError):
    """One operation is too large for any queue."""


class Feed:
    """A bounded buffer of events for one subscriber: when it overflows it is emptied, holds a single Reset and takes nothing more."""

    def __init__(self, most: int):
        self.most, self.events, self.closed = most, deque(), False

    def put(self, event) -> None:
        if self.closed:
            return
        if len(self.events) >= self.most:
            self.events.clear()
            self.events.append(("Reset", None, None))
            self.closed = True
        else:
            self.events.append(event)

    def get(self):
        return self.events.popleft() if self.events else None


class Queue:
    """Admission of operations by their bytes."""

    def __init__(self, budget: int):
        self.budget, self.held = budget, 0

    def take(self, size: int) -> None:
        if size > self.budget:
            raise Limit("the operation is larger than the queue")
        if self.held + size > self.budget:
            raise Busy("the queue is full")
        self.held += size

    def done(self, size: int) -> None:
        self.held -= size


class LiveQuery:
    """Runs a query for each micro-batch and hands out what changed: Initial first, then Update; Reset after an overflow or a change of the schema.

    Use ``on_batch`` with foreachBatch. A cursor is (epoch, batch). ``tables`` names what the query reads (empty: all); a batch with a column
    ``table`` that touches none of these is passed over. ``own`` is this side's origin: a batch with a column ``origin`` of its rows alone is passed over too.
    """

    def __init__(self, query: Callable[[], DataFrame], key: str, columns: list[str], deliver: Callable[[str, tuple, DataFrame], None], epoch: str = "0", limit: int | None = None, tables: tuple[str, ...] = (), own: str | None = None):
        self.query, self.key, self.columns, self.deliver, self.epoch, self.limit, self.tables, self.own = query, key, columns, deliver, epoch, limit, tables, own
        self.last: DataFrame | None = None
        self.seen: deque[int] = deque(maxlen=REMEMBERED)

    def concerns(self, changes: DataFrame | None) -> bool:
        if changes is None:
            return True
        if self.tables and "table" in changes.columns:
            changes = changes.filter(F.col("table").isin(list(self.tables)))
        if self.own is not None and "origin" in changes.columns:
            changes = changes.filter(F.col("origin") != self.own)
        return not changes.isEmpty()

    def on_batch(self, changes: DataFrame | None, batch: int) -> None:
        self.seen.append(batch)
        if self.last is not None and not self.concerns(changes):
            return
        now = self.query()
        columns = [c for c in self.columns if c in now.columns]
        now = now.select(self.key, *columns).checkpoint()
        at = (self.epoch, batch)
        if self.last is None:
            self.deliver("Initial", at, now)
        elif now.schema != self.last.schema:
            self.deliver("Reset", at, now)
        else:
            changed = patch(self.last, now, self.key, columns)
            n = changed.limit(self.limit + 1).count() if self.limit is not None else int(not changed.isEmpty())
            if self.limit is not None and n > self.limit:
                self.deliver("Reset", at, now)
            elif n:
                self.deliver("Update", at, changed.orderBy(F.encode(F.col(self.key).cast("string"), "UTF-8")))
        self.last = now

    def resume(self, cursor: tuple[str, int], oldest: int | None = None, newest: int | None = None) -> int:
        """The batch to go on from; refuses another epoch, the future and what is no longer remembered."""
        epoch, batch = cursor
        oldest = (self.seen[0] if self.seen else 0) if oldest is None else oldest
        newest = (self.seen[-1] if self.seen else -1) if newest is None else newest
        if epoch != self.epoch or batch > newest or batch < oldest:
            raise ValueError("the cursor is not valid here: start anew")
        return batch + 1


class Progress(StreamingQueryListener):
    """Calls ``told(phase, name, rows)`` as streams start, advance and end."""

    def __init__(self, told: Callable[[str, str | None, int], None]):
        self.told = told

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.told("started", event.name, 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.told("progress", event.progress.name, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.told("idle", None, 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.told("ended", None, 0)


def captured(writer, interval: str = INTERVAL):
    """A stream writer that captures at an interval."""
    return writer.trigger(processingTime=interval)


def stamped(apply: Callable[[DataFrame, tuple[int, int]], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch on with one version, made of its number: a batch that is run again has the same version."""

    def on_batch(rows: DataFrame, batch: int) -> None:
        apply(rows, (batch, 0))

    return on_batch


def next_batch(rows: int, seconds: float, least: int = 1, most: int = 1 << 20) -> int:
    """Rows of the next batch: half of a slow one's, twice those of a quick one."""
    if seconds > SLOW:
        return max(least, rows // 2)
    return min(most, rows * 2) if seconds < QUICK else rows


def staged(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream (origin, sequence, digest, ts, ...) with each place once while the watermark allows; deliveries of other digests stay, to be found as conflicts."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["origin", "sequence", "digest"])


def ordered(stream: DataFrame, payload: str = "payload") -> DataFrame:
    """(origin, sequence, payload) of a stream in each origin's order without gaps: a row waits in the state until all before it came.

    What is at or below the last sequence given out is a duplicate and goes; another payload for a place that waits raises. The state holds the rows behind
    the first gap of an origin. Works on streams only.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, waits, bodies = state.get if state.exists else (0, [], [])
        held = dict(zip(waits, bodies, strict=True))
        for rows in batches:
            for sequence, body in zip(rows["sequence"].tolist(), rows[payload].tolist(), strict=True):
                if sequence <= done:
                    continue
                if held.setdefault(sequence, body) != body:
                    raise ValueError(f"corrupt: two payloads for {sequence} of {key[0]}")
        out = []
        while done + 1 in held:
            done += 1
            out.append((key[0], done, held.pop(done)))
        state.update((done, list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["origin", "sequence", payload])

    return stream.select("origin", "sequence", payload).groupBy("origin").applyInPandasWithState(
        run, f"origin long, sequence long, {payload} string", "done long, waits array<long>, bodies array<string>", "append", GroupStateTimeout.NoTimeout
    )


def caught_up(snapshot: DataFrame, log: DataFrame, boundary: DataFrame) -> DataFrame:
    """Rows of a snapshot and of the log beyond the snapshot's boundary (origin, upto); static or streaming log."""
    ends = boundary.select(F.col("origin").alias("__o"), "upto")
    later = log.join(ends, F.col("origin") == F.col("__o"), "left").filter(F.col("sequence") > F.coalesce("upto", F.lit(0)))
    return snapshot.select(log.columns).unionByName(later.select(log.columns))


def others(stream: DataFrame, own: str) -> DataFrame:
    """A stream without what this side published itself."""
    return stream.filter(F.col("origin") != own)


def of_tables(changes: DataFrame, tables: list[str]) -> DataFrame:
    """Changes of some tables; of all if none are named."""
    return changes.filter(F.col("table").isin(tables)) if tables else changes


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type, batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
