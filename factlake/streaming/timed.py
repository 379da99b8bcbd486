"""Leases and claims as they happen: state with event-time timers, so that a holder who falls silent loses its hold.

Events of a key wait until the watermark has passed them and are then taken in order, so late ones within the
watermark change nothing. What may still end by itself has a timer; it fires when the watermark passes it, though
the key has no further event. Sessions that run these need the RocksDB state store, see :data:`STATE_STORE`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session must be configured with.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class Hold:
    """Who holds something since when and until when (microseconds), how often it was taken, whether it is done, and when it was last touched."""

    who: str | None = None
    since: int = 0
    until: int = 0
    attempts: int = 0
    done: bool = False
    touched: int = 0


#: Given a hold, and an event's time, who and action: rows of what ended or began, as (what, who, since, at, attempts).
Step = Callable[[Hold, int, str, str], list[tuple]]


def _lapse(hold: Hold, at: int) -> list[tuple]:
    """A hold that ends by itself not after ``at``."""
    if hold.who is None or hold.until > at:
        return []
    row = ("expired", hold.who, hold.since, hold.until, hold.attempts)
    hold.who = None
    return [row]


def lease_step(ttl: int) -> Step:
    """An acquire takes what is free, a heartbeat of the holder extends, a release of the holder ends."""

    def step(hold: Hold, at: int, who: str, action: str) -> list[tuple]:
        if action == "acquire" and hold.who is None:
            hold.who, hold.since, hold.until = who, at, at + ttl
            return [("acquired", who, at, at, hold.attempts)]
        if action == "heartbeat" and hold.who == who:
            hold.until = at + ttl
        elif action == "release" and hold.who == who and who is not None:
            hold.who = None
            return [("released", who, hold.since, at, hold.attempts)]
        return []

    return step


def claim_step(lease: int, most: int) -> Step:
    """A claim takes what is free, not done and was claimed fewer than ``most`` times; release and done count from the holder."""

    def step(hold: Hold, at: int, who: str, action: str) -> list[tuple]:
        if action == "claim" and hold.who is None and not hold.done and hold.attempts < most:
            hold.who, hold.since, hold.until, hold.attempts = who, at, at + lease, hold.attempts + 1
            return [("claimed", who, at, at, hold.attempts)]
        if action in ("release", "done") and hold.who == who and who is not None:
            hold.who, hold.done = None, action == "done"
            return [("released" if action == "release" else "done", who, hold.since, at, hold.attempts)]
        return []

    return step


class InOrder(StatefulProcessor):
    """Takes each key's events in order of (ts, id) once the watermark has passed them, and ends holds by timers."""

    def __init__(self, step: Step, keep: int):
        self.step, self.keep = step, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, id long, who string, action string")
        self.hold = handle.getValueState("hold", "who string, since long, until long, attempts int, done boolean, touched long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList([(int(r.ts.value // 1000), int(r.id), r.who, r.action) for r in pdf.itertuples(index=False)])
        yield self._settled(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settled(key, timerValues)

    def _settled(self, key, timers) -> pd.DataFrame:
        now = timers.getCurrentWatermarkInMs() * 1000
        hold = Hold(*self.hold.get()) if self.hold.exists() else Hold()
        waiting = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        done = []
        for at, _, who, action in (e for e in waiting if e[0] <= now):
            done += _lapse(hold, at)
            done += self.step(hold, at, who, action)
            hold.touched = at
        done += _lapse(hold, now)
        left = [e for e in waiting if e[0] > now]
        due = [left[0][0]] if left else []
        due += [hold.until] if hold.who is not None else []
        if hold.who is None and (not hold.attempts or hold.touched + self.keep <= now):
            self.hold.clear()
        else:
            self.hold.update(astuple(hold))
            due += [hold.touched + self.keep] if hold.who is None else []
        self.waiting.put(left) if left else self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        stamp = lambda us: pd.Timestamp(us, unit="us")
        return pd.DataFrame([(*key, what, who, stamp(since), stamp(at), n) for what, who, since, at, n in done], columns=[*self.names, "event", "holder", "since", "at", "attempts"])

    def close(self) -> None:
        pass


def _stream(events: DataFrame, keys: dict[str, str], who: str, step: Step, keep_seconds: int, watermark: str) -> DataFrame:
    processor = InOrder(step, keep_seconds * 1_000_000)
    processor.names = [*keys]
    rows = events.select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), F.col(who).alias("who"), "action").withWatermark("ts", watermark)
    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), "event string, holder string, since timestamp, at timestamp, attempts int"])
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventtime")


def lease_stream(events: DataFrame, ttl_seconds: int = 1200, watermark: str = "1 minute") -> DataFrame:
    """``(namespace, key, event, holder, since, at, attempts)``: leases as they are acquired, released and expire.

    ``events(namespace, key, holder, action, ts, id)`` as of :func:`factlake.streaming.feeds.lease_spans`; each span of it
    is one row that ends it here (``released`` or ``expired``). Rows later than the watermark are dropped; a key
    that is free has no state.
    """
    return _stream(events, {"namespace": "string", "key": "string"}, "holder", lease_step(ttl_seconds * 1_000_000), 0, watermark)


def claim_stream(events: DataFrame, lease_minutes: int = 15, most: int = 3, watermark: str = "1 minute", keep_seconds: int = 7 * 86_400) -> DataFrame:
    """``(message_id, event, holder, since, at, attempts)``: claims as they are taken, given back, done and run out.

    ``events(message_id, session, action, ts, id)`` as of :func:`factlake.streaming.feeds.claim_state`. What a message has
    been through is forgotten ``keep_seconds`` after its last event.
    """
    return _stream(events, {"message_id": "long"}, "session", claim_step(lease_minutes * 60_000_000, most), keep_seconds, watermark)
