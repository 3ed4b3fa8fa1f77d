"""Notes and reservations as one stream, and stored documents that expire: state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketry.functions.records import instant
from docketry.operators.cache_views import effective_hours
from docketry.operators.pacing import FUTURE_US, next_slot

#: A note has ``kind`` "note", a reservation "reserve"; columns that the other kind needs are null.
EVENTS = "upstream string, service string, seq long, kind string, at timestamp, interval_us long, floor_us long, cool_down_until_us long, intervals map<string,long>, block_until_us long, block_reason string"
SLOTS = "upstream string, service string, seq long, slot_us long, blocked_until_us long, blocked_reason string"
_MILLI = 1000


def _live(deadline: int | None, now: int) -> int | None:
    """A deadline still ahead, and not so far that a wrong clock wrote it."""
    return deadline if deadline is not None and now < deadline <= now + FUTURE_US else None


class _SharedPacer(StatefulProcessor):
    """One upstream: last slots and blocks by service, a cool-down, and the intervals it asked for.

    Timers at the deadlines of blocks and of the cool-down remove them; until a timer comes a deadline that has passed
    is only ignored, so results don't depend on how far the watermark is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "service string", "slot_us long")
        self.blocks = handle.getMapState("blocks", "service string", "until_us long, reason string")
        self.intervals = handle.getMapState("intervals", "service string", "interval_us long")
        self.cool_down = handle.getValueState("cool_down", "until_us long")

    def _block(self, service: str) -> tuple[int | None, str | None]:
        return tuple(self.blocks.getValue((service,))) if self.blocks.containsKey((service,)) else (None, None)

    def _timer(self, until_us: int) -> None:
        self.handle.registerTimer(until_us // _MILLI + 1)

    def _note(self, r) -> None:
        if r.cool_down_until_us is not None:
            self.cool_down.update((r.cool_down_until_us,))
            self._timer(r.cool_down_until_us)
        if r.intervals is not None:
            self.intervals.clear()
            for name, value in r.intervals.items():
                self.intervals.updateValue((name,), (int(value),))
        if r.block_until_us is not None or r.block_reason is not None:
            until, reason = self._block(r.service)
            until = until if r.block_until_us is None else r.block_until_us
            self.blocks.updateValue((r.service,), (until, reason if r.block_reason is None else r.block_reason))
            if r.block_until_us is not None:
                self._timer(until)

    def _reserve(self, r, upstream: str) -> tuple:
        cool = self.cool_down.get()[0] if self.cool_down.exists() else None
        ready = max(r.at_us, r.floor_us or 0, _live(cool, r.at_us) or 0)
        tight = self.intervals.getValue((r.service,))[0] if self.intervals.containsKey((r.service,)) else 0
        last = self.slots.getValue((r.service,))[0] if self.slots.containsKey((r.service,)) else None
        slot = next_slot(last, r.at_us, ready, max(r.interval_us or 0, tight))
        self.slots.updateValue((r.service,), (slot,))
        until, reason = self._block(r.service)
        until = _live(until, r.at_us)
        return upstream, r.service, r.seq, slot, until, None if until is None else reason or ""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        batch = batch.assign(**{c: batch[c].astype("Int64").astype(object).where(batch[c].notna(), None) for c in ("interval_us", "floor_us", "cool_down_until_us", "block_until_us", "at_us", "seq")})
        out = []
        for r in batch.itertuples(index=False):
            if r.kind == "note":
                self._note(r)
            else:
                out.append(self._reserve(r, key[0]))
        yield pd.DataFrame(out, columns=["upstream", "service", "seq", "slot_us", "blocked_until_us", "blocked_reason"]).astype({"blocked_until_us": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = expiredTimerInfo.getExpiryTimeInMs() * _MILLI
        if self.cool_down.exists() and self.cool_down.get()[0] < past:
            self.cool_down.clear()
        for service, (until, _) in list(self.blocks.iterator()):
            if until is not None and until < past:
                self.blocks.removeKey((service[0],))
        yield pd.DataFrame(columns=["upstream", "service", "seq", "slot_us", "blocked_until_us", "blocked_reason"])

    def close(self) -> None:
        pass


def shared_pacing(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Slots of the reservations in ``events`` (see ``EVENTS``), each with the block that holds for its service.

    Events of an upstream are taken by ``seq`` within a batch.  A note replaces what it names and leaves the rest; an
    empty map of intervals clears them.  A deadline that has passed, or lies more than an hour ahead, isn't shown.
    """
    timed = events.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    return timed.groupBy("upstream").transformWithStateInPandas(statefulProcessor=_SharedPacer(), outputStructType=SLOTS, outputMode="Append", timeMode="EventTime")


class _Lifetime(StatefulProcessor):
    """One stored document: when it expires; the timer at that time gives it out as evicted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "fetched_at string, seq long, deadline_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        last = batch.iloc[-1]
        held = self.entry.get() if self.entry.exists() else None
        if held is None or held[1] is None or int(last["seq"]) >= held[1]:
            if held is not None and held[2] is not None:
                self.handle.deleteTimer(held[2])
            deadline = None if pd.isna(last["deadline_ms"]) else int(last["deadline_ms"])
            self.entry.update((last["fetched_at"], int(last["seq"]), deadline))
            if deadline is not None:
                self.handle.registerTimer(deadline)
        yield pd.DataFrame(columns=["kind", "key", "fetched_at", "expired_at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        if held is None or held[2] is None or held[2] > expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame(columns=["kind", "key", "fetched_at", "expired_at_ms"])
            return
        self.entry.clear()
        yield pd.DataFrame([(key[0], key[1], held[0], held[2])], columns=["kind", "key", "fetched_at", "expired_at_ms"])

    def close(self) -> None:
        pass


def evictions(writes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """``kind, key, fetched_at, expired_at_ms`` of stored documents whose lifetime ends as event time goes on.

    ``writes(kind, key, fetched_at, seq, at)``: ``at`` is the event time, ``seq`` orders the writes of a key, and a
    later one replaces the document and its deadline.  Kinds that never expire are held but never given out; a document
    whose time can't be read is due at once.
    """
    hours, at = effective_hours(F.col("kind"), F.col("key")), instant(F.col("fetched_at"))
    due = F.when(at.isNull(), 0).when(hours.isNull(), None).otherwise(F.unix_millis(at) + hours.cast("long") * 3_600_000)
    timed = writes.withColumn("deadline_ms", due.cast("long")).withWatermark("at", late)
    return timed.groupBy("kind", "key").transformWithStateInPandas(statefulProcessor=_Lifetime(), outputStructType="kind string, key string, fetched_at string, expired_at_ms long", outputMode="Append", timeMode="EventTime")
