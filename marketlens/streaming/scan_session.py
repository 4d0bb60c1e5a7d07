"""The folds of a scan session as Structured Streaming jobs, and pages told once when they are settled.

Rows of a key wait in list state until the watermark has passed them; then an event-time timer hands them to the fold in order.  So what a stream tells of the rows
before its watermark is what the batch operator tells of them, however they were cut into batches.  Rows that come later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlens.operators.scan import Admission, FallbackReads, Fold, StableFrames, typed_rows
from marketlens.operators.visits import ExpiringKeys


class StateParts(MutableMapping):
    """Map state as a mapping: what was read or changed is kept until ``flush``, which writes the changes."""

    def __init__(self, state):
        self._state, self._held, self._changed = state, {}, set()

    def __getitem__(self, key: tuple):
        if key not in self._held:
            there = self._state.getValue(key)
            self._held[key] = there[0] if there is not None else None
        if self._held[key] is None:
            raise KeyError(key)
        return self._held[key]

    def __setitem__(self, key: tuple, value: bytes) -> None:
        self._held[key] = value
        self._changed.add(key)

    def __delitem__(self, key: tuple) -> None:
        self[key]
        self[key] = None

    def __iter__(self):
        raise NotImplementedError("parts are only looked up")

    __len__ = __iter__

    def clear(self) -> None:
        self._state.clear()
        self._held, self._changed = {}, set()

    def flush(self) -> None:
        for key in self._changed:
            if self._held[key] is not None:
                self._state.updateValue(key, (bytes(self._held[key]),))
            elif self._state.containsKey(key):
                self._state.removeKey(key)
        self._changed.clear()


class InOrder(StatefulProcessor):
    """A fold over rows in order of event time."""

    def __init__(self, fold: Fold, idle: int | None):
        self._fold, self._idle = fold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self._fold.columns)
        self._state = handle.getValueState("state", f"last long, {self._fold.state}")
        self._parts = handle.getMapState("parts", "size int, part int, bucket int", "keys binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = list(typed_rows(pdf, self._fold.columns))
            if new:
                self._waiting.appendList(new)
                first = min(first if first is not None else new[0][0], *(r[0] for r in new))
        if first is not None:
            self._handle.registerTimer(first * self._fold.unit)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold = self._fold
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        due = sorted((r for r in waiting if r[0] * fold.unit < now), key=lambda r: [(c is not None, c) for c in r])
        last, *state = self._state.get() if self._state.exists() else (None, *fold.start())
        parts, out = StateParts(self._parts), []
        for row in due:
            if last is not None and (ends := fold.ends(state, last, self._idle)) is not None and row[0] > ends:
                state = fold.start()
                parts.clear()
            out.append(fold.step(state, row, parts))
            last = row[0]
        parts.flush()
        if len(due) < len(waiting):
            later = [r for r in waiting if r[0] * fold.unit >= now]
            self._waiting.put(later)
            self._handle.registerTimer(min(r[0] for r in later) * fold.unit)
        elif due:
            self._waiting.clear()
        if last is not None:
            ends = fold.ends(state, last, self._idle)
            if len(due) == len(waiting) and ends is not None and ends * fold.unit < now:
                self._state.clear()
                self._parts.clear()
            else:
                if due:
                    self._state.update((last, *state))
                if ends is not None:
                    self._handle.registerTimer(max(ends * fold.unit, now))
        if due:
            yield pd.DataFrame({"session": [key[0]] * len(due), "ts": [r[0] for r in due], "state": out})


def _folded(stream: DataFrame, fold: Fold, late: str, idle: int | None) -> DataFrame:
    typed = stream.select(F.col("session").cast("string"), *[F.col(c.split()[0]).cast(c.split()[1]) for c in fold.columns.split(", ")]).where("session IS NOT NULL AND ts IS NOT NULL")
    rows = typed.withColumn("at", F.timestamp_millis(F.col("ts") * fold.unit)).withWatermark("at", late)
    return rows.groupBy("session").transformWithStateInPandas(InOrder(fold, idle), "session string, ts long, state string", "append", "eventTime")


def stable_frames(stream: DataFrame, late: str = "5 seconds", idle_ms: int = 3_600_000, **limits) -> DataFrame:
    """``session, ts, state`` as ``scan.stable_frames`` tells it, of all frames before the watermark.

    Frames wait until the watermark, ``late`` behind the newest frame of any session, has passed them; later ones are dropped.  A session's state
    is one row and goes when nothing came for ``idle_ms`` of event time: a session that goes on after that begins anew.
    Needs the RocksDB state store.  Spark's watermark begins at 1970, so times up to 0 count as late.
    """
    return _folded(stream, StableFrames(**limits), late, idle_ms)


def admitted_keys(stream: DataFrame, late: str = "5 seconds", idle_ms: int = 3_600_000, **limits) -> DataFrame:
    """``session, ts, state`` as ``scan.admitted_keys`` tells it, of all events before the watermark; see ``stable_frames``.

    Keys that were seen are map state by the buckets of their parts, so an event reads and writes one more entry than there may be differences, whatever was seen
    before, and a batch no entry twice.
    """
    return _folded(stream, Admission(**limits), late, idle_ms)


def fallback_reads(stream: DataFrame, late: str = "5 seconds", idle_ms: int = 3_600_000, **limits) -> DataFrame:
    """``session, ts, state`` as ``scan.fallback_reads`` tells it, of all frames before the watermark; see ``stable_frames``."""
    return _folded(stream, FallbackReads(**limits), late, idle_ms)


def expiring_keys(stream: DataFrame, late: str = "5 seconds") -> DataFrame:
    """``session, ts, result`` as ``visits.expiring_keys`` tells it, of all commands before the watermark; see ``stable_frames``.

    The state of a key is a value and when it ends.  It goes as soon as the watermark has passed that end, or when the key is deleted.
    """
    return _folded(stream, ExpiringKeys(), late, None).withColumnRenamed("state", "result")


class Settling(StatefulProcessor):
    """Tells a page when its text was quiet, or at the cap."""

    def __init__(self, quiet_ms: int, cap_ms: int, keep_ms: int):
        self._quiet, self._cap, self._keep = quiet_ms, cap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "ts long, text string")
        self._state = handle.getValueState("state", "opened long, changed long, changes long, text string, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(pdf["ts"].tolist(), pdf["text"].tolist())]
        self._waiting.appendList(new)
        self._handle.registerTimer(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        opened, changed, changes, text, told = self._state.get() if self._state.exists() else (None, None, 0, None, False)
        out = []

        def tell(before: int) -> None:
            nonlocal told
            settled, capped = changed + self._quiet, opened + self._cap
            if not told and min(settled, capped) < before:
                out.append((key[0], min(settled, capped), text, settled < capped, changes))
                told = True

        for ts, read in sorted(r for r in waiting if r[0] < now):
            if opened is None:
                opened, changed, changes, text = ts, ts, 0, read
            tell(ts + 1)
            if not told and read != text:
                changed, changes, text = ts, changes + 1, read
        later = [r for r in waiting if r[0] >= now]
        if later:
            self._waiting.put(later)
            self._handle.registerTimer(min(r[0] for r in later))
        elif waiting:
            self._waiting.clear()
        if opened is not None:
            tell(now)
            self._state.update((opened, changed, changes, "" if told else text, told))
            if not told:
                self._handle.registerTimer(min(changed + self._quiet, opened + self._cap))
            elif later or opened + self._keep >= now:
                self._handle.registerTimer(max(opened + self._keep, now))
            else:
                self._state.clear()
        if out:
            yield pd.DataFrame(out, columns=["page", "ts", "text", "settled", "changes"])


def settled_pages(stream: DataFrame, quiet_ms: int = 500, cap_ms: int = 5000, late: str = "5 seconds", keep_ms: int = 3_600_000) -> DataFrame:
    """``page, ts, text, settled, changes`` as ``pages.settled_pages`` tells it, once the watermark has passed the moment; see ``stable_frames``.

    Rows have ``page`` (one load of a page), ``ts`` (ms) and ``text``.  What is read of a load after it was told is
    ignored; that it was told is remembered until the watermark has passed its first row by ``keep_ms``, within which all rows of a load should come.
    """
    typed = stream.select(F.col("page").cast("string"), F.col("ts").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("page IS NOT NULL AND ts IS NOT NULL")
    rows = typed.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return rows.groupBy("page").transformWithStateInPandas(Settling(quiet_ms, cap_ms, keep_ms), "page string, ts long, text string, settled boolean, changes long", "append", "eventTime")
